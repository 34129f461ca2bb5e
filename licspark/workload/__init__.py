"""The engine's operators run over the driver's tables, with SQL twins."""
