"""License analytics over large file corpora, expressed as Spark jobs."""

__version__ = "0.1.0"
