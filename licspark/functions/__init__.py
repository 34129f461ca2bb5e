"""Column functions: every one maps columns of a row to a column, no shuffle."""
