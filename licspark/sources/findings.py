"""Raw findings."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from licspark import fixed_values as fv
from licspark.schemas import CSV_DUMP, RAW_FINDINGS


def read_raw_findings(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    """Raw findings with a fixed schema; unknown fields are ignored."""
    return spark.read.schema(RAW_FINDINGS).format(format).load(path)


def read_checked_findings(spark: SparkSession, path: str) -> DataFrame:
    """Raw findings of JSON lines, with ``damaged``: the text of a line that is no finding, else null."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "damaged"}
    parsed = F.from_json("value", f"{RAW_FINDINGS}, damaged string", options)
    return spark.read.text(path).where(F.trim("value") != "").select(parsed.alias("row")).select("row.*")


def sound_findings(checked: DataFrame) -> DataFrame:
    """The findings that were read whole."""
    return checked.where(F.col("damaged").isNull()).drop("damaged")


def damaged_lines(checked: DataFrame) -> DataFrame:
    """Lines for the quarantine, with their text: (path, source, problem, line)."""
    known = checked.where(F.col("damaged").isNotNull())
    return known.select("path", "source", F.lit("damaged line").alias("problem"), F.col("damaged").alias("line"))


def is_scanner(source: Column) -> Column:
    return source.isin(*fv.SCANNERS)


def dump_findings(rows: DataFrame) -> DataFrame:
    """Dump rows to findings: scanners take the scanner column, others the conclusion.

    Rows that end before the source column are marked in ``rejected``.
    """
    license = F.when(is_scanner(F.col("source")), F.col("scanner_result")).otherwise(F.col("conclusion"))
    return rows.select(
        "path",
        "source",
        F.array(license).alias("licenses"),
        F.col("source").isNull().alias("rejected"),
    )


def parse_dump_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Dump lines held in a text column to dump rows; missing columns are null."""
    return lines.select("*", F.from_csv(column, CSV_DUMP, {"mode": "PERMISSIVE"}).alias("_row")).select(
        "*", "_row.*"
    ).drop("_row")


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    return dump_findings(spark.read.csv(path, schema=CSV_DUMP, mode="PERMISSIVE"))
