"""License mapping files."""

import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from licspark.operators.mapping import license_mapping, mapping_template
from licspark.schemas import LICENSE_MAPPING


def empty_mapping(spark: SparkSession) -> DataFrame:
    """Mapping used when there is no file: every cleaned name stands for itself."""
    return spark.createDataFrame([], LICENSE_MAPPING)


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """Mapping table of a ``;``-separated file; the last of repeated names counts.

    The hand-written file is read whole, so positions follow its lines. A
    missing file gives a warning and an empty mapping.
    """
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        warnings.warn(f"no license mapping at {path}")
        return empty_mapping(spark)
    lines = text.select(
        F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value")
    )
    return license_mapping(lines.where(F.trim("value") != ""))


def write_mapping_template(files: DataFrame, path: str) -> None:
    """One sorted file with every license name and an empty target, to be filled in by hand."""
    mapping_template(files).coalesce(1).write.mode("overwrite").csv(path, sep=";", emptyValue="")
