"""Reproducible hold-out: the first share of every license's files, by path."""

from pyspark.sql import DataFrame, functions as F

from licspark import fixed_values as fv
from licspark.operators.ranking import rank_within
from licspark.operators.tags import add_tag, drop_tag_everywhere
from licspark.session import durable


def holdout_paths(
    files: DataFrame, min_samples: int = fv.HOLDOUT_MIN_SAMPLES, factor: float = fv.HOLDOUT_FACTOR
) -> DataFrame:
    """Paths to hold out: per license with enough files the first ``ceil(n * factor)``."""
    placed = files.select("path", F.explode(F.array_distinct("mapped_licenses")).alias("license"))
    quota = F.ceil(F.col("group_size") * F.lit(float(factor)))
    return (
        rank_within(placed, ["license"], ["path"])
        .where((F.col("group_size") >= min_samples) & (F.col("rank") <= quota))
        .select("path")
        .distinct()
    )


def tag_holdout(
    files: DataFrame,
    tag: str = fv.TEST,
    min_samples: int = fv.HOLDOUT_MIN_SAMPLES,
    factor: float = fv.HOLDOUT_FACTOR,
) -> DataFrame:
    """Remove the tag everywhere, then set it on the hold-out files."""
    files = durable(files)  # read twice, and costly to make
    chosen = holdout_paths(files, min_samples, factor).withColumn("_held", F.lit(True))
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    return (
        drop_tag_everywhere(files.withColumn("tags", tags), tag)
        .join(chosen, "path", "left")
        .withColumn("tags", F.when(F.col("_held"), add_tag(F.col("tags"), tag)).otherwise(F.col("tags")))
        .drop("_held")
    )
