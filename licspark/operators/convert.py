"""Raw findings to one row per (kind, path)."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from licspark import fixed_values as fv
from licspark.functions.names import clean_license


def source_registry(spark: SparkSession, extra=()) -> DataFrame:
    """Known sources; add rows to support new ones."""
    return spark.createDataFrame(
        [*fv.SOURCE_REGISTRY, *extra], "source string, kind string, remove boolean, indirect boolean"
    )


def _by_source(index: int, kind: str) -> Column:
    """CASE over the built-in sources, leaving out those without a value."""
    rows = [(r[0], r[index]) for r in fv.SOURCE_REGISTRY if r[index] is not None]
    return reduce(
        lambda chain, row: chain.when(F.col("source") == row[0], F.lit(row[1])),
        rows[1:],
        F.when(F.col("source") == rows[0][0], F.lit(rows[0][1])),
    ).cast(kind)


def typed_findings(raw: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Add kind, remove and indirect; unknown sources have no kind.

    The built-in registry is a CASE expression. A registry table is joined with
    a broadcast: it has one row per source.
    """
    if registry is None:
        typed = raw.withColumns(
            {
                "kind": _by_source(1, "string"),
                "remove": _by_source(2, "boolean"),
                "indirect": _by_source(3, "boolean"),
            }
        )
    else:
        typed = raw.join(F.broadcast(registry), "source", "left")
    return typed.withColumn("text", F.when(F.col("kind").isin("License", "Bulk"), F.col("text")))


def _known(raw: DataFrame, registry: DataFrame | None) -> DataFrame:
    """Findings with a path and a known source."""
    if registry is None:
        raw = raw.where(F.col("source").isin([r[0] for r in fv.SOURCE_REGISTRY]))
    else:
        raw = raw.join(F.broadcast(registry.select("source")), "source", "left_semi")
    return typed_findings(raw.where(F.col("path").isNotNull()), registry)


def quarantine(raw: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Rows that cannot be converted, with the reason."""
    named = F.exists("licenses", lambda x: clean_license(x) != "")
    return (
        typed_findings(raw, registry)
        .withColumn(
            "problem",
            F.when(F.col("path").isNull(), "missing path")
            .when(F.col("kind").isNull(), "unknown source")
            .when(~F.coalesce(named, F.lit(False)), "no license"),
        )
        .where(F.col("problem").isNotNull())
        .select("seq", "path", "source", "problem")
    )


def merge_findings(typed: DataFrame) -> DataFrame:
    """One row per (kind, path): all licenses, and the first other fields by ``seq``.

    License sets are merged inside the partial aggregation, so a path with very
    many findings sends only its distinct licenses through the shuffle. Names
    are cleaned after the explode, as plain scalars; blank ones become null and
    leave the sets, and files without any name leave the result.
    """
    name = clean_license(F.col("license"))
    return (
        typed.select(
            "kind",
            "path",
            "seq",
            F.struct("remove", "indirect", "text").alias("fields"),
            F.explode("licenses").alias("license"),
        )
        .groupBy("kind", "path")
        .agg(
            F.collect_set(F.nullif(name, F.lit(""))).alias("licenses"),
            F.min_by("fields", "seq").alias("fields"),
            F.min("seq").alias("seq"),
        )
        .where(F.size("licenses") > 0)
        .select("kind", "path", F.sort_array("licenses").alias("licenses"), "fields.*", "seq")
    )


def convert_findings(raw: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Raw findings to files."""
    return merge_findings(_known(raw, registry))


def upsert_findings(files: DataFrame, raw: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Merge new raw findings into already converted files."""
    columns = ["kind", "path", "licenses", "remove", "indirect", "text", "seq"]
    return merge_findings(files.select(columns).unionByName(_known(raw, registry).select(columns)))


def kind_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("kind").agg(F.count("*").alias("n"))
