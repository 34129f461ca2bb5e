"""Counts over a collection of files: one aggregation for all metrics."""

from pyspark.sql import Column, DataFrame, functions as F

from licspark.functions.filetypes import file_type_key
from licspark.functions.names import count_line, percent_line

FILE_TYPES = "file_types"
MAPPED_SINGLE = "mapped_single_license"
MAPPED_MULTI = "mapped_multiple_license"
SINGLE = "single_license"
MULTI = "multiple_license"
TAGS = "tags"
DOCUMENTS = "doc_count"


def _keyed(metric: str, keys: Column) -> Column:
    return F.transform(
        keys, lambda k: F.struct(F.lit(metric).alias("metric"), k.cast("string").alias("key"))
    )


def _when_size(licenses: Column, is_wanted) -> Column:
    return F.when(is_wanted(F.size(licenses)), licenses).otherwise(F.array().cast("array<string>"))


def analyze(files: DataFrame, where: Column | None = None) -> DataFrame:
    """(metric, key, n) for file types, single and multiple licenses, tags, documents.

    Every file emits its keys in one pass; counts are combined before the
    shuffle, so only one row per task and key moves, however hot a key is.
    """
    files = files if where is None else files.where(where)
    col = lambda name: F.coalesce(F.col(name), F.array().cast("array<string>"))
    keys = F.concat(
        _keyed(DOCUMENTS, F.array(F.lit("all"))),
        _keyed(FILE_TYPES, F.array(file_type_key(F.col("file_type")))),
        _keyed(MAPPED_SINGLE, _when_size(col("mapped_licenses"), lambda n: n == 1)),
        _keyed(MAPPED_MULTI, _when_size(col("mapped_licenses"), lambda n: n > 1)),
        _keyed(SINGLE, _when_size(col("licenses"), lambda n: n == 1)),
        _keyed(MULTI, _when_size(col("licenses"), lambda n: n > 1)),
        _keyed(TAGS, col("tags")),
    )
    return (
        files.select(F.inline(keys)).groupBy("metric", "key").agg(F.count("*").alias("n"))
    )


def merge_analyses(*parts: DataFrame) -> DataFrame:
    """Add up analyses of disjoint collections."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.groupBy("metric", "key").agg(F.sum("n").alias("n"))


def metric(analysis: DataFrame, name: str) -> DataFrame:
    return analysis.where(F.col("metric") == name).select("key", "n")


def sorted_counts(counts: DataFrame, top_n: int | None = None) -> DataFrame:
    """Counts in falling order, ties by key."""
    ordered = counts.orderBy(F.desc("n"), "key")
    return ordered.limit(top_n) if top_n else ordered


def percentages(analysis: DataFrame, total: int | None = None) -> DataFrame:
    """Share of every count in the number of documents; null when there are none."""
    n_docs = (
        F.lit(total)
        if total
        else analysis.where(F.col("metric") == DOCUMENTS).agg(F.sum("n").alias("n_docs")).scalar()
    )
    return analysis.withColumn("pct", F.try_divide(F.col("n"), n_docs) * 100)


def report_lines(analysis: DataFrame) -> DataFrame:
    """Printable count and percentage lines."""
    return (
        percentages(analysis)
        .where(F.col("metric") != DOCUMENTS)
        .select(
            "metric",
            "key",
            count_line(F.col("key"), F.col("n")).alias("count_line"),
            percent_line(F.col("key"), F.col("pct")).alias("percent_line"),
        )
    )


def licenses_with_min_samples(analysis: DataFrame, k: int) -> DataFrame:
    """Licenses frequent enough among single or among multiple ones (not in sum)."""
    frequent = F.col("metric").isin(MAPPED_SINGLE, MAPPED_MULTI) & (F.col("n") >= k)
    return analysis.where(frequent).select(F.col("key").alias("license")).distinct()


def top_licenses(analysis: DataFrame, n: int) -> DataFrame:
    """Union of the ``n`` most frequent single and the ``n`` most frequent multiple licenses."""
    tops = [sorted_counts(metric(analysis, m), n) for m in (MAPPED_SINGLE, MAPPED_MULTI)]
    return tops[0].union(tops[1]).select(F.col("key").alias("license")).distinct()


def unique_licenses(analysis: DataFrame, mapped: bool) -> DataFrame:
    metrics = (MAPPED_SINGLE, MAPPED_MULTI) if mapped else (SINGLE, MULTI)
    return analysis.where(F.col("metric").isin(*metrics)).select(F.col("key").alias("license")).distinct()


def combined_counts(analysis: DataFrame) -> DataFrame:
    """Mapped license counts over single and multiple files together."""
    return (
        analysis.where(F.col("metric").isin(MAPPED_SINGLE, MAPPED_MULTI))
        .groupBy(F.col("key").alias("license"))
        .agg(F.sum("n").alias("n"))
    )
