"""License name mapping."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from licspark import fixed_values as fv
from licspark.functions.names import clean_license
from licspark.functions.text import strip


def mapping_rows(lines: DataFrame) -> DataFrame:
    """(line_no, value) to (line_no, old, new): ``;``-separated, empty targets dropped."""
    parts = F.split(strip(F.col("value")), ";")
    return lines.select(
        "line_no",
        F.get(parts, F.lit(0)).alias("old"),
        F.filter(F.slice(parts, F.lit(2), F.size(parts)), lambda x: x != "").alias("new"),
    )


def license_mapping(lines: DataFrame) -> DataFrame:
    """The mapping table; of repeated names the last line counts."""
    return mapping_rows(lines).groupBy("old").agg(F.max_by("new", "line_no").alias("new"))


def duplicate_names(lines: DataFrame) -> DataFrame:
    return (
        mapping_rows(lines).groupBy("old").agg(F.count("*").alias("n_lines")).where(F.col("n_lines") > 1)
    )


def mapped_sets(sets: DataFrame, mapping: DataFrame, faithful: bool = False) -> DataFrame:
    """``licenses`` arrays with their ``mapped_licenses``.

    Default: a license mapped to NO_MAPPED_LICENSE adds nothing, so the result
    may be empty. ``faithful=True``: such a license ends the mapping of the set
    (earlier ones stay), and an empty result gives the raw names back.
    """
    exploded = sets.select("licenses", F.posexplode("licenses").alias("pos", "raw")).withColumn(
        "old", clean_license(F.col("raw"), faithful)
    )
    looked_up = exploded.join(mapping, "old", "left").withColumn(
        "new", F.when(F.size("new") > 0, F.col("new")).otherwise(F.array("old"))
    )
    drops = F.array_contains("new", fv.NO_MAPPED_LICENSE)
    if faithful:
        # Sets are distinct here, and a set is one document's array: small groups.
        cut = F.max(drops.cast("int")).over(Window.partitionBy("licenses").orderBy("pos"))
        kept = looked_up.withColumn("new", F.when(cut == 0, F.col("new")))
    else:
        kept = looked_up.withColumn("new", F.when(~drops, F.col("new")))
    mapped = kept.groupBy("licenses").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("new")))).alias("mapped_licenses")
    )
    if faithful:
        mapped = mapped.withColumn(
            "mapped_licenses",
            F.when(F.size("mapped_licenses") > 0, F.col("mapped_licenses")).otherwise(F.col("licenses")),
        )
    return mapped


def map_licenses(files: DataFrame, mapping: DataFrame, faithful: bool = False) -> DataFrame:
    """Add ``mapped_licenses`` to files.

    Millions of files share few license sets, so only the distinct sets are
    mapped. The file rows then meet them in one join; from the real size of the
    sets, adaptive execution makes it a broadcast or splits a set that owns many
    files. Nothing runs while the plan is built.
    """
    sets = mapped_sets(files.select("licenses").distinct(), mapping, faithful)
    mapped = files.drop("mapped_licenses").join(sets, "licenses", "left")
    return mapped.withColumn(
        "mapped_licenses", F.coalesce("mapped_licenses", F.array().cast("array<string>"))
    )


def is_dual(mapped_licenses: Column) -> Column:
    return F.array_contains(mapped_licenses, fv.MULTI_LICENSE)


def mapping_template(licenses: DataFrame) -> DataFrame:
    """Unique names with an empty target, sorted without regard to case."""
    names = licenses.select(F.explode("licenses").alias("license")).distinct()
    return names.orderBy(F.lower("license"), "license").select("license", F.lit("").alias("target"))
