"""Training samples."""

from pyspark.sql import DataFrame, functions as F

from licspark import fixed_values as fv
from licspark.functions.names import generalize_license, licenses_of_family, route_label
from licspark.operators.ranking import first_per_group
from licspark.operators.tags import has_tags
from licspark.session import durable

SAMPLE = ["license", "path", "words", "labels"]


def license_samples(
    files: DataFrame,
    licenses: DataFrame,
    max_samples: int,
    all_of=(),
    none_of=(),
    min_kept: int = fv.MIN_SAMPLES_KEPT,
    distinct: bool = False,
) -> DataFrame:
    """At most ``max_samples`` files per training license.

    The cap comes before files without words or labels are dropped; licenses
    with fewer than ``min_kept`` remaining files leave. A file with several
    training licenses appears once per license unless ``distinct`` is set.
    """
    candidates = files.where(has_tags(F.col("tags"), all_of=all_of, none_of=none_of)).select(
        "path", F.explode(F.array_distinct("mapped_licenses")).alias("license")
    )
    wanted = candidates.join(licenses, "license", "left_semi")
    chosen = first_per_group(wanted, ["license"], ["path"], max_samples)
    usable = files.select(
        "path",
        F.col("license_related_words").alias("words"),
        F.col("mapped_licenses").alias("labels"),
    ).where((F.size("words") > 0) & (F.size("labels") > 0))
    # Counted on names alone; the words join once the licenses are known.
    kept = chosen.join(usable.select("path"), "path", "left_semi")
    enough = kept.groupBy("license").agg(F.count("*").alias("n")).where(F.col("n") >= min_kept)
    samples = rows_of_paths(usable, kept.join(enough.select("license"), "license", "left_semi"))
    if distinct:
        samples = samples.dropDuplicates(["path"])
    return samples.select(SAMPLE)


def rows_of_paths(wide: DataFrame, chosen: DataFrame) -> DataFrame:
    """Wide rows of the chosen paths, which are ranked and capped alone.

    The chosen paths are stored, so Spark knows how few they are when it plans the join,
    and the wide rows stay where they lie.
    """
    return wide.join(durable(chosen), "path")


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows by ``order``: salted parts are cut to ``n`` rows before the rest meets."""
    return first_per_group(df.withColumn("_all", F.lit(0)), ["_all"], order, n).drop("_all")


def no_license_samples(
    files: DataFrame, max_samples: int, exclude_tags=(fv.TEST,)
) -> DataFrame:
    """Words outside license text of the first files tagged NO_LRW."""
    tagged = files.where(has_tags(F.col("tags"), none_of=exclude_tags, one=fv.NO_LRW))
    chosen = first_rows(tagged.select("path"), ["path"], max_samples)
    words = tagged.select("path", F.col("no_license_related_words").alias("words"))
    return (
        rows_of_paths(words, chosen)
        .where(F.size("words") > 0)
        .select("path", "words", F.lit(fv.NO_LICENSE).alias("label"))
    )


def drawn(samples: DataFrame) -> DataFrame:
    """Add ``_draw``, a hash of the path that gives rows a random but lasting order."""
    return samples.withColumn("_draw", F.md5(F.col("path").cast("binary")))


def rows_of_samples(samples: DataFrame, chosen: DataFrame) -> DataFrame:
    return samples.join(durable(chosen.select("license", "path")), ["license", "path"], "left_semi")


def routing_samples(single: DataFrame, multi: DataFrame, files: DataFrame) -> DataFrame:
    """Equal numbers of single, multiple and no-license samples with their route label.

    Samples are drawn by a hash of the path, so every license gives the same share.
    """
    share = min(single.count(), multi.count()) // 3
    routed = [
        rows_of_samples(part, first_rows(drawn(part.select("license", "path")), ["_draw", "license", "path"], share)).select(
            "path", "words", route_label(F.col("labels")).alias("label")
        )
        for part in (single, multi)
    ]
    return routed[0].unionByName(routed[1]).unionByName(no_license_samples(files, share))


def family_samples(
    files: DataFrame, family: str, max_samples: int, exclude_tags=(fv.TEST,)
) -> DataFrame:
    """Files with any license of the family; only its variants stay as labels."""
    of_family = F.exists("mapped_licenses", lambda x: F.startswith(x, F.lit(family)))
    candidates = files.where(of_family & has_tags(F.col("tags"), none_of=exclude_tags))
    chosen = first_rows(candidates.select("path"), ["path"], max_samples)
    wide = candidates.select(
        "path",
        F.col("license_related_words").alias("words"),
        licenses_of_family(F.col("mapped_licenses"), family).alias("labels"),
    )
    return rows_of_paths(wide, chosen).where(F.size("words") > 0)


def generalize_labels(samples: DataFrame, families=fv.SPECIAL_FAMILIES) -> DataFrame:
    return samples.withColumn(
        "labels", F.transform("labels", lambda x: generalize_license(x, families))
    )
