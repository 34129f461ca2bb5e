"""Tags of files."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from licspark import fixed_values as fv


def _array(values) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def no_tags() -> Column:
    return F.array().cast("array<string>")


def derived_tags(tags: Column, mapped: Column, lrw: Column, no_lrw: Column) -> Column:
    """Replace the derived tags of a file by those its other columns imply; other tags stay."""
    filled = lambda words: F.coalesce(F.size(words) > 0, F.lit(False))
    fresh = F.array_compact(
        F.array(
            F.when(F.size(mapped) == 1, fv.SINGLE_MAPPED_LICENSE).when(
                F.size(mapped) > 1, fv.MULTIPLE_MAPPED_LICENSE
            ),
            F.when(filled(lrw), fv.LRW),
            F.when(filled(no_lrw), fv.NO_LRW),
        )
    )
    kept = F.array_except(F.coalesce(tags, no_tags()), _array(fv.DERIVED_TAGS))
    return F.sort_array(F.array_union(kept, fresh))


def add_tag(tags: Column, tag: str) -> Column:
    return F.array_union(tags, _array([tag]))


def remove_tag(tags: Column, tag: str) -> Column:
    return F.array_remove(tags, tag)


def has_tags(tags: Column, all_of=(), none_of=(), one: str | None = None) -> Column:
    """Predicate: holds all of, none of, and (when given) one tag."""
    checks = []
    if all_of:
        checks.append(F.size(F.array_except(_array(all_of), tags)) == 0)
    if none_of:
        checks.append(~F.arrays_overlap(tags, _array(none_of)))
    if one:
        checks.append(F.array_contains(tags, one))
    return reduce(lambda a, b: a & b, checks, F.lit(True))


def drop_tag_everywhere(files: DataFrame, tag: str) -> DataFrame:
    return files.withColumn("tags", remove_tag(F.col("tags"), tag))
