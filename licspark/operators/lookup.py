"""Lookups of a small table inside rows, for array elements that should not be exploded.

The table becomes one row: an array of small maps, picked by the hash of the
key. A wide array column is then translated without any shuffle. Only tables
whose size does not follow the corpus belong here: dictionaries, and vocabularies
cut to ``max_features`` terms.
"""

from pyspark.sql import Column, DataFrame, functions as F

BUCKETS = 4096


def _bucket(key: Column) -> Column:
    return F.pmod(F.hash(key), F.lit(BUCKETS))


def lookup_value(table: DataFrame, key: str, value: str) -> Column:
    """The table as a scalar column; keys must be unique."""
    per_bucket = table.groupBy(_bucket(F.col(key)).alias("bucket")).agg(
        F.map_from_entries(F.collect_list(F.struct(key, value))).alias("entries")
    )
    by_bucket = F.map_from_entries(F.collect_list(F.struct("bucket", "entries")))
    row = per_bucket.agg(by_bucket.alias("by_bucket")).select(
        F.transform(
            F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: F.try_element_at("by_bucket", b)
        ).alias("lookup")
    )
    return row.scalar()


def found(lookup: Column, key: Column) -> Column:
    """Value of the key, or null."""
    return F.try_element_at(F.get(lookup, _bucket(key)), key)
