"""Left join of many rows with a table of unique keys, when some keys own any share of the rows."""

from pyspark.sql import DataFrame, functions as F

#: A key is hot if it owns more than one row in HOT_KEYS; so fewer than HOT_KEYS keys are hot, whatever the input.
HOT_KEYS = 4096


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """(key) of the hot keys: fewer than HOT_KEYS rows."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    total = rows.agg(F.count("*").alias("_n")).scalar()
    return counts.where(F.col("_n") * HOT_KEYS > total).select(key)


def hot_join(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Every row of ``rows`` with the columns of ``table`` for its key, null where there is none; a null key has none.

    ``table`` has each key once. Rows of hot keys stay where they are and meet the hot
    keys' rows of the table in a broadcast, fewer than HOT_KEYS of them by a count of all
    rows. The others are shuffled by key, no key with more than a share of 1 / HOT_KEYS.
    Rows with a null key stay too. ``rows`` is read several times, so pass a stored table.
    """
    others = [c for c in table.columns if c != key]
    table = table.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_t_{c}") for c in others])
    hot = hot_keys(rows, key).withColumnRenamed(key, "_key").join(table, "_key", "left").withColumn("_hot", F.lit(True))
    same = F.col(key) == F.col("_key")
    added = [F.col(f"_t_{c}").alias(c) for c in others]
    marked = rows.join(F.broadcast(hot), same, "left")
    stays = F.col("_hot").isNotNull() | F.col(key).isNull()
    still = marked.where(stays).select(*rows.columns, *added)
    moved = marked.where(~stays).select(*rows.columns).join(table, same, "left").select(*rows.columns, *added)
    return still.unionByName(moved)
