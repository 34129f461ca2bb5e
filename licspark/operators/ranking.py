"""Row numbers and per-group limits that hold when one group owns a third of the rows."""

from pyspark.sql import DataFrame, Window, functions as F

from licspark.session import durable


def rank_within(
    df: DataFrame, group: list[str], order: list[str], name: str = "rank", size: str = "group_size"
) -> DataFrame:
    """``row_number`` and row count per group without a window over the whole group.

    One range shuffle sorts by (group, order), so a hot group spreads over many
    partitions. ``monotonically_increasing_id`` then numbers the rows inside
    each partition, and the few (group, partition) sizes (at most groups plus
    partitions) give the offsets and the group sizes. The numbered rows are stored, because ranges
    are drawn from a sample and both uses must see the same ones. ``order`` should be unique in a group.
    """
    staged = durable(
        df.repartitionByRange(*group, *order)
        .sortWithinPartitions(*group, *order)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_slice", F.spark_partition_id())
    )
    slices = staged.groupBy(*group, "_slice").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    of_group = Window.partitionBy(*group)
    before = F.sum("_n").over(of_group.orderBy("_slice")) - F.col("_n")
    offsets = slices.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.col("_slice").alias("_s"),
        (before - F.col("_first") + 1).alias("_shift"),
        F.sum("_n").over(of_group).alias(size),
    )
    same = F.col("_slice") == F.col("_s")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return (
        staged.join(offsets, same)
        .withColumn(name, F.col("_id") + F.col("_shift"))
        .drop("_id", "_slice", "_s", "_shift", *[f"_g{i}" for i in range(len(group))])
    )


def first_per_group(
    df: DataFrame, group: list[str], order: list[str], n: int, salts: int = 64
) -> DataFrame:
    """The first ``n`` rows of every group.

    Two levels: salted subgroups are cut to ``n`` rows first, so the last
    window sees at most ``salts * n`` rows of a group. Spark also limits each
    subgroup before its shuffle.
    """
    salt = F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int")
    within = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return (
        df.withColumn("_salt", salt)
        .withColumn("_rn", within(*group, "_salt"))
        .where(F.col("_rn") <= n)
        .withColumn("_rn", within(*group))
        .where(F.col("_rn") <= n)
        .drop("_salt", "_rn")
    )
