"""Running sums and last values along an order, when one group may own any share of the rows.

A window over a whole group would be one task. Here rows are sorted by ranges of (group,
order), each range is scanned by itself, and what a range hands on is found by a second
scan over one row per group and range.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from licspark.session import durable


def in_ranges(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Stored rows with ``_slice``, the number of their range of (group, order); ``order`` is unique in a group."""
    ordered = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    return durable(ordered.withColumn("_slice", F.spark_partition_id()))


def carried(ranged: DataFrame, group: list[str], order: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None) -> DataFrame:
    """Add what lies before each row of its group: the sum of a number, or the last value that is not null.

    ``ranged`` comes from `in_ranges`. The first row of a group has sum 0 and last value null.
    """
    sums, lasts = sums or {}, lasts or {}
    place = F.struct(*order)
    ends = ranged.groupBy(*group, "_slice").agg(
        *[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()],
        *[F.max_by(c, F.when(c.isNotNull(), place)).alias(f"_t_{n}") for n, c in lasts.items()],
    )
    across = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    handed = ends.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.col("_slice").alias("_s"),
        *[F.coalesce(F.sum(f"_t_{n}").over(across), F.lit(0)).alias(f"_h_{n}") for n in sums],
        *[F.last(f"_t_{n}", ignorenulls=True).over(across).alias(f"_h_{n}") for n in lasts],
    )
    same = F.col("_slice") == F.col("_s")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inside = Window.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumns(
        {f"_l_{n}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()}
        | {f"_l_{n}": F.last(c, ignorenulls=True).over(inside) for n, c in lasts.items()}
    )
    found = {n: F.col(f"_l_{n}") + F.col(f"_h_{n}") for n in sums} | {n: F.coalesce(F.col(f"_l_{n}"), F.col(f"_h_{n}")) for n in lasts}
    return local.join(handed, same).select(*ranged.columns, *[c.alias(n) for n, c in found.items()])
