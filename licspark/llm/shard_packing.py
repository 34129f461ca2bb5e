"""Shards of equal bytes from indivisible groups of equal texts, by best-fit-decreasing bin packing.

Groups, sorted by size, enter the bin with the least room left that still holds them; the
bins stand in a balanced tree by their room. One task can only sort a bounded number of
groups, so packing goes up in levels: items are dealt by hash to cells of about
CELL_ITEMS, and each cell packs its items into small bins (a PARTS-th of a shard), which
are the items of the next level. Any two bins of a cell hold more than one small bin
together, so a level leaves at most cells + 2 * shards * PARTS items; when FINAL_ITEMS
or less are left they are packed into the shards. Items larger than a small bin go up
as they are, so that the largest groups are always placed with a view of all shards.
"""

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from licspark.operators.ranking import rank_within
from licspark.session import durable

CELL_ITEMS = 4096
FINAL_ITEMS = 32768
#: Small bins of a shard.
PARTS = 512
#: Entries of a leaf of the tree.
_LEAF = 256


class RoomTree:
    """Bins by the room left, in a tree of height two with leaves of bounded size that split when full."""

    def __init__(self):
        self.leaves: list[list[tuple[int, int]]] = [[]]
        self.largest: list[tuple[int, int]] = [(0, -1)]

    def add(self, room: int, number: int) -> None:
        entry = (room, number)
        at = min(bisect_left(self.largest, entry), len(self.leaves) - 1)
        leaf = self.leaves[at]
        insort(leaf, entry)
        if len(leaf) > _LEAF:
            self.leaves.insert(at + 1, leaf[_LEAF // 2 :])
            del leaf[_LEAF // 2 :]
            self.largest.insert(at + 1, self.leaves[at + 1][-1])
        self.largest[at] = leaf[-1]

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return (room, bin) of the tightest bin with room for `size`; among equals the first opened."""
        at = bisect_left(self.largest, (size, -1))
        if at == len(self.leaves) or not self.leaves[at]:
            return None
        leaf = self.leaves[at]
        entry = leaf.pop(bisect_left(leaf, (size, -1)))
        if leaf:
            self.largest[at] = leaf[-1]
        elif len(self.leaves) > 1:
            del self.leaves[at], self.largest[at]
        else:
            self.largest[at] = (0, -1)
        return entry


def best_fit_decreasing(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """Bin of each item; `sizes` are in falling order. None if more than `most` bins were needed.

    An item larger than `capacity` gets a bin of its own that takes nothing else.
    """
    tree, opened, out = RoomTree(), 0, []
    for size in sizes:
        found = tree.take(size) if size <= capacity else None
        if found is None:
            if opened == most:
                return None
            found = (max(capacity, size), opened)
            opened += 1
        if found[0] > size:
            tree.add(found[0] - size, found[1])
        out.append(found[1])
    return out


def even_shards(sizes: list[int], shards: int) -> list[int]:
    """Shard of each item; `sizes` are in falling order. The smallest capacity is sought that needs no more than `shards` bins.

    Items larger than an even share of what is left take a shard each. For the others
    the capacity is searched between the even share and that plus the largest item, at
    which best fit always succeeds.
    """
    alone, rest = 0, sum(sizes)
    while alone < min(len(sizes), shards - 1) and sizes[alone] * (shards - alone) > rest:
        rest -= sizes[alone]
        alone += 1
    others = sizes[alone:]
    if not others:
        return list(range(alone))
    bins = shards - alone
    low = max(others[0], -(-rest // bins))
    high = -(-rest // bins) + others[0]
    best = best_fit_decreasing(others, high, bins)
    while low < high:
        middle = (low + high) // 2
        found = best_fit_decreasing(others, middle, bins)
        if found is None:
            low = middle + 1
        else:
            best, high = found, middle
    return [*range(alone), *(alone + b for b in best)]


def _packed(items: DataFrame, cell: Column, place) -> DataFrame:
    """item, cell and bin of each item (item, size); `place` packs the sizes of a cell, in falling order."""

    def pack(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by([("size", "descending"), ("item", "ascending")])
        bins = place(table.column("size").to_pylist())
        number = key[0].as_py() << 32
        yield pa.RecordBatch.from_arrays(
            [table.column("item").combine_chunks(), table.column("size").combine_chunks(), pa.array([number + b for b in bins], pa.int64())],
            names=["item", "size", "bin"],
        )

    return items.withColumn("cell", cell.cast("long")).groupBy("cell").applyInArrow(pack, "item binary, size long, bin long")


def pack_groups(groups: DataFrame, shards: int | None = None, capacity: int | None = None, cell_items: int = CELL_ITEMS, final_items: int = FINAL_ITEMS, parts: int = PARTS) -> DataFrame:
    """(item, shard) for items (item binary, unique; size long, at least 1).

    With `shards`, sizes are as even as best fit makes them; with `capacity`, as few shards
    as best fit needs, an item beyond it alone in one. Give one of the two.
    """
    if (shards is None) == (capacity is None):
        raise ValueError("give shards or capacity")
    now = durable(groups)
    count, total = now.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if shards is not None:
        small = max(1, total // (shards * parts))
        final = lambda sizes: even_shards(sizes, shards)
    else:
        small = max(1, capacity // parts)
        final = lambda sizes: best_fit_decreasing(sizes, capacity)
        # a shard's small bins must all fit in one final task, so the number of final items follows the number of shards
        final_items = max(final_items, 4 * parts * -(-total // capacity))
    steps = []
    while count > final_items:
        cells = -(-count // cell_items)
        packed = durable(_packed(now, F.pmod(F.xxhash64("item"), F.lit(cells)), lambda sizes: best_fit_decreasing(sizes, small)))
        name = F.unhex(F.lpad(F.hex("bin"), 16, "0"))
        steps.append(packed.select("item", name.alias("next")))
        now = durable(packed.groupBy(name.alias("item")).agg(F.sum("size").alias("size")))
        left = now.count()
        if left >= count:
            break
        count = left
    # at most final_items rows: what one task sorts, and small enough to send to all
    out = durable(_packed(now, F.lit(0), final).select("item", F.col("bin").cast("int").alias("shard")))
    for step in reversed(steps):
        out = step.join(out.withColumnRenamed("item", "next"), "next").select("item", "shard")
    return out


def shard_documents(docs: DataFrame, shards: int = 16, cell_items: int = CELL_ITEMS, final_items: int = FINAL_ITEMS) -> DataFrame:
    """Put every row of `docs` (doc_id, text; others are ignored) into one of `shards` shards of about equal bytes.

    Returns doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, shard and slot
    (from 0 in each shard, by doc_id, nulls first). Rows of equal text share a shard; a
    null text is an empty one. A group larger than an even share has a shard for itself. Repeated rows are
    rows of their own. An empty table gives no rows.
    """
    text = F.coalesce(F.encode(F.col("text").cast("string"), "UTF-8"), F.lit(b""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("item"),
    )
    rows = durable(rows.withColumn("_row", F.monotonically_increasing_id()))
    groups = durable(rows.groupBy("item").agg(F.sum("size").alias("size"), F.count("*").alias("n")))
    placed = pack_groups(groups.select("item", "size"), shards=shards, cell_items=cell_items, final_items=final_items)
    placed = durable(groups.join(placed, "item").select("item", "n", "shard"))
    # groups with a thousandth of the rows are at most a thousand, so their shards go to every task
    often = F.col("n") >= max(2, rows.count() // 1000)
    hot = F.broadcast(placed.where(often).select("item", F.col("shard").alias("hot")))
    found = rows.join(hot, "item", "left")
    rest = found.where("hot is null").drop("hot").join(placed.where(~often).select("item", "shard"), "item")
    sharded = rest.unionByName(found.where("hot is not null").withColumnRenamed("hot", "shard")).drop("item")
    ranked = rank_within(sharded, ["shard"], ["doc_id", "_row"], name="slot")
    return ranked.select("doc_id", "size", "text_crc32", "shard", (F.col("slot") - 1).cast("long").alias("slot"))
