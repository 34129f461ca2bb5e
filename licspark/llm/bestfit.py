"""Conflict-constrained best-fit packing of documents into bins of fixed capacity.

Documents are dealt by hash to groups of about GROUP_ROWS rows, and each group is packed
by one task: largest first, into the bin with the least room left that fits and that
holds no document of the same source and none of the same duplicate cluster. Bins are
kept ordered by the room left; from the first that is large enough the search goes on
to the next until one is compatible, and only then a new bin is opened.
"""

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from licspark.llm import textops
from licspark.llm.ngram_jaccard import WORDS, _fixed_binary, _set_ids, ngram_jaccard_classes
from licspark.session import durable

#: Words in a bin.
CAPACITY = 2048
#: Expected rows of a group; the fill of bins hardly depends on it.
GROUP_ROWS = 4096


def _measured(docs: DataFrame, near: bool) -> DataFrame:
    """doc_id, source, cluster, n_words and place (a number of the row) per row; with `near` the cluster is the id of the text's n-gram set."""

    def work(batches):
        from pyspark import TaskContext

        place = TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, end, data, offsets in textops.slices(batch.column("text")):
                starts, ends, bounds = textops.words(data, offsets)
                rows = end - first
                cluster = batch.column("cluster").slice(first, rows)
                if near:
                    grams = textops.run_hashes(textops.span_hashes(data, starts, ends, textops.LOWER_CODES), bounds, WORDS)
                    cluster = _fixed_binary(_set_ids(*textops.sorted_sets(*grams)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, rows),
                        batch.column("source").slice(first, rows),
                        cluster,
                        pa.array(np.diff(bounds)),
                        pa.array(np.arange(place, place + rows)),
                    ],
                    names=["doc_id", "source", "cluster", "n_words", "place"],
                )
                place += rows

    return docs.mapInArrow(work, "doc_id long, source string, cluster binary, n_words long, place long")


def _near_clusters(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """`rows` with the component of near duplicates in place of the set id; a set that links with no other is its own."""
    classes = ngram_jaccard_classes(docs).where("group_id <> set_id").select("set_id", "group_id", "n_copies")
    linked = durable(classes.groupBy("set_id").agg(F.first("group_id").alias("group_id"), F.first("n_copies").alias("n_copies")))
    # as in ngram_jaccard_classes: sets with many rows are few, and broadcast
    often = F.col("n_copies") >= F.lit(max(1000, rows.count() // 1000))
    hot = F.broadcast(linked.where(often).select(F.col("set_id").alias("cluster"), F.col("group_id").alias("hot_id")))
    rest = linked.where(~often).select(F.col("set_id").alias("cluster"), "group_id")
    found = rows.join(hot, "cluster", "left")
    kept = found.where("hot_id is null").drop("hot_id").join(rest, "cluster", "left").withColumn("cluster", F.coalesce("group_id", "cluster")).drop("group_id")
    return kept.unionByName(found.where("hot_id is not null").withColumn("cluster", F.col("hot_id")).drop("hot_id"))


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int]]:
    """(bin, place in it) of each item, in the given order of items; sizes are at most `capacity`.

    Sources and clusters are bits of two bitmaps per bin; a null source or cluster conflicts with nothing.
    """
    source_bit = {s: 1 << k for k, s in enumerate(dict.fromkeys(s for s in sources if s is not None))}
    cluster_bit = {c: 1 << k for k, (c, n) in enumerate((c, n) for c, n in Counter(clusters).items() if n > 1 and c is not None)}
    room: list[tuple[int, int]] = []
    source_map: list[int] = []
    cluster_map: list[int] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters):
        s, c = source_bit.get(source, 0), cluster_bit.get(cluster, 0)
        at = bisect_left(room, (size, 0))
        while at < len(room) and (source_map[room[at][1]] & s or cluster_map[room[at][1]] & c):
            at += 1
        if at < len(room):
            left, number = room.pop(at)
        else:
            left, number = capacity, len(source_map)
            source_map.append(0)
            cluster_map.append(0)
        source_map[number] |= s
        cluster_map[number] |= c
        out.append((number, capacity - left))
        insort(room, (left - size, number))
    return out


def best_fit_packing(docs: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, cluster: str | None = None) -> DataFrame:
    """Pack all rows of `docs` (doc_id, text, source; others are ignored) into bins of `capacity` words.

    Returns a row per piece: doc_id, piece (0, 1, ...), n_words, bin_id and position (words
    before it in the bin). A document longer than a bin is cut into full bins and a rest
    that is packed. Two documents of one source, or of one cluster, never share a bin.
    Clusters are the values of the column `cluster`, or without it the components of near
    duplicates (ngram_jaccard_classes). A null source or cluster conflicts with nothing; a document without words has one piece and
    a null bin. The largest come first, ties by doc_id and the place of the row. Repeated
    rows are packed as copies. An empty table gives no rows.
    """
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        (F.col(cluster) if cluster else F.lit(None)).cast("string").cast("binary").alias("cluster"),
        F.col("text").cast("string").alias("text"),
    )
    rows = durable(_measured(texts, cluster is None))
    if cluster is None:
        rows = durable(_near_clusters(rows, texts))
    last = F.greatest(F.ceil(F.col("n_words") / capacity) - 1, F.lit(0)).cast("long")
    pieces = rows.withColumn("last", last).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    pieces = pieces.withColumn("size", F.when(F.col("piece") < F.col("last"), F.lit(capacity)).otherwise(F.col("n_words") - F.col("last") * capacity).cast("long"))
    groups = max(1, -(-rows.count() // group_rows))
    # rows without an id are dealt by their place, so that they do not meet in one group
    dealt = F.pmod(F.xxhash64(F.coalesce("doc_id", "place"), "piece"), F.lit(groups)).cast("long")

    def pack(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by([("size", "descending"), ("doc_id", "ascending"), ("place", "ascending"), ("piece", "ascending")])
        placed = best_fit(*(table.column(c).to_pylist() for c in ("size", "source", "cluster")), capacity)
        number = key[0].as_py() << 32
        yield pa.RecordBatch.from_arrays(
            [
                *(table.column(c).combine_chunks() for c in ("doc_id", "piece", "size")),
                pa.array([number + b for b, _ in placed], pa.int64()),
                pa.array([p for _, p in placed], pa.int64()),
            ],
            names=["doc_id", "piece", "n_words", "bin_id", "position"],
        )

    schema = "doc_id long, piece long, n_words long, bin_id long, position long"
    some = pieces.where("size > 0").withColumn("group", dealt).select("group", "doc_id", "source", "cluster", "place", "piece", "size")
    packed = some.groupBy("group").applyInArrow(pack, schema)
    nulls = F.lit(None).cast("long")
    return packed.unionByName(rows.where("n_words = 0").select("doc_id", F.lit(0).cast("long").alias("piece"), "n_words", nulls.alias("bin_id"), nulls.alias("position")))
