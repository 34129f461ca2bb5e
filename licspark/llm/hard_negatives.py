"""Hard negatives for contrastive training, found by coordinate pruning in buckets of similar length.

Vectors become integers and are dealt to buckets by length, longest first. A bucket keeps
one sorted list of values per coordinate, of vectors scaled to length one. To find the
rows whose inner product with an anchor is at least some threshold, the threshold is
divided by the anchor's length and the bucket's largest length: t. A row can only reach
it if its angle to the anchor is at most arccos(t), so the row's value in each coordinate
must lie in a range around the anchor's. The ranges of the anchor's largest coordinates
(its focus) are looked up in the sorted lists and intersected; only rows in all of them
are multiplied. Buckets and blocks of anchors that cannot reach a threshold never meet.

Thresholds come from a first look at the bucket of the longest rows; they only save work
and never change a result.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from licspark.operators.ranking import first_per_group
from licspark.session import durable

#: Rows of a bucket, and anchors of a block, on average.
BUCKET_ROWS = 4096
BLOCK_ANCHORS = 1024
#: Coordinates of an anchor whose feasible ranges are intersected.
FOCUS = 4
#: From this share of a bucket on, candidates are multiplied with the whole bucket instead of one by one.
_DENSE = 0.25
_SLACK = 1e-9
_LIMIT = float(1 << 28)


class Bucket:
    """Rows of similar length with a sorted list of values per coordinate."""

    def __init__(self, vectors: np.ndarray, lengths: np.ndarray):
        self.vectors, self.longest = vectors, float(lengths.max(initial=0.0))
        unit = vectors / np.maximum(lengths, 1.0)[:, None]
        self.order = np.argsort(unit, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(unit.T, self.order, axis=1)
        self.unit = unit

    def candidates(self, anchor: np.ndarray, length: float, threshold: float) -> np.ndarray | None:
        """Rows that may have an inner product of at least `threshold` with the anchor; None stands for all."""
        if threshold <= 0:
            return None
        most = length * self.longest
        if most <= 0 or threshold > most * (1 + _SLACK):
            return np.zeros(0, np.int64)
        reach = np.arccos(min(1.0, threshold / most)) + _SLACK
        scaled = anchor / length
        focus = np.argsort(-np.abs(scaled), kind="stable")[:FOCUS]
        angles = np.arccos(np.clip(scaled[focus], -1, 1))
        low, high = np.cos(np.minimum(np.pi, angles + reach)) - _SLACK, np.cos(np.maximum(0.0, angles - reach)) + _SLACK
        spans = [(np.searchsorted(self.values[f], a), np.searchsorted(self.values[f], b, "right")) for f, a, b in zip(focus, low, high)]
        first = min(range(len(focus)), key=lambda k: spans[k][1] - spans[k][0])
        found = self.order[focus[first]][spans[first][0] : spans[first][1]]
        if len(found) == len(self.vectors):
            return None
        for k, f in enumerate(focus):
            if k != first:
                value = self.unit[found, f]
                found = found[(value >= low[k]) & (value <= high[k])]
        return found

    def scores(self, anchor: np.ndarray, length: float, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(rows, exact inner products) of all rows that reach the threshold."""
        threshold -= abs(threshold) * 1e-12  # integers beyond 2^53 may have been rounded up
        found = self.candidates(anchor, length, threshold)
        if found is None:
            found, score = np.arange(len(self.vectors)), self.vectors @ anchor
        elif len(found) > _DENSE * len(self.vectors):
            score = (self.vectors @ anchor)[found]
        else:
            score = self.vectors[found] @ anchor
        enough = score >= threshold
        return found[enough], score[enough].astype(np.int64)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of a matrix, shorter ones filled with zeros; as doubles where products stay exact in them."""
    flat = column.combine_chunks()
    counts = np.diff(flat.offsets.to_numpy())
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(counts), width), np.int64)
    at = np.repeat(np.arange(len(counts)), counts)
    out[at, np.arange(len(values)) - np.repeat(np.cumsum(counts) - counts, counts)] = values
    return out


def _joined(rows: pa.Table, anchors: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    width = max([1, *(int(np.diff(t.column("q").combine_chunks().offsets.to_numpy()).max(initial=0)) for t in (rows, anchors))])
    a, b = _matrix(rows.column("q"), width), _matrix(anchors.column("q"), width)
    if width * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < 2**53:
        a, b = a.astype(np.float64), b.astype(np.float64)
    return a, b


def _first(ids: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
    """Positions of the first n: higher scores first, then smaller ids."""
    if len(scores) > 4 * n:
        least = np.partition(scores, len(scores) - n)[len(scores) - n]
        some = np.flatnonzero(scores >= least)
        return some[np.lexsort((ids[some], -scores[some]))[:n]]
    return np.lexsort((ids, -scores))[:n]


def _meet(index: DataFrame, anchors: DataFrame, work, schema: str) -> DataFrame:
    """Let each bucket meet every block of anchors that may reach its threshold there; their numbers, not their rows, are paired."""
    buckets = index.groupBy("bucket").agg(F.max("length").alias("longest"))
    last = buckets.agg(F.max("bucket").alias("last")).scalar()
    blocks = anchors.groupBy("block").agg(F.max("length").alias("anchor_longest"), F.min("threshold").alias("least"))
    pairs = blocks.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.coalesce(last, F.lit(0))))).join(buckets, "bucket")
    reached = (F.col("least") <= 0) | (F.col("longest") * F.col("anchor_longest") * (1 + _SLACK) >= F.col("least"))
    pairs = pairs.where(reached)
    rows = index.join(pairs.select("bucket", F.col("block").alias("to_block")), "bucket")
    sought = anchors.join(pairs.select(F.col("block").alias("of_block"), F.col("bucket").alias("to_bucket")), F.col("block") == F.col("of_block"))
    return rows.groupBy("bucket", "to_block").cogroup(sought.groupBy("to_bucket", "of_block")).applyInArrow(work, schema)


def _positives(n: int):
    """Work on a bucket and a block: for every anchor the first `n` other rows of its label."""

    def work(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        vectors, queries = _joined(rows, anchors)
        bucket = Bucket(vectors, rows.column("length").to_numpy())
        uids, ids, labels = (rows.column(c).to_numpy() for c in ("uid", "vec_id", "label"))
        out = [[], [], [], []]
        for anchor, uid, label, length, threshold in zip(queries, *(anchors.column(c).to_pylist() for c in ("uid", "label", "length", "threshold"))):
            found, score = bucket.scores(anchor, length, threshold)
            same = (labels[found] == label) & (uids[found] != uid)
            found, score = found[same], score[same]
            best = _first(ids[found], score, n)
            for column, values in zip(out, ([uid] * len(best), uids[found][best], ids[found][best], score[best])):
                column.append(np.asarray(values, np.int64))
        return pa.table({k: np.concatenate([np.zeros(0, np.int64), *v]) for k, v in zip(("anchor", "positive", "positive_id", "score"), out)})

    return work, "anchor long, positive long, positive_id long, score long"


def _negatives(n: int):
    """Work on a bucket and a block: for every anchor and positive the first `n` rows of other labels between two scores.

    An anchor's row has lists with one entry per positive: lowest and highest score, and the threshold of the first look.
    """

    def work(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        vectors, queries = _joined(rows, anchors)
        bucket = Bucket(vectors, rows.column("length").to_numpy())
        ids, labels = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
        out = [[], [], [], []]
        names = ("uid", "label", "length", "threshold", "positives")
        for anchor, uid, label, length, threshold, wanted in zip(queries, *(anchors.column(c).to_pylist() for c in names)):
            found, score = bucket.scores(anchor, length, threshold)
            top = max(p["highest"] for p in wanted)
            other = (labels[found] != label) & (score <= top)
            found, score = ids[found[other]], score[other]
            order = np.lexsort((found, -score))
            found, score = found[order], score[order]
            for p in wanted:
                start = int(np.searchsorted(-score, -p["highest"]))
                end = min(start + n, int(np.searchsorted(-score, -max(p["lowest"], p["least"]), "right")))
                if start < end:
                    size = end - start
                    for column, values in zip(out, (np.full(size, uid), np.full(size, p["positive"]), found[start:end], score[start:end])):
                        column.append(values.astype(np.int64))
        return pa.table({k: np.concatenate([np.zeros(0, np.int64), *v]) for k, v in zip(("anchor", "positive", "negative_id", "score"), out)})

    return work, "anchor long, positive long, negative_id long, score long"


def _prepared(rows: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, q (integers) and length of the rows that take part."""
    vector = F.col("embedding").cast("array<double>")
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    used = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(whole, F.lit(False)))
    scaled = F.transform(vector, lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(_LIMIT)), F.lit(-_LIMIT))))
    used = used.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), scaled.alias("q"))
    return used.withColumn("length", F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x)))


def length_buckets(rows: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """`rows` (with a length) with `uid` and `bucket`: ranges of length of about `bucket_rows` rows, longest first.

    Rows of equal length are told apart by a hash, so many copies of one vector spread over buckets.
    """
    staged = durable(rows.withColumn("uid", F.monotonically_increasing_id()))
    buckets = max(1, -(-staged.count() // bucket_rows))
    dealt = staged.repartitionByRange(buckets, F.desc("length"), F.xxhash64("uid")) if buckets > 1 else staged.repartition(1)
    return durable(dealt.withColumn("bucket", F.spark_partition_id()))


def hard_negatives(
    rows: DataFrame,
    anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    low_percent: int = 30,
    high_percent: int = 90,
    scale: int = 256,
    bucket_rows: int = BUCKET_ROWS,
    block_anchors: int = BLOCK_ANCHORS,
) -> DataFrame:
    """Hard negatives of every anchor among all rows of `rows` (vec_id, label, embedding; others are ignored).

    Components become floor(scale * x); scores are integer inner products. Higher scores
    come first, ties by smaller vec_id. `anchor` is a condition on vec_id. An anchor's
    positives are its first `positives` other rows of the same label. For each of them
    the first `negatives` rows of other labels are returned whose score lies between
    `low_percent` and `high_percent` of the positive's: anchor_id, positive_id, rank
    (from 1), negative_id, positive_score, negative_score.

    Rows without vec_id, label or vector, or with a null or non-finite component, take no
    part. Shorter vectors count as filled with zeros. Repeated rows are rows of their
    own, so a copy of an anchor is another row, and a repeated anchor gives its
    rows again. A positive score below zero leaves an empty range, and zero admits zero
    only. An empty table gives no rows. Integers beyond 2^28 are held to that bound, so
    that scores stay in 64 bits.
    """
    index = length_buckets(_prepared(rows, scale), bucket_rows)
    found = index.where(anchor)
    blocks = max(1, -(-found.count() // block_anchors))
    anchors = durable(found.select("uid", "vec_id", "label", "q", "length", F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int").alias("block")))
    longest = F.col("bucket") == 0
    by_score = ["down", "id", "row"]  # down is the score below zero, so that all three rise

    # positives: a first look at the longest rows gives thresholds, then all buckets that can reach them
    work, schema = _positives(positives)
    blind = anchors.withColumn("threshold", F.lit(float("-inf")))
    look = _meet(index.where(longest), blind, work, schema)
    bound = look.groupBy(F.col("anchor").alias("uid")).agg(F.count("*").alias("n"), F.min("score").alias("worst"))
    known = F.when(F.col("n") >= positives, F.col("worst").cast("double")).otherwise(F.lit(float("-inf")))
    sought = durable(anchors.join(bound, "uid", "left").withColumn("threshold", F.coalesce(known, F.lit(float("-inf")))).drop("n", "worst"))
    best = _meet(index, sought, work, schema)
    best = durable(first_per_group(best.select("anchor", F.col("positive").alias("row"), F.col("positive_id").alias("id"), "score", (-F.col("score")).alias("down")), ["anchor"], by_score, positives))

    # negatives: a range of scores per positive, and again a first look
    score = F.col("score")
    # 100 * negative >= low * positive and 100 * negative <= high * positive, in integers
    lowest = -F.floor(-low_percent * score.cast("decimal(20,0)") / 100)
    highest = F.floor(high_percent * score.cast("decimal(20,0)") / 100)
    ranges = best.select("anchor", F.col("row").alias("positive"), lowest.cast("long").alias("lowest"), highest.cast("long").alias("highest"))
    ranges = ranges.where("lowest <= highest")
    work, schema = _negatives(negatives)

    def with_ranges(ranges: DataFrame) -> DataFrame:
        wanted = ranges.groupBy(F.col("anchor").alias("uid")).agg(
            F.collect_list(F.struct("positive", "lowest", "highest", "least")).alias("positives"), F.min(F.greatest("lowest", "least")).cast("double").alias("threshold")
        )
        return anchors.join(wanted, "uid")

    blind = durable(with_ranges(ranges.withColumn("least", F.col("lowest"))))
    look = _meet(index.where(longest), blind, work, schema)
    bound = look.groupBy("anchor", "positive").agg(F.count("*").alias("n"), F.min("score").alias("worst"))
    least = F.when(F.col("n") >= negatives, F.col("worst")).otherwise(F.col("lowest"))
    sought = durable(with_ranges(ranges.join(bound, ["anchor", "positive"], "left").withColumn("least", F.coalesce(least, "lowest")).drop("n", "worst")))
    hard = _meet(index, sought, work, schema)
    hard = first_per_group(hard.select("anchor", "positive", F.col("negative_id").alias("id"), "score", (-F.col("score")).alias("down"), F.lit(0).alias("row")), ["anchor", "positive"], by_score, negatives)
    hard = hard.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "positive").orderBy(*by_score)))
    names = anchors.select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    scored = best.select("anchor", F.col("row").alias("positive"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = hard.join(scored, ["anchor", "positive"]).join(names, "anchor")
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
