"""Prefix trie of conversations: shared beginnings as nodes with counts over their subtrees.

Conversations are sorted by their path, the codes of their turns on end, so that the
members of a node stand together. Splitters drawn from a sample cut the order into
shards. Only a node whose path begins a splitter's path can have members in two shards:
these nodes are the skeleton, the trie of the splitter paths, which every task gets. A
shard walks its sorted conversations once with a stack of open nodes and finishes all
other nodes by itself; of skeleton nodes it sends what it has seen, and these parts are
added up per node and then along the skeleton, which has at most splitters x depth nodes.
"""

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from licspark.session import durable

#: Bytes of a turn's code in a path.
CODE = 16
#: Sampled conversations per shard; splitters are quantiles of the sample.
SAMPLE_PER_SHARD = 32
#: conv_ids in a piece of the list of a skeleton node.
_IDS = 4096

_NODE = "key binary, conv_id long, depth int, parent_key binary, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, chars long, ends_sha256 string"
_PIECE = "kind int, shard int, place long, ids string, " + _NODE
#: Kinds of rows that a shard sends.
_WHOLE, _UNDER_SKELETON, _PART, _ENDS = range(4)


def conversation_paths(turns: DataFrame) -> DataFrame:
    """(conv_id, codes, chars) per conversation of `turns` (conv_id, turn, role, text), by turn with nulls first.

    A code names role and text of a turn, chars are the code points of the text; null
    roles and texts are empty. Turns of equal number are ordered by their codes. Turns without a conv_id belong to no
    conversation and are left out. Only codes are shuffled, not texts.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    coded = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.substring(F.unhex(F.sha2(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), "UTF-8"), 256)), 1, CODE).alias("code"),
        F.length(text).alias("chars"),
    )
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("turn"), F.lit(-(1 << 63))).alias("turn"), F.col("turn").isNotNull().alias("known"), "code", "chars")))
    return coded.groupBy("conv_id").agg(ordered.alias("t")).select("conv_id", F.col("t.code").alias("codes"), F.col("t.chars").alias("chars"))


class _Open:
    """A node on the path of the conversation at hand."""

    __slots__ = ("key", "depth", "chars", "skeleton", "n", "least", "children", "leaves", "saved", "digest", "ids", "waiting")

    def __init__(self, key: bytes, depth: int, chars: int, skeleton: bool):
        self.key, self.depth, self.chars, self.skeleton = key, depth, chars, skeleton
        self.n = self.children = self.leaves = self.saved = 0
        self.least: int | None = None
        self.digest, self.ids, self.waiting = None, [], []


class ShardWalk:
    """Nodes of sorted conversations, one shard after another; rows of _PIECE as tuples."""

    def __init__(self, splitters: list[bytes]):
        self.splitters = splitters
        self.out: list[tuple] = []
        self.stack: list[_Open] = []
        self.shard, self.place = None, 0

    def _on_skeleton(self, key: bytes) -> bool:
        at = bisect_left(self.splitters, key)
        return not key or (at < len(self.splitters) and self.splitters[at].startswith(key))

    def _send_ids(self, node: _Open) -> None:
        ids = ",".join(map(str, node.ids))
        self.out.append((_ENDS, self.shard, self.place, ids, node.key, *[None] * 10))
        self.place += 1
        node.ids = []

    def _close(self) -> None:
        node = self.stack.pop()
        above = self.stack[-1] if self.stack else None
        if above is not None:
            above.n += node.n
            above.least = node.least if above.least is None else min(above.least, node.least)
        if node.skeleton:
            if node.ids:
                self._send_ids(node)
            self.out.append((_PART, self.shard, None, None, node.key, node.least, node.depth, above and above.key, None, node.n, node.children, node.leaves, node.saved, node.chars, None))
            return
        leaves = node.leaves if node.children else 1
        saved = node.saved + (node.n - 1) * node.chars
        ends = (node.digest or hashlib.sha256()).hexdigest()
        for row in node.waiting:
            self.out.append((_WHOLE, self.shard, None, None, None, row[1], row[2], None, node.least, *row[5:]))
        mine = (None, node.least, node.depth, None, None, node.n, node.children, leaves, saved, node.chars, ends)
        above.children += 1
        above.leaves += leaves
        above.saved += saved
        if above.skeleton:
            self.out.append((_UNDER_SKELETON, self.shard, None, None, None, node.least, node.depth, above.key, *mine[4:]))
        else:
            above.waiting.append(mine)

    def end(self) -> None:
        while self.stack:
            self._close()

    def add(self, shard: int, path: bytes, chars: list[int], conv_id: int) -> None:
        if shard != self.shard:
            self.end()
            self.shard, self.place = shard, 0
            self.stack = [_Open(b"", 0, 0, True)]
        while not path.startswith(self.stack[-1].key):
            self._close()
        for depth in range(self.stack[-1].depth + 1, len(chars) + 1):
            key = path[: CODE * depth]
            self.stack.append(_Open(key, depth, chars[depth - 1], self.stack[-1].skeleton and self._on_skeleton(key)))
        node = self.stack[-1]
        node.n += 1
        node.least = conv_id if node.least is None else min(node.least, conv_id)
        if node.skeleton:
            node.ids.append(conv_id)
            if len(node.ids) == _IDS:
                self._send_ids(node)
        else:
            text = str(conv_id).encode()
            if node.digest is None:
                node.digest = hashlib.sha256(text)
            else:
                node.digest.update(b"," + text)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in schema.split(", "))])


def _ends_hashes(ends: DataFrame) -> DataFrame:
    """key and ends_sha256 of the skeleton nodes at which conversations end; the ids pass as a stream, in order."""
    schema = _arrow("key binary, ends_sha256 string")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            done = []
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                if k != key:
                    if key is not None:
                        done.append((key, digest.hexdigest()))
                    key, digest = k, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield _batch(done, schema)
        if key is not None:
            yield _batch([(key, digest.hexdigest())], schema)

    return ends.repartition("key").sortWithinPartitions("key", "shard", "place").select("key", "ids").mapInArrow(work, "key binary, ends_sha256 string")


def prefix_trie(paths: DataFrame) -> DataFrame:
    """A row per node of the trie of `paths` (conv_id, codes, chars).

    conv_id is the smallest member, depth 0 the root; parent_conv_id is the parent's
    conv_id, n_convs the members, n_children and n_leaves the children and the
    childless nodes of the subtree, saved_tokens the sum of (n_convs - 1) x code points
    of the last text over the subtree, ends_sha256 the hash of the conv_ids that end here.
    A conversation without turns ends at the root. Equal conversations share all their
    nodes, however many they are: shards may be cut between them. An empty table gives no
    rows. A conversation's codes are one row (20 bytes a turn), as is a splitter's.
    """
    spark = paths.sparkSession
    rows = durable(paths.select("conv_id", F.coalesce(F.array_join(F.transform("codes", F.hex), ""), F.lit("")).alias("path"), "chars").withColumn("path", F.unhex("path")))
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sample = rows.select("path", "conv_id").orderBy(F.xxhash64("conv_id"), "conv_id").limit(SAMPLE_PER_SHARD * shards).collect()
    sample = sorted((bytes(r.path), r.conv_id) for r in sample)
    splitters = sorted({sample[len(sample) * k // shards] for k in range(1, shards)}) if sample else []
    shared = spark.sparkContext.broadcast(splitters)

    def deal(batches):
        cuts = shared.value
        for batch in batches:
            at = [bisect_right(cuts, (p, c)) for p, c in zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *batch.columns], names=["shard", "conv_id", "path", "chars"])

    pieces = _arrow(_PIECE)

    def walk(batches):
        # a node may have members in two shards if its path begins a splitter's path
        seen = ShardWalk(sorted({path for path, _ in shared.value}))
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("shard", "path", "chars", "conv_id"))):
                seen.add(*row)
                if len(seen.out) >= 8192:
                    yield _batch(seen.out, pieces)
                    seen.out = []
        seen.end()
        yield _batch(seen.out, pieces)

    dealt = rows.mapInArrow(deal, "shard int, conv_id long, path binary, chars array<int>")
    ordered = dealt.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "path", "conv_id")
    found = durable(ordered.mapInArrow(walk, _PIECE))

    parts = found.where(F.col("kind") == _PART).groupBy("key").agg(
        F.min("conv_id").alias("conv_id"),
        F.first("depth").alias("depth"),
        F.first("parent_key").alias("parent_key"),
        F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("closed_children"),
        F.sum("n_leaves").alias("leaves"),
        F.sum("saved").alias("saved"),
        F.first("chars").alias("chars"),
    )
    inner = parts.groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("skeleton_children"))
    parts = durable(parts.join(inner, "key", "left").withColumn("n_children", F.col("closed_children") + F.coalesce("skeleton_children", F.lit(0))))
    # what a skeleton node adds to itself and to every node above it
    own = parts.select(
        F.explode(F.transform(F.sequence(F.lit(0), "depth"), lambda d: F.substring("key", F.lit(1), d * CODE))).alias("key"),
        (F.col("leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("n_leaves"),
        (F.col("saved") + (F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"),
    )
    sums = own.groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    ends = _ends_hashes(found.where(F.col("kind") == _ENDS))
    nothing = F.lit(hashlib.sha256().hexdigest())
    names = durable(parts.select("key", F.col("conv_id").alias("parent_conv_id")))
    skeleton = parts.drop("leaves").join(sums, "key").join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nothing))
    parents = names.withColumnRenamed("key", "parent_key")
    columns = ["conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    skeleton = skeleton.join(parents, "parent_key", "left").select(columns)
    other = found.withColumnRenamed("saved", "saved_tokens")
    whole = other.where(F.col("kind") == _WHOLE).select(columns)
    # the skeleton's names: splitters x depth rows at most
    under = other.where(F.col("kind") == _UNDER_SKELETON).drop("parent_conv_id").join(F.broadcast(parents), "parent_key").select(columns)
    return whole.unionByName(under).unionByName(skeleton)


def rejoined(paths: DataFrame, every: int, own_after) -> DataFrame:
    """Let conversations begin with turns of another one: the first h turns of conversation c - c % every, then the own turns after the first h.

    `own_after` is h as a column of conv_id. Without that conversation nothing stands in their place.
    """
    heads = paths.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("head"), F.col("codes").alias("head_codes"), F.col("chars").alias("head_chars"))
    both = paths.withColumn("h", own_after.cast("int")).withColumn("head", F.col("conv_id") - F.col("conv_id") % every).join(heads, "head", "left")

    def mixed(name: str, kind: str):
        first = F.coalesce(F.slice(f"head_{name}", F.lit(1), F.col("h")), F.array().cast(f"array<{kind}>"))
        rest = F.slice(name, F.col("h") + 1, F.greatest(F.size(name) - F.col("h"), F.lit(0)))
        return F.concat(first, rest).alias(name)

    return both.select("conv_id", mixed("codes", "binary"), mixed("chars", "int"))
