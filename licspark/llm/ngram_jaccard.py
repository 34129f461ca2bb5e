"""Similarity join of documents on their sets of word n-grams, as a blocked sparse matrix product.

Rows of the matrix are distinct n-gram sets (documents with equal sets are one row),
columns are n-grams, dealt to column blocks by hash. Two rows link when their Jaccard
similarity reaches the threshold t. All work is in Spark tasks:

1. Column blocks count in how many rows each n-gram stands. A row of n n-grams can
   link only if t * n of them stand in other rows too; the rest is dropped.
2. The rows left are read again in full, and their n-grams counted exactly. In the
   order of (count, hash), a link shows in the first `n - ceil(t * n) + 1` n-grams of
   both rows and in the first `n - ceil(2t / (1 + t) * n) + 1` of the smaller one. Rows
   that meet there, and whose sizes allow a link, are joined to candidate groups.
3. Rows of a candidate group are dealt to row blocks, and each pair of row blocks of a
   group is multiplied: overlap counts are accumulated, pairs below the bound
   `t / (1 + t) * (|a| + |b|)` are dropped, and only link counts and a spanning forest
   of the links leave the task. No pair of rows is ever a Spark row.

Cost follows the texts, but for groups of g different sets with common rare n-grams,
whose g * g overlaps are counted (in blocks), since each may be a link.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from licspark.llm import textops
from licspark.llm.chunks import ranges
from licspark.llm.components import components
from licspark.session import durable

WORDS = 5
PERCENT = 75
#: Rows of a block; a block pair holds BLOCK_ROWS ** 2 counts.
BLOCK_ROWS = 768
_COMMON = 24


def _sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, n-gram hashes sorted and distinct within each text, bounds) for groups of rows."""
    for first, _, data, offsets in textops.slices(column):
        starts, ends, bounds = textops.words(data, offsets)
        grams, gram_bounds = textops.run_hashes(textops.span_hashes(data, starts, ends, textops.LOWER_CODES), bounds, n)
        yield first, *textops.sorted_sets(grams, gram_bounds)


def _set_ids(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """128 bits per set, as an (n, 2) uint64 array."""
    sizes = np.diff(bounds).astype(np.uint64)
    halves = [textops.mixed(textops.sums_by(textops.mixed(grams ^ np.uint64(salt)), bounds) + sizes) for salt in (0x1234567, 0xABCDEF01)]
    return np.ascontiguousarray(np.stack(halves, axis=1))


def _fixed_binary(rows: np.ndarray) -> pa.Array:
    """One binary value per row of a 2-d uint64 array."""
    width = rows.shape[1] * 8
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())


def _set_rows(texts: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, set_id (16 bytes) and key (the first 8 of them as a number) per row."""

    def work(batches):
        for batch in batches:
            sizes, ids = [np.zeros(0, np.int64)], [np.zeros((0, 2), np.uint64)]
            for _, grams, bounds in _sets(batch.column("text"), n):
                sizes.append(np.diff(bounds))
                ids.append(_set_ids(grams, bounds))
            ids = np.concatenate(ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.concatenate(sizes)), _fixed_binary(ids), pa.array(ids[:, 0].copy().view(np.int64))],
                names=["doc_id", "n_shingles", "set_id", "key"],
            )

    return texts.mapInArrow(work, "doc_id long, n_shingles long, set_id binary, key long")


def _sizes_fit(small: np.ndarray, large: np.ndarray, percent: int) -> np.ndarray:
    return 100 * small >= percent * large


def _ceil_div(a, b):
    return -(-a // b)


def _forest(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Smallest connected index of each of `size` nodes under the edges (a, b)."""
    root = np.arange(size)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == before).all():
            return root


_HEAD = np.dtype([("key", "<u8"), ("size", "<u4"), ("grams", "<u4")])
_PACKED = "block int, rows binary, grams binary"


def _blocks_of(grams: np.ndarray, blocks: int) -> np.ndarray:
    return ((grams >> np.uint64(33)) % np.uint64(blocks)).astype(np.int64)


def _packed(keys: np.ndarray, sizes: np.ndarray, row: np.ndarray, block: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """Entries (row, block, 32-bit value), rows ascending, packed per block: heads (key, size, number of values) and values."""
    order = np.argsort(block * max(1, len(keys)) + row, kind="stable")
    row, block, values = row[order], block[order], values[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (block[1:] != block[:-1])
    heads = np.flatnonzero(new)
    head = np.zeros(len(heads), _HEAD)
    head["key"], head["size"] = keys[row[heads]], np.minimum(sizes[row[heads]], 0xFFFFFFFF)
    gram_at = np.append(heads, len(row))
    head["grams"] = np.diff(gram_at)
    block = block[heads]
    cuts = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(heads) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(heads))[: len(cuts)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(block[cuts].astype(np.int32)),
            pa.array([head[i:j].tobytes() for i, j in zip(cuts, ends)], pa.binary()),
            pa.array([values[gram_at[i] : gram_at[j]].tobytes() for i, j in zip(cuts, ends)], pa.binary()),
        ],
        names=["block", "rows", "grams"],
    )


def _unpacked(batches) -> tuple[np.ndarray, np.ndarray]:
    heads, values = [np.zeros(0, _HEAD)], [np.zeros(0, "<u4")]
    for batch in batches:
        heads += [np.frombuffer(x.as_py(), _HEAD) for x in batch.column("rows")]
        values += [np.frombuffer(x.as_py(), "<u4") for x in batch.column("grams")]
    return np.concatenate(heads), np.concatenate(values)


def _all_columns(texts: DataFrame, n: int, blocks: int) -> DataFrame:
    """Every n-gram of every distinct set of a slice, packed per column block."""

    def work(batches):
        for batch in batches:
            for _, grams, bounds in _sets(batch.column("text"), n):
                sizes = np.diff(bounds)
                keys = _set_ids(grams, bounds)[:, 0]
                _, firsts = np.unique(keys, return_index=True)
                some = np.zeros(len(keys), bool)
                some[firsts] = sizes[firsts] > 0
                inside = np.repeat(some, sizes)
                row = np.repeat(np.cumsum(some) - 1, sizes)[inside]
                grams = grams[inside]
                yield _packed(keys[some], sizes[some], row, _blocks_of(grams, blocks), grams.astype(np.uint32))

    return texts.mapInArrow(work, _PACKED)


def _likely_rows(columns: DataFrame, percent: int, parts: int) -> DataFrame:
    """Keys of the sets that share enough n-grams with other sets to link with any of them."""

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, gram = _unpacked(batches)
        keys, first, code = np.unique(head["key"], return_index=True, return_inverse=True)
        # copies of a set in several tasks are one row
        entries = np.sort((gram.astype(np.uint64) << np.uint64(32)) | np.repeat(code, head["grams"]).astype(np.uint64))
        entries = entries[np.append(True, entries[1:] != entries[:-1])] if len(entries) else entries
        gram, code = entries >> np.uint64(32), (entries & np.uint64(0xFFFFFFFF)).astype(np.int64)
        common = np.zeros(len(gram), bool)
        common[1:] = gram[1:] == gram[:-1]
        common[:-1] |= common[1:]
        out = np.zeros(len(keys), [("key", "<u8"), ("size", "<u4"), ("common", "<u4")])
        out["key"], out["size"], out["common"] = keys, head["size"][first], np.bincount(code[common], minlength=len(keys))
        part = keys.view(np.int64) % parts
        order = np.argsort(part, kind="stable")
        out, part = out[order], part[order]
        cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
        blobs = [out[i:j].tobytes() for i, j in zip(cuts, np.append(cuts[1:], len(part)))]
        yield pa.RecordBatch.from_arrays([pa.array(part[cuts].astype(np.int32)), pa.array(blobs, pa.binary())], names=["part", "shared"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.frombuffer(x.as_py(), [("key", "<u8"), ("size", "<u4"), ("common", "<u4")]) for batch in batches for x in batch.column("shared")]
        rows = np.concatenate(found)
        keys, first, code = np.unique(rows["key"], return_index=True, return_inverse=True)
        common = np.bincount(code, rows["common"], len(keys)).astype(np.int64)
        kept = keys[100 * common >= percent * rows["size"][first].astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(kept.view(np.int64))], names=["key"])

    shared = columns.groupBy("block").applyInArrow(share, "part int, shared binary")
    return shared.groupBy("part").applyInArrow(judge, "key long")


_PLACE = np.dtype([("key", "<u8"), ("rest", "<u8"), ("block", "<u4"), ("grams", "<u4")])


def _frequencies(matrix: DataFrame, blocks: int, parts: int) -> DataFrame:
    """For each part of the rows, per row and column block: in how many rows each of its n-grams stands (255: or more)."""

    def send(batches):
        for batch in batches:
            ids = np.frombuffer(b"".join(batch.column("set_id").to_pylist()), "<u8").reshape(-1, 2)
            lists = [np.frombuffer(x.as_py(), "<u8") for x in batch.column("grams")]
            sizes = np.array([len(x) for x in lists], np.int64)
            grams = np.concatenate([np.zeros(0, np.uint64), *lists])
            sent = _packed(np.arange(len(ids), dtype=np.uint64), sizes, np.repeat(np.arange(len(ids)), sizes), _blocks_of(grams, blocks), grams.astype(np.uint32))
            places = []
            for block, rows in zip(sent.column("block").to_pylist(), sent.column("rows").to_pylist()):
                head = np.frombuffer(rows, _HEAD)
                place = np.zeros(len(head), _PLACE)
                place["key"], place["rest"] = ids[head["key"].astype(np.int64)].T
                place["block"], place["grams"] = block, head["grams"]
                places.append(place.tobytes())
            yield pa.RecordBatch.from_arrays([sent.column("block"), pa.array(places, pa.binary()), sent.column("grams")], names=["block", "rows", "grams"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, grams = [np.zeros(0, _PLACE)], [np.zeros(0, "<u4")]
        for batch in batches:
            places += [np.frombuffer(x.as_py(), _PLACE) for x in batch.column("rows")]
            grams += [np.frombuffer(x.as_py(), "<u4") for x in batch.column("grams")]
        place, gram = np.concatenate(places), np.concatenate(grams)
        _, code, n = np.unique(gram, return_inverse=True, return_counts=True)
        times = np.minimum(n, 255).astype(np.uint8)[code]
        at = np.append(0, np.cumsum(place["grams"], dtype=np.int64))
        part = place["key"].view(np.int64) % parts if len(place) else np.zeros(0, np.int64)
        order = np.argsort(part, kind="stable")
        names = np.unique(part)
        cuts = np.searchsorted(part[order], names)
        groups = [order[i:j] for i, j in zip(cuts, np.append(cuts[1:], len(order)))]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(names.astype(np.int32)),
                pa.array([place[g].tobytes() for g in groups], pa.binary()),
                pa.array([times[ranges(at[g], place["grams"][g].astype(np.int64))].tobytes() for g in groups], pa.binary()),
            ],
            names=["part", "rows", "times"],
        )

    packed = matrix.select("set_id", "grams").mapInArrow(send, _PACKED)
    return packed.groupBy("block").applyInArrow(count, "part int, rows binary, times binary")


def _postings(matrix: DataFrame, percent: int, blocks: int, parts: int) -> DataFrame:
    """Deciding n-grams of the rows, packed per column block; the lowest bit tells whether one is in the shorter prefix."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"block": pa.array([], pa.int32()), "rows": pa.array([], pa.binary()), "grams": pa.array([], pa.binary())})
        ids = np.frombuffer(b"".join(left.column("set_id").to_pylist()), "<u8").reshape(-1, 2)
        lists = [np.frombuffer(x.as_py(), "<u8") for x in left.column("grams")]
        sizes = np.array([len(x) for x in lists], np.int64)
        row, grams = np.repeat(np.arange(len(ids)), sizes), np.concatenate(lists)
        block = _blocks_of(grams, blocks)
        order = np.argsort(row * blocks + block, kind="stable")
        # the counts came back per (row, block), each in the order of the n-grams
        place = np.concatenate([np.frombuffer(x.as_py(), _PLACE) for x in right.column("rows")])
        sent = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in right.column("times")])
        at = np.append(0, np.cumsum(place["grams"], dtype=np.int64))
        name = np.zeros(len(ids), [("key", "<u8"), ("rest", "<u8")])
        name["key"], name["rest"] = ids.T
        by_name = np.argsort(name)
        of = by_name[np.searchsorted(name[by_name], place[["key", "rest"]].astype(name.dtype))]
        turn = np.lexsort((place["block"], of))
        times = np.zeros(len(grams), np.uint8)
        times[order] = sent[ranges(at[turn], place["grams"][turn].astype(np.int64))]
        need = _ceil_div(percent * sizes, 100)
        core = _ceil_div(2 * percent * sizes, 100 + percent)
        alive = np.bincount(row, times > 1, len(ids)) >= need
        order = np.argsort(row * 256 + times, kind="stable")
        rank = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        inside = np.repeat(alive, sizes) & (rank < np.repeat(sizes - need + 1, sizes))
        flag = (rank < np.repeat(sizes - core + 1, sizes))[inside]
        chosen, kept = grams[order][inside], row[inside]
        values = (chosen.astype(np.uint32) & np.uint32(0xFFFFFFFE)) | flag.astype(np.uint32)
        return pa.Table.from_batches([_packed(ids[:, 0], sizes, kept, _blocks_of(chosen, blocks), values)])

    part = F.pmod("key", F.lit(parts)).cast("int").alias("part")
    rows = matrix.select(part, "set_id", "grams").groupBy("part")
    return rows.cogroup(_frequencies(matrix, blocks, parts).groupBy("part")).applyInArrow(work, _PACKED)


def _meetings(postings: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between set keys that share a deciding n-gram and whose sizes allow a link, as stars."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, gram = _unpacked(batches)
        key, size = np.repeat(head["key"], head["grams"]), np.repeat(head["size"], head["grams"]).astype(np.int64)
        core, gram = (gram & np.uint32(1)).astype(bool), gram >> np.uint32(1)
        order = np.lexsort((key, size, gram))
        key, size, core, gram = key[order], size[order], core[order], gram[order]
        # copies of a set in several tasks are one row
        once = np.ones(len(key), bool)
        once[1:] = (key[1:] != key[:-1]) | (gram[1:] != gram[:-1])
        key, size, core, gram = key[once], size[once], core[once], gram[once]
        fits = np.zeros(len(key), bool)
        fits[1:] = (gram[1:] == gram[:-1]) & _sizes_fit(size[:-1], size[1:], percent)
        chain = np.cumsum(~fits)
        # a chain without any gram of a shorter prefix holds no link
        alive = np.zeros(chain[-1] + 1 if len(chain) else 1, bool)
        alive[chain[core]] = True
        at = np.flatnonzero(fits & alive[chain])
        names, code = np.unique(np.concatenate([key[at - 1], key[at]]), return_inverse=True)
        root = _forest(code[: len(at)], code[len(at) :], len(names))
        off = np.flatnonzero(root != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(names[root[off]].view(np.int64)), pa.array(names[off].view(np.int64))], names=["a", "b"]
        )

    return postings.groupBy("block").applyInArrow(work, "a long, b long")


def _overlaps(grams_a: np.ndarray, rows_a: np.ndarray, n_a: int, grams_b: np.ndarray, rows_b: np.ndarray, n_b: int) -> np.ndarray:
    """Product of two sparse 0/1 blocks given as (gram, row) entries: counts of common grams, (n_a, n_b)."""
    common = np.intersect1d(np.unique(grams_a), np.unique(grams_b), assume_unique=True)
    counts = np.zeros(n_a * n_b, np.int64)
    if not len(common):
        return counts.reshape(n_a, n_b)
    sides = []
    for grams, rows in ((grams_a, rows_a), (grams_b, rows_b)):
        at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
        hit = common[at] == grams
        order = np.argsort(at[hit], kind="stable")
        column, row = at[hit][order], rows[hit][order]
        sides.append((column, row, np.searchsorted(column, np.arange(len(common) + 1))))
    (col_a, row_a, at_a), (col_b, row_b, at_b) = sides
    deg_a, deg_b = np.diff(at_a), np.diff(at_b)
    dense = np.flatnonzero(np.minimum(deg_a, deg_b) >= _COMMON)
    # frequent columns: dense products of 2,048 columns at a time
    where = np.full(len(common), -1)
    where[dense] = np.arange(len(dense))
    total = np.zeros((n_a, n_b), np.float32)
    for low in range(0, len(dense), 2048):
        high = min(low + 2048, len(dense))
        parts = []
        for column, row, n in ((col_a, row_a, n_a), (col_b, row_b, n_b)):
            pick = (where[column] >= low) & (where[column] < high)
            part = np.zeros((n, high - low), np.float32)
            part[row[pick], where[column[pick]] - low] = 1
            parts.append(part)
        total += parts[0] @ parts[1].T
    # rare columns: every entry of one side meets the few entries of the other
    reps = np.where(where[col_a] < 0, deg_b[col_a], 0)
    for low in range(0, len(col_a), 65536):
        r = reps[low : low + 65536]
        if not r.any():
            continue
        left = np.repeat(row_a[low : low + 65536], r)
        start = np.repeat(at_b[col_a[low : low + 65536]], r)
        step = np.arange(len(left)) - np.repeat(np.cumsum(r) - r, r)
        counts += np.bincount(left * n_b + row_b[start + step], minlength=n_a * n_b)
    return counts.reshape(n_a, n_b) + total.astype(np.int64)


def _candidate_rows(texts: DataFrame, n: int) -> DataFrame:
    """set_id, set key, size and all n-grams (8 bytes each) per row."""

    def work(batches):
        for batch in batches:
            for _, grams, bounds in _sets(batch.column("text"), n):
                ids = _set_ids(grams, bounds)
                _, firsts = np.unique(ids, axis=0, return_index=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        _fixed_binary(ids[firsts]),
                        pa.array(ids[firsts, 0].copy().view(np.int64)),
                        pa.array([grams[bounds[i] : bounds[i + 1]].tobytes() for i in firsts.tolist()], pa.binary()),
                    ],
                    names=["set_id", "key", "grams"],
                )

    return texts.mapInArrow(work, "set_id binary, key long, grams binary")


def _block_links(rows: DataFrame, percent: int) -> DataFrame:
    """Links inside groups: (a, b) star edges of set ids, and (a, a, links) counts.

    `rows`: batch (several groups or one block pair), side (0: left, 1: right, 2: both), set_id, grams.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        ids = table.column("set_id").to_pylist()
        side = table.column("side").to_numpy()
        lists = [np.frombuffer(x.as_py(), "<u8") for x in table.column("grams")]
        sizes = np.array([len(x) for x in lists], np.int64)
        links_a, links_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        # a batch of small groups may hold more rows than a block
        for i in range(0, len(left), BLOCK_ROWS):
            for j in range(0, len(right), BLOCK_ROWS):
                a, b = left[i : i + BLOCK_ROWS], right[j : j + BLOCK_ROWS]
                if side[0] == 2 and j < i:
                    continue
                entries = []
                for rows in (a, b):
                    entries += [np.concatenate([lists[k] for k in rows]), np.repeat(np.arange(len(rows)), sizes[rows]), len(rows)]
                both = _overlaps(*entries)
                union = sizes[a][:, None] + sizes[b][None, :] - both
                hit = (100 * both >= percent * union) & (both > 0)
                if side[0] == 2:
                    hit &= a[:, None] < b[None, :]
                x, y = np.nonzero(hit)
                links_a.append(a[x])
                links_b.append(b[y])
        a, b = np.concatenate(links_a), np.concatenate(links_b)
        n_links = np.bincount(a, minlength=len(ids)) + np.bincount(b, minlength=len(ids))
        root = _forest(a, b, len(ids))
        seen = np.flatnonzero(n_links)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([ids[root[k]] for k in seen], pa.binary()),
                pa.array([ids[k] for k in seen], pa.binary()),
                pa.array(n_links[seen].astype(np.int64)),
            ],
            names=["a", "b", "links"],
        )

    return rows.groupBy("batch").applyInArrow(work, "a binary, b binary, links long")


def ngram_jaccard_classes(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Link documents by 100 * |A and B| >= percent * |A or B| over their sets of word n-grams.

    `docs` needs doc_id and text; other columns are ignored. Returns a row per row of
    `docs`: doc_id, n_shingles (size of its set), component_id (smallest doc_id
    reachable by links), n_links (other n-gram sets it links with), n_copies (rows with
    the same set), set_id and group_id (both binary; one group_id per component). Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; a text
    with fewer than n words is one n-gram; a null text or one without words has the
    empty set, links with nothing and is its own component, even beside a row with the
    same doc_id. Rows with equal sets link, so repeated rows share a component. A null
    doc_id is kept and never the name of a component, unless it stands alone: then the
    component_id is null. An empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = durable(_set_rows(texts, n))
    classes = rows.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_copies"))
    links = _links(spark, texts, rows, n, percent)
    found = components(links.select("a", "b"))
    named = found.join(classes.select(F.col("set_id").alias("node"), "first_id"), "node")
    names = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    counts = links.groupBy(F.col("b").alias("set_id")).agg(F.sum("links").alias("n_links"))
    linked = found.join(names, "component").select(F.col("node").alias("set_id"), "component_id", F.col("component").alias("group_id"))
    full = (
        classes.join(linked, "set_id", "left")
        .join(counts, "set_id", "left")
        .select(
            "set_id",
            F.coalesce("group_id", "set_id").alias("group_id"),
            F.when(F.col("group_id").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id"),
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
            "n_copies",
        )
    )
    # sets that own a thousandth of the rows are at most a thousand: they are broadcast, so no task gathers their rows
    full = durable(full)
    often = F.col("n_copies") >= F.lit(max(1000, rows.count() // 1000))
    hot = F.broadcast(full.where(often))
    filled = rows.where("n_shingles > 0")
    some = filled.join(hot, "set_id").unionByName(filled.join(hot, "set_id", "left_anti").join(full.where(~often), "set_id"))
    some = some.select("doc_id", "n_shingles", "component_id", "n_links", "n_copies", "set_id", "group_id")
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    empty = rows.where("n_shingles = 0").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), none.alias("n_links"), one.alias("n_copies"), "set_id", F.lit(None).cast("binary").alias("group_id")
    )
    return some.unionByName(empty)


def distinct_documents(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of `docs`, with all its columns, per component of near duplicates: one with its smallest doc_id.

    Rows without words stay, each of them.
    """
    at = docs.columns.index("text")

    def tag(batches):
        for batch in batches:
            found = [(_set_ids(grams, bounds), np.diff(bounds)) for _, grams, bounds in _sets(batch.column(at).cast(pa.string()), n)]
            ids = np.concatenate([np.zeros((0, 2), np.uint64), *(i for i, _ in found)])
            sizes = np.concatenate([np.zeros(0, np.int64), *(k for _, k in found)])
            yield pa.RecordBatch.from_arrays([*batch.columns, _fixed_binary(ids), pa.array(sizes)], names=[*batch.schema.names, "_set_id", "_size"])

    schema = T.StructType([*docs.schema.fields, T.StructField("_set_id", T.BinaryType()), T.StructField("_size", T.LongType())])
    tagged = docs.mapInArrow(tag, schema)
    classes = ngram_jaccard_classes(docs, n, percent)
    first = classes.where("group_id is not null").where("doc_id <=> component_id").groupBy("group_id")
    first = first.agg(F.min("set_id").alias("_kept_set"), F.first("component_id").alias("_kept_id")).drop("group_id")
    joined = tagged.where("_size > 0").join(first, (F.col("_set_id") == F.col("_kept_set")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_kept_id")), "left_semi")
    kept = joined.dropDuplicates(["_set_id", "doc_id"])
    return kept.unionByName(tagged.where("_size = 0")).select(*docs.columns)


def _links(spark: SparkSession, texts: DataFrame, rows: DataFrame, n: int, percent: int) -> DataFrame:
    """Stored links: star edges (a, b) of set ids and, on each, the number of links of b seen in that block pair."""
    blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    likely = durable(_likely_rows(_all_columns(texts, n, blocks), percent, blocks))
    first = rows.where("n_shingles > 0").groupBy("set_id", "key").agg(F.min("doc_id").alias("doc_id"))
    wanted = first.join(likely, "key").select("doc_id").distinct()
    chosen = texts.alias("t").join(wanted.alias("w"), F.expr("t.doc_id <=> w.doc_id"), "left_semi")
    matrix = durable(_candidate_rows(chosen, n).join(likely, "key", "left_semi").dropDuplicates(["set_id"]))
    groups = components(_meetings(_postings(matrix, percent, blocks, blocks), percent))
    matrix = matrix.join(groups.withColumnRenamed("node", "key"), "key").drop("key")
    sizes = durable(matrix.groupBy("component").agg(F.count("*").alias("members")).where("members > 1"))
    placed = matrix.join(sizes, "component")
    parts = F.ceil(F.col("members") / BLOCK_ROWS)
    # small groups share a batch; a large one is cut into blocks, and each pair of blocks is a batch
    small = placed.where(F.col("members") <= BLOCK_ROWS).select(
        F.concat_ws("/", F.lit("s"), F.pmod(F.xxhash64("component"), F.lit(_batches(sizes)))).alias("batch"), F.lit(2).alias("side"), "set_id", "grams"
    )
    large = placed.where(F.col("members") > BLOCK_ROWS).withColumn("block", F.pmod(F.xxhash64("set_id"), parts))
    other = F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))
    large = large.withColumn("other", other).select(
        F.concat_ws("/", "component", F.least("block", "other"), F.greatest("block", "other")).alias("batch"),
        F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side"),
        "set_id",
        "grams",
    )
    return durable(_block_links(small.unionByName(large), percent))


def _batches(sizes: DataFrame) -> int:
    """Number of batches for small groups: half a block of rows each, on average."""
    return max(1, (sizes.agg(F.sum("members")).first()[0] or 0) // (BLOCK_ROWS // 2))
