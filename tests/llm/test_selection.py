"""Hard negatives, shards and the prefix trie against plain Python, edge cases included."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from licspark.llm import hard_negatives, prefix_trie, queries, shard_packing
from licspark.llm.oracle import ORACLES


def twin(sf_dir, name, *tables):
    con = duckdb.connect()
    for table in tables:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    rel = con.sql(ORACLES[name])
    return rel.columns, rel.fetchall()


def same_rows(df, columns, rows):
    key = lambda r: tuple((v is not None, v or 0) for v in r)
    assert sorted(df.columns) == sorted(columns)
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=key) == sorted(rows, key=key)


# --- hard negatives


def brute_negatives(rows, step, positives=5, negatives=10):
    used = []
    for vec_id, label, vector in rows:
        if None not in (vec_id, label, vector) and all(x is not None and math.isfinite(x) for x in vector):
            used.append((vec_id, label, [math.floor(256 * x) for x in vector]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for k, (vec_id, label, vector) in enumerate(used):
        if vec_id % step:
            continue
        scored = sorted((-dot(vector, v), i, lab) for n, (i, lab, v) in enumerate(used) if n != k)
        for p in [s for s in scored if s[2] == label][:positives]:
            found = [s for s in scored if s[2] != label and 30 * -p[0] <= 100 * -s[0] <= 90 * -p[0]][:negatives]
            out += [(vec_id, p[1], r, s[1], -p[0], -s[0]) for r, s in enumerate(found, 1)]
    return sorted(out)


def vectors(spark, rows):
    named = [(i, lab, v, "x", 1, 2.0, -1) for i, lab, v in rows]
    return spark.createDataFrame(named, "vec_id long, label int, embedding array<float>, bucket string, uid int, length double, score int").repartition(3)


def random_vectors(seed, n, d, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, d))
    labels = rng.integers(0, 4, n)
    points = (centres[labels] + rng.normal(size=(n, d)) * 0.8) * np.exp(rng.normal(size=(n, 1)) * spread)
    return [(k, int(lab), [float(x) for x in v]) for k, (lab, v) in enumerate(zip(labels, points.astype(np.float32)))]


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_hard_negatives_against_all_pairs(spark, spread):
    rows = random_vectors(3, 400, 6, spread)
    copy = rows[17][2]
    rows += [(1000 + k, k % 2, copy) for k in range(60)]  # many copies of one vector
    found = hard_negatives.hard_negatives(vectors(spark, rows), F.col("vec_id") % 10 == 0, bucket_rows=50, block_anchors=16)
    assert sorted(tuple(r) for r in found.collect()) == brute_negatives(rows, 10)


def test_hard_negatives_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5]), (10, 1, [1.0, 0.5]), (1, 1, [1.0, 0.25]), (2, 2, [0.5, 0.5]), (3, 2, [0.5]), (4, 2, []), (5, 2, [0.0, 0.0])]
    rows += [(6, 2, None), (7, None, [1.0, 1.0]), (8, 2, [nan, 1.0]), (9, 2, [inf, 1.0]), (11, 2, [None, 1.0]), (None, 2, [0.5, 0.5])]
    rows += [(20, 3, [-1.0, -0.5]), (21, 3, [1.0, 0.5]), (0, 1, [1.0, 0.5]), (2, 2, [0.5, 0.5]), (30, 4, [1.0, 0.0]), (31, 4, [0.0, 1.0])]
    found = hard_negatives.hard_negatives(vectors(spark, rows), F.col("vec_id") % 10 == 0)
    assert sorted(tuple(r) for r in found.collect()) == brute_negatives(rows, 10)
    assert hard_negatives.hard_negatives(vectors(spark, rows).limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_feasible_ranges_lose_no_row_and_prune():
    rng = np.random.default_rng(5)
    vectors = np.floor(256 * rng.normal(size=(2000, 8)))
    lengths = np.sqrt((vectors**2).sum(axis=1))
    bucket = hard_negatives.Bucket(vectors, lengths)
    seen = total = 0
    for _ in range(50):
        anchor = np.floor(256 * rng.normal(size=8))
        products = vectors @ anchor
        for threshold in np.quantile(products, [0.5, 0.99, 0.999]):
            found = bucket.candidates(anchor, float(np.sqrt(anchor @ anchor)), float(threshold))
            kept = set(range(2000)) if found is None else set(found.tolist())
            assert set(np.flatnonzero(products >= threshold).tolist()) <= kept
            seen, total = seen + len(kept), total + 2000
    assert seen < 0.9 * total


def test_hard_negatives_twin(spark, sf_dir):
    same_rows(queries.op11_lemp_negatives(spark, sf_dir), *twin(sf_dir, "op11_lemp_negatives", "embeddings"))


# --- shards


def naive_best_fit(sizes, capacity):
    rooms, out = [], []
    for size in sizes:
        fits = [(room, k) for k, room in enumerate(rooms) if room >= size and size <= capacity]
        if fits:
            _, k = min(fits)
        else:
            rooms.append(max(size, capacity))
            k = len(rooms) - 1
        rooms[k] -= size
        out.append(k)
    return out


def test_best_fit_decreasing_against_search_of_all_bins():
    rng = random.Random(4)
    for round_ in range(40):
        sizes = sorted((rng.randrange(1, 130) for _ in range(rng.randrange(1500 if round_ < 4 else 120))), reverse=True)
        assert shard_packing.best_fit_decreasing(sizes, 100) == naive_best_fit(sizes, 100)


def test_even_shards():
    rng = random.Random(8)
    for _ in range(30):
        sizes = sorted((rng.randrange(1, 500) for _ in range(rng.randrange(400, 900))), reverse=True)
        loads = Counter()
        for size, shard in zip(sizes, shard_packing.even_shards(sizes, 16)):
            loads[shard] += size
        assert set(loads) == set(range(16)) and max(loads.values()) - min(loads.values()) <= 0.01 * sum(sizes) / 16
    # a huge item stands alone, the others are even
    loads = Counter()
    for size, shard in zip([100_000, *sizes], shard_packing.even_shards([100_000, *sizes], 16)):
        loads[shard] += size
    rest = sorted(loads.values())[:-1]
    assert max(loads.values()) == 100_000 and max(rest) - min(rest) <= 0.01 * sum(sizes) / 15
    assert shard_packing.even_shards([], 16) == [] and shard_packing.even_shards([5, 5], 16) == [0, 1]


def check_shards(docs, placed, shards):
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in placed) == want
    slots, homes = defaultdict(list), defaultdict(set)
    for r in placed:
        assert 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        homes[r["size"], r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())


def test_shards_on_edge_rows(spark, edge_docs, edge_rows, no_docs):
    placed = shard_packing.shard_documents(edge_docs, 4)
    check_shards([(r[0], r[1]) for r in edge_rows], placed.collect(), 4)
    assert shard_packing.shard_documents(no_docs).count() == 0


def test_shards_in_levels(spark):
    """Many levels of cells give the same evenness, and copies stay together."""
    rng = random.Random(2)
    docs = [(k, "x" * rng.randrange(1, 400) + str(k)) for k in range(3000)] + [(5000 + k, "the copy " * 5) for k in range(300)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    placed = shard_packing.shard_documents(table, 4, cell_items=64, final_items=600).collect()
    check_shards(docs, placed, 4)
    loads = Counter()
    for r in placed:
        loads[r.shard] += r["size"]
    assert max(loads.values()) - min(loads.values()) <= 0.02 * sum(loads.values()) / 4


def test_shards_of_a_capacity(spark):
    items = [(bytes([k // 256, k % 256]), 1 + (k * 37) % 90) for k in range(500)]
    table = spark.createDataFrame(items, "item binary, size long")
    loads = Counter()
    for r in shard_packing.pack_groups(table, capacity=1000).join(table, "item").collect():
        loads[r.shard] += r["size"]
    total = sum(s for _, s in items)
    assert max(loads.values()) <= 1000 and sum(loads.values()) == total and len(loads) <= -(-total // 1000) + 1
    with pytest.raises(ValueError):
        shard_packing.pack_groups(table)


def test_registered_shards(spark, sf_dir):
    placed = queries.op12_bestfit_shards(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    check_shards([tuple(r) for r in docs], placed, 16)
    assert {(r.law, r.grown_shard) for r in placed} == {("bytes", None)}


# --- prefix trie


def brute_trie(rows, rejoin=True):
    """rows: (conv_id, turn, role, text)"""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            code = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            convs[conv].append((turn is not None, turn or 0, code, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in convs.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if rejoin else 0
        built[c] = own.get(int(math.copysign(abs(c) // 100 * 100, c)), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for path, who in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(q[: len(p)] == p and len(q) == len(p) + 1 for q in below)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = ",".join(str(c) for c in sorted(c for c in who if len(built[c]) == len(path)))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(who), len(path), parent, len(who), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turns_table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "conv_id long, turn long, role string, text string, path string, shard string, depth int").repartition(3)


def rebuilt(table):
    paths = prefix_trie.conversation_paths(table)
    return prefix_trie.rejoined(paths, 100, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6)


@pytest.mark.parametrize("partitions", ["1", "4", "13"])
def test_trie_against_plain_python(spark, partitions):
    rng = random.Random(7)
    rows = []
    for c in [*range(0, 160), *range(200, 230), -5, -101, -100]:
        for turn in range(rng.randrange(1, 7)):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "ccc", None, "é🙂"])))
    rows += [(1000 + k, t, "user", f"same {t}") for k in range(60) for t in range(3)]  # one conversation, many times
    rows += [(5, None, "system", "first"), (6, 0, "user", "a"), (6, 0, "user", "a"), (None, 0, "user", "nobody"), (7, 9, "user", "x" * 50_000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        same_rows(prefix_trie.prefix_trie(rebuilt(turns_table(spark, rows))), TRIE, brute_trie(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_trie_edges(spark):
    turnless = [(c, 0, "user", "only") for c in (101, 102, 103, 104, 105, 106)]
    same_rows(prefix_trie.prefix_trie(rebuilt(turns_table(spark, turnless))), TRIE, brute_trie(turnless))
    assert prefix_trie.prefix_trie(rebuilt(turns_table(spark, turnless).limit(0))).count() == 0
    plain = [(c, t, "user", f"{c % 3} {t}") for c in range(40) for t in range(4)]
    same_rows(prefix_trie.prefix_trie(prefix_trie.conversation_paths(turns_table(spark, plain))), TRIE, brute_trie(plain, False))


def test_trie_twin(spark, sf_dir):
    same_rows(queries.op13_prefix_trie(spark, sf_dir), *twin(sf_dir, "op13_prefix_trie", "conversations"))
