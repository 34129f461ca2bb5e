"""Scans over sliced groups, segments of chunked files, and the most frequent terms, against plain Python."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from licspark import fixed_values as fv
from licspark.functions import segments as seg
from licspark.functions.text import stripped_lines
from licspark.operators import chunked, features, scans, top_terms


def test_carried(spark):
    rng = random.Random(3)
    rows = [(None if rng.random() < 0.02 else "hot" if rng.random() < 0.7 else f"g{rng.randrange(20)}", k, rng.randrange(5), rng.choice([None, None, k])) for k in range(800)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, k long, n long, v long").repartition(6)
    got = scans.carried(scans.in_ranges(df, ["g"], ["k"]), ["g"], ["k"], sums={"s": F.col("n")}, lasts={"l": F.col("v")})
    want, sums, lasts = set(), Counter(), {}
    for g, k, n, v in sorted(rows, key=lambda r: r[1]):
        want.add((g, k, sums[g], lasts.get(g)))
        sums[g] += n
        lasts[g] = lasts.get(g) if v is None else v
    assert {(r.g, r.k, r.s, r.l) for r in got.collect()} == want and got.count() == len(rows)


PARTS = ["/*", "*/", "/* a */", "/*/", "// x", "//", "", "text", "* star", "/** doc", 'say("a");', '"""', "# c", "'''", "s = 'q'", "end */", "x /* y", "*/ z"]


def random_files(n=120, seed=11):
    rng = random.Random(seed)
    kinds = [fv.C, fv.CPP, fv.PYTHON, fv.SHELL, fv.PHP, "unknown filetype"]
    files = [(f"f{k}", rng.choice(kinds), "\n".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 25)))) for k in range(n)]
    return files + [("hot", fv.C, "\n".join(rng.choice(PARTS) for _ in range(3000))), ("open", fv.C, "/* never\n" * 50), ("empty", fv.C, "")]


@pytest.mark.parametrize("size", [1, 3, 7])
def test_chunked_segments_equal_those_of_whole_files(spark, size):
    files = spark.createDataFrame(random_files(), "path string, file_type string, content string").repartition(4)
    whole = files.select("path", F.posexplode(seg.segments(F.col("content"), F.col("file_type"))).alias("no", "s"))
    want = sorted((r.path, r.no, *r.s) for r in whole.collect())
    chunks = chunked.line_chunks(files, stripped_lines(F.col("content")), size, ["path", "file_type"])
    got = chunked.chunked_segments(chunks).collect()
    assert sorted((r.path, r.no, r.seg_type, r.start_line, r.end_line, r.body) for r in got) == want


def test_chunks_of_files_that_spark_splits(spark, tmp_path):
    files = random_files(6, 2)
    (tmp_path / "src").mkdir()
    for name, _, content in files:
        (tmp_path / "src" / name).write_text(content + "\né\n", encoding="latin-1")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        chunks = chunked.read_line_chunks(spark, str(tmp_path / "src"), 50)
        got = {}
        for r in chunks.orderBy("path", "chunk").collect():
            got.setdefault(r.path.rsplit("/", 1)[1], []).extend(r.lines)
        assert got == {name: [x.strip() for x in (content + "\né").split("\n")] for name, _, content in files}
        assert chunks.where("path like '%hot'").count() > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("buckets", [64, 1024, 1 << 20])
def test_top_terms_are_exact(spark, buckets):
    rng = random.Random(buckets)
    words = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(200)] + ["a b", "é", ""]
    docs = [[rng.choice(words) for _ in range(rng.randrange(0, 30))] for _ in range(300)] + [[], None, ["x", None, "y"], ["very"] * 5000]
    df = spark.createDataFrame([(str(k), d) for k, d in enumerate(docs)], "path string, words array<string>").repartition(3)
    tf, dfs = Counter(), Counter()
    for d in docs:
        d = [w for w in d or [] if w is not None]
        grams = [" ".join(d[i : i + n]) for n in (1, 2, 3) for i in range(len(d) - n + 1)]
        tf.update(grams)
        dfs.update(set(grams))
    for k in (5, 100):
        want = sorted(((t, n, dfs[t]) for t, n in tf.items()), key=lambda r: (-r[1], r[0].encode()))[:k]
        assert [tuple(r) for r in top_terms.top_terms(df, k, buckets=buckets).collect()] == want
    assert top_terms.top_terms(df.limit(0), 5, buckets=buckets).count() == 0
    some = top_terms.top_terms(df, 10**6, buckets=buckets)
    assert some.count() == len(tf)


def test_bounds_hold_and_leave_most_terms_out(spark):
    rng = np.random.default_rng(2)
    docs = [[f"w{x}" for x in rng.zipf(1.3, 400) if x < 10**6] for _ in range(200)]
    df = spark.createDataFrame([(str(k), d) for k, d in enumerate(docs)], "path string, words array<string>")
    assert top_terms.bucket_bounds(df).sum() == sum(max(0, len(d) - n) for d in docs for n in range(3))
    distinct = features.document_terms(df).select("term").distinct().count()
    assert top_terms.candidate_terms(df, 100).count() < distinct / 10


def test_stream_table_reads_files_and_folders(spark, tmp_path):
    """A table may be one file or a folder of files; both arrive whole (F1, F2)."""
    from licspark.workload.queries import _stream_table

    rows = [(1, "a"), (2, None), (2, None)]
    spark.createDataFrame(rows, "k int, t string").repartition(2).write.parquet(str(tmp_path / "many" / "docs.parquet"))
    spark.createDataFrame(rows, "k int, t string").coalesce(1).write.parquet(str(tmp_path / "made"))
    part = next((tmp_path / "made").glob("part-*.parquet"))
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "docs.parquet").write_bytes(part.read_bytes())
    for folder in ("many", "one"):
        out = str(tmp_path / f"out_{folder}")
        stream = _stream_table(spark, str(tmp_path / folder), "docs").writeStream.format("parquet").trigger(availableNow=True)
        stream.option("checkpointLocation", f"{out}_log").start(out).awaitTermination()
        assert sorted(map(tuple, spark.read.parquet(out).collect()), key=str) == sorted(rows, key=str)
