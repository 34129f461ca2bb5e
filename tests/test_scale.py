"""Operators that were changed to grow no faster than their input."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from licspark.functions import ngrams
from licspark.operators import features, holdout, sampling
from licspark.operators import words as word_ops
from licspark.operators.term_counts import all_terms, known_terms
from licspark.sources import findings_table


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _docs(spark):
    draw = random.Random(3)
    rows = [(k, f"p{k % 7}", [draw.choice("abcdeé") for _ in range(draw.randrange(0, 30))]) for k in range(40)]
    return spark.createDataFrame([*rows, (40, "x", None), (41, None, ["a", "a"])], "k long, path string, words array<string>")


def test_terms_of_rows_are_counted_in_batches(spark):
    docs = _docs(spark)
    want = docs.select("k", "path", F.inline(ngrams.term_counts(ngrams.word_ngrams(F.col("words"), 3))))
    found = all_terms(docs, ["k", "path"])
    assert Counter(map(tuple, found.collect())) == Counter(map(tuple, want.collect()))
    terms = ["a", "a b", "c d e", "e a", "a b c d", "zz", "a zz"]
    known = known_terms(docs, ["k", "path"], terms)
    assert Counter(map(tuple, known.collect())) == Counter(map(tuple, want.where(F.col("term").isin(terms)).collect()))
    assert "MapInArrow" in _plan(features.document_terms(docs))


def test_tfidf_is_counted_in_batches(spark):
    docs = _docs(spark)
    vocab = spark.createDataFrame([("a", 1.5), ("b a", 2.0), ("c", 1.0), ("none", 3.0)], "term string, idf double")
    idf = {r.term: r.idf for r in vocab.collect()}
    want = {}
    for row in docs.collect():
        words = row.words or []
        counts = Counter(t for t in [*words, *map(" ".join, zip(words, words[1:]))] if t in idf)
        weights = {t: (1 + math.log(n)) * idf[t] for t, n in counts.items()}
        length = math.sqrt(sum(w * w for w in weights.values()))
        want |= {(row.k, t): round(w / length, 9) for t, w in weights.items()}
    found = features.tfidf(docs, vocab, "k")
    assert {(r.k, r.term): round(r.weight, 9) for r in found.collect()} == want
    assert "MapInArrow" in _plan(found)


def test_small_lemma_table_moves_no_row(spark, monkeypatch):
    docs = _docs(spark).withColumn("other", F.reverse("words"))
    lemmas = spark.createDataFrame([("a", "z"), ("a", "y"), ("b", None), (None, "q")], "token string, lemma string")
    found = word_ops.lemmatize_corpus(docs, lemmas, ["words", "other"], "k")
    assert "Exchange" not in _plan(found) and "ArrowEvalPython" in _plan(found)
    rows = {r.k: (r.words, r.other) for r in found.collect()}
    assert rows[40] == (None, None) and rows[41] == (["y", "y"], ["y", "y"])
    monkeypatch.setattr(word_ops, "IN_ROWS", 0)
    assert {r.k: (r.words, r.other) for r in word_ops.lemmatize_corpus(docs, lemmas, ["words", "other"], "k").collect()} == rows


def test_files_with_one_key_share_their_tokens(spark, monkeypatch):
    docs = spark.createDataFrame([("p", ["a", "c"]), ("p", ["a", "c"]), ("q", ["a"]), (None, ["a"])], "path string, words array<string>")
    lemmas = spark.createDataFrame([("a", "z")], "token string, lemma string")
    rows = lambda: Counter((r.path, *r.words) for r in word_ops.lemmatize_corpus(docs, lemmas, ["words"]).collect())
    found = rows()
    assert found["q", "z"] == 1
    monkeypatch.setattr(word_ops, "IN_ROWS", 0)
    assert rows() == found


def test_words_are_not_made_twice_for_the_vocabulary(spark):
    from licspark.operators.top_terms import _words

    assert "Filter" not in _plan(_words(_docs(spark), "words"))
    assert _words(_docs(spark), "words").count() == 42


def test_chosen_paths_come_to_the_wide_rows(spark):
    wide = spark.range(1000).select(F.col("id").cast("string").alias("path"), F.lit("w").alias("words"))
    chosen = wide.groupBy("path").agg(F.lit("MIT").alias("license")).where("path < '2'")
    found = sampling.rows_of_paths(wide, chosen)
    assert "BroadcastHashJoin" in _plan(found) and found.count() == chosen.count()


def test_files_to_hold_out_are_made_once(spark):
    files = spark.range(40).select(F.concat(F.lit("made"), "id").alias("path"), F.array(F.lit("MIT")).alias("mapped_licenses"), F.array(F.lit("TEST")).alias("tags"))
    tagged = holdout.tag_holdout(files.groupBy("path", "mapped_licenses", "tags").count().drop("count"))
    assert "Range (" not in tagged._jdf.queryExecution().optimizedPlan().toString()
    assert tagged.count() == 40


def test_first_batch_is_dealt_evenly(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(findings_table, "TASK_ROWS", 100)
    raw = spark.range(2000).select(
        F.col("id").alias("seq"), F.concat(F.lit("f"), "id").alias("path"), F.lit("CONCLUSION").alias("source"), F.array(F.lit("MIT")).alias("licenses"), F.lit("t").alias("text")
    )
    path = str(tmp_path / "table")
    findings_table.merge_into(path, raw, 0)
    files = list((tmp_path / "table").glob("batch=0*/bucket=0/*.parquet"))
    assert len(files) == 20
    sizes = [spark.read.parquet(str(f)).count() for f in files]
    assert sum(sizes) == 2000 and max(sizes) < 200
