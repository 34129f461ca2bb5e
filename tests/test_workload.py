"""Every registered query on the smallest tables, against its SQL twin."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import compare

# Model fits take long; test_models covers them.
SLOW = {"corpus_scan", "stream_scan", "svm_language", "chain_labels"}


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - SLOW))
def test_query(spark, sf_dir, con, name):
    got = entry.queries()[name](spark, sf_dir).toPandas()
    assert len(got) > 0
    if name in entry.oracle_sql():
        assert compare(got, con.execute(entry.oracle_sql()[name]).df()) == "ok"


def test_stem_counts_against_plain_python(spark, sf_dir):
    from collections import Counter

    import regex

    from licspark.functions.porter import stem
    from licspark.functions.tokens import STOP_WORDS, WORD_OR_SIGN

    want = Counter()
    for row in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect():
        for token in regex.findall(WORD_OR_SIGN, row.text):
            token = regex.sub("[^0-9a-zA-Z.]", "", token.lower())
            if token and token not in STOP_WORDS:
                want[stem(token)] += 1
    got = {r.stem: r.n for r in entry.queries()["stem_counts"](spark, sf_dir).collect()}
    assert got == want


def test_fits_are_useful(spark, sf_dir):
    language = entry.queries()["svm_language"](spark, sf_dir).toPandas()
    assert (language.label == language.guess).mean() > 0.9
    chain = entry.queries()["chain_labels"](spark, sf_dir).toPandas()
    # only labelled documents carry all their labels
    known = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert len(chain) > len(known)
    chain = chain[[int(path.rsplit("/", 1)[1]) in known for path in chain.path]]
    assert (chain.labels == chain.guess).mean() > 0.5


def test_held_out_quality(spark, sf_dir):
    report = entry.queries()["held_out_report"](spark, sf_dir).toPandas()
    assert (report.f1 * report.support).sum() / report.support.sum() > 0.8


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
