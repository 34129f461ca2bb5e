"""The corpus operators on edge cases and against plain Python."""

import hashlib
import os
import random
import re
import subprocess
import sys
import tempfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from licspark.llm import bestfit, boosted_quality, factorization, host_suffixes, imatch, language_bayes, ngram_jaccard, quality_rules, queries
from licspark.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {k: k + 32 for k in range(65, 91)}


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# --- n-gram Jaccard join


def shingles(text, n=5):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1)))


def brute_classes(rows, percent=75):
    """(doc_id, size, component, links) per row, by comparing every two sets that share an n-gram."""
    sets = [shingles(text) for _, text in rows]
    distinct = {s: k for k, s in enumerate(dict.fromkeys(s for s in sets if s))}
    order, owners = list(distinct), defaultdict(list)
    for k, s in enumerate(order):
        for gram in s:
            owners[gram].append(k)
    root, links = list(range(len(order))), Counter()

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, s in enumerate(order):
        for other, common in Counter(o for gram in s for o in owners[gram] if o < k).items():
            if 100 * common >= percent * (len(s) + len(order[other]) - common):
                links.update((k, other))
                root[find(k)] = find(other)
    names = {}
    for (doc_id, _), s in zip(rows, sets):
        if s and doc_id is not None:
            r = find(distinct[s])
            names[r] = min(names.get(r, doc_id), doc_id)
    key = lambda r: tuple((v is not None, v or 0) for v in r)
    return sorted(
        ((d, len(s), names.get(find(distinct[s])) if s else d, links[distinct[s]] if s else 0) for (d, _), s in zip(rows, sets)), key=key
    )


def classes_of(docs):
    rows = ngram_jaccard.ngram_jaccard_classes(docs).collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in rows), key=lambda r: tuple((v is not None, v or 0) for v in r))


def test_jaccard_edges(edge_docs, no_docs):
    assert classes_of(edge_docs) == brute_classes([(r.doc_id, r.text) for r in edge_docs.collect()])
    assert ngram_jaccard.ngram_jaccard_classes(no_docs).count() == 0


def test_jaccard_against_all_pairs(spark, sf_dir):
    """Random families of near copies around the threshold, and the small documents table."""
    rng = random.Random(11)
    rows = [(r.doc_id, r.text) for r in documents(spark, sf_dir).collect()]
    for family in range(12):
        base = [f"f{family}w{rng.randrange(400)}" for _ in range(rng.choice([3, 5, 9, 40, 150]))]
        for _ in range(9):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 12)):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows) + 10_000, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert classes_of(docs) == brute_classes(rows)


def test_jaccard_large_group_in_blocks(spark, monkeypatch):
    """A group larger than a row block is multiplied block pair by block pair."""
    monkeypatch.setattr(ngram_jaccard, "BLOCK_ROWS", 16)
    rng = random.Random(5)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for k in range(90):
        copy = list(base)
        for _ in range(rng.randrange(3)):
            copy[rng.randrange(60)] = f"x{rng.randrange(50)}"
        rows.append((k, " ".join(copy)))
    assert classes_of(spark.createDataFrame(rows, "doc_id long, text string")) == brute_classes(rows)


def test_distinct_documents(edge_docs, no_docs):
    kept = ngram_jaccard.distinct_documents(edge_docs)
    assert kept.columns == edge_docs.columns
    found = Counter((r.doc_id, r.text) for r in kept.collect())
    assert set(found.values()) == {1}
    ids = [d for d, _ in found]
    assert sorted(d for d in ids if d is not None) == [1, 4, 5, 6, 7, 9, 10, 11, 12, 12, 13] and ids.count(None) == 1
    assert ngram_jaccard.distinct_documents(no_docs).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1100)] + [(7, 7), (None, 3)]
    root = {}

    def find(k):
        while root.setdefault(k, k) != k:
            k = root[k]
        return k

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: find(k) for k in root}


# --- quality rules


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {p for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_base_rules(spark, sf_dir, edge_docs, no_docs):
    for docs in (edge_docs, documents(spark, sf_dir)):
        got = quality_rules.quality_rules(docs).collect()
        counts = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
        assert counts == Counter((r.doc_id, *base_counts(r.text)) for r in docs.collect())
        assert not any(r.kept for r in got if r.base_failed)
    assert quality_rules.quality_rules(no_docs).count() == 0


def test_distance_verdict(spark, sf_dir):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in queries.op2_quality_rules(spark, sf_dir).collect() if not r.base_failed and r.doc_id in labels]
    good = [r.kept for r in rows if labels[r.doc_id] == 1]
    bad = [r.kept for r in rows if labels[r.doc_id] == 0]
    assert np.mean(good) >= 0.97 and np.mean(bad) <= 0.5


JUNK = "#$%&*|<>0123456789"


def test_no_language_vouches_for_its_own_noise(spark, sf_dir):
    """Noise is refused under a known, an unknown and a null language, alone or in numbers; a rare language of usual texts is kept."""
    rng = np.random.default_rng(3)
    noise = lambda: " ".join("".join(rng.choice(list(JUNK), 6)) for _ in range(60))
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    few = spark.createDataFrame([(10**9 + k, noise(), lang) for k, lang in enumerate(["zz", "en", None])], docs.schema)
    many = spark.createDataFrame([(10**9 + k, noise(), "zz") for k in range(12)], docs.schema)
    size = docs.select(F.sum(F.size(F.split("text", r"\s+")))).first()[0]
    assert 12 * 60 < quality_rules.SELF_SHARE * size
    for extra in (few, many):
        rows = quality_rules.quality_rules(docs.unionByName(extra)).where("doc_id >= 1000000000").collect()
        assert len(rows) == extra.count() and not any(r.kept or r.base_failed for r in rows)
    labels = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()}
    one = docs.where("lang = 'en'").where(F.col("doc_id").isin([int(x) for x in labels])).orderBy("doc_id").limit(2)
    ids = {r.doc_id for r in one.collect()}
    rare = docs.withColumn("lang", F.when(F.col("doc_id").isin(list(ids)), "en-rare").otherwise(F.col("lang")))
    kept = {r.doc_id: (r.kept, r.base_failed) for r in quality_rules.quality_rules(rare).collect() if r.doc_id in ids}
    assert all(k or failed for k, failed in kept.values())


def test_own_counts_leave_the_reference():
    counts, own = np.array([5.0, 3.0, 0.0]), np.array([[5, 3, 0], [1, 1, 0]])
    assert np.allclose(quality_rules._without(counts, own, np.array([True, True])), [[0, 0, 0], [4 / 6, 2 / 6, 0]])
    assert np.allclose(quality_rules._without(counts, own, np.array([False, False])), [counts / 8] * 2)


def test_workers_without_the_package():
    """Models travel as plain arrays: workers that cannot import the package apply them."""
    code = f"""
import sys
sys.path.append({os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))!r})
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
def importable(rows):
    import importlib.util
    yield from (importlib.util.find_spec("licspark") is not None for _ in rows)
assert spark.sparkContext.parallelize([1], 1).mapPartitions(importable).collect() == [False]
for name in ("op2_quality_rules", "op4_boosted_quality", "op5_language_bayes", "op8_factorization"):
    assert entry.queries()[name](spark, {SF_SMALL!r}).count() > 0
spark.stop()
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    with tempfile.TemporaryDirectory() as folder:
        done = subprocess.run([sys.executable, "-c", code], cwd=folder, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]


SF_SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_distances_are_jensen_shannon():
    counts, shares = np.array([[3, 1, 0], [0, 0, 5], [0, 0, 0]]), np.array([0.5, 0.5, 0.0])
    p, m = np.array([0.75, 0.25]), np.array([0.625, 0.375])
    want = np.sqrt((np.sum(p * np.log2(p / m)) + np.sum(0.5 * np.log2(0.5 / m))) / 2)
    assert np.allclose(quality_rules.distances(counts, shares), [want, 1, 1])


# --- HTML


PAGES = [
    (1, "http://a.org/1", "<html><head><title>T</title></head><body><nav><a>Home</a></nav><article><h1>One &amp; two</h1><p>First <b>bold\n text<br>here<p>Second<p class='notice'>We use cookies</p><section id=comments><p>nice!</p></section></article><footer>foot</footer>"),
    (2, "http://a.org/2", "<div>Site name and slogan of this host here</div><div><p>An unmarked page with its own story to tell, long enough.</p></div><div>all rights are reserved by the owners of this host</div>"),
    (3, "http://a.org/3", "<div>Site name and slogan of this host here</div><div><p>Another unmarked page with a different story altogether for you.</p></div><div>all rights are reserved by the owners of this host</div>"),
    (4, "http://b.org/1", "<div>Site name and slogan of this host here</div><p>only on b</p>"),
    (5, None, None),
    (6, "http://a.org/6", ""),
    (7, "http://a.org/7", "plain text & nothing else"),
    (8, "http://a.org/8", "<p>unclosed <i>markup <div class='ad'>buy <script>var a='<p>no</p>';</script>now</div> goes on <!-- gone -->"),
    (2, "http://a.org/2", "<div>Site name and slogan of this host here</div><div><p>An unmarked page with its own story to tell, long enough.</p></div><div>all rights are reserved by the owners of this host</div>"),
    (None, "not a url", "<main><p>no id</p><form><p>name</p></form></main>"),
]
TEXTS = {
    1: "One & two\n\nFirst bold text here\n\nSecond",
    2: "An unmarked page with its own story to tell, long enough.",
    3: "Another unmarked page with a different story altogether for you.",
    4: "Site name and slogan of this host here\n\nonly on b",
    5: "",
    6: "",
    7: "plain text & nothing else",
    8: "unclosed markup\n\ngoes on",
    None: "no id",
}


def test_main_text(spark):
    pages = spark.createDataFrame([(*row, "x", 3) for row in PAGES], "page_id long, url string, html string, text string, key int").repartition(3)
    got = host_suffixes.extract_main_text(pages).collect()
    assert len(got) == len(PAGES)
    assert {r.page_id: r.text for r in got} == TEXTS
    assert all(r.n_chars == len(r.text) for r in got)
    assert host_suffixes.extract_main_text(pages.limit(0)).count() == 0


KEPT = [
    ("<p>one <svg class=i /> two</p><p>three</p>", "one two|three"),
    ("<p>one <canvas/>two</p><object data='a>b' /><p>three</p>", "one two|three"),
    ("<p>one <svg class=i><text>no</text></svg> two</p><iframe src=http://a.org/>no</iframe>", "one two"),
    ("<div class='content has-sidebar'><article><p>the text</p></article></div><p>open</p>", "the text"),
    ("<div id=widget-area><article><p>the long text</p></article></div><p>open</p>", "the long text"),
    ("<div class=related><article><p>a teaser</p></article></div><article><p>text</p></article>", "text"),
    ("<aside><article><p>a long teaser that is no text</p></article></aside><p>open</p>", "open"),
    ("<div id=comments><article><p>a long answer that is no text</p></article></div><p>open</p>", "open"),
    ("<p>a <span hidden>no</span><span style='display: none'>no</span><a id='advert'>no</a><b role=navigation>no</b> z</p>", "a|z"),
    ("<p>a <a href='/x?id=menu' data-id='share'>link</a> z</p>", "a link z"),
]


@pytest.mark.parametrize("page, text", KEPT)
def test_no_text_lost_by_the_parser(page, text):
    blocks = host_suffixes.page_blocks(page)
    zone = host_suffixes.ARTICLE if any(z == host_suffixes.ARTICLE for z, _ in blocks) else host_suffixes.OPEN
    assert "|".join(t for z, t in blocks if z == zone) == text


def test_repeated_runs_against_pairs(spark):
    """Runs that two distinct pages of a host share, by comparing all pages."""
    rng = random.Random(2)
    pages = []
    for k in range(60):
        words = [rng.choice("abcd") + str(rng.randrange(4)) for _ in range(rng.randrange(3, 30))]
        pages.append((k, f"http://h{k % 3}.org/{k}", "<p>" + " ".join(words) + "</p>"))
    seen = defaultdict(set)
    for _, url, page in pages:
        words = page[3:-4].split()
        for k in range(len(words) - host_suffixes.MIN_RUN + 1):
            seen[url.split("/")[2], tuple(words[k : k + host_suffixes.MIN_RUN])].add(page)
    want = sum(len(p) > 1 for p in seen.values())
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    assert host_suffixes.repeated_runs(host_suffixes.read_pages(frame)).count() == want


def test_article_pages(spark, sf_dir):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in queries.op3_host_suffixes(spark, sf_dir).collect():
        inside = re.search("<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", re.sub("<br>", " ", b))).split()) for b in re.split("</?(?:p|h1)>", inside)]
        assert r.text == "\n\n".join(b for b in blocks if b)


# --- classifiers


def auc(score, label):
    score, label = np.array(score), np.array(label)
    return np.mean([(a > b) + 0.5 * (a == b) for a in score[label == 1] for b in score[label == 0]])


def held_out(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_quality_held_out(spark, sf_dir, edge_docs, no_docs):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = queries.op4_boosted_quality(spark, sf_dir).collect()
    assert all(r.held_out == (held_out(r.doc_id, 5) == 0) and r.predicted == (r.score >= 0.3) for r in rows)
    judged = [(r.score, labels[r.doc_id]) for r in rows if r.doc_id in labels and r.held_out]
    assert auc(*zip(*judged)) > 0.9
    model = boosted_quality.train_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    edge = boosted_quality.score_quality(edge_docs, model).collect()
    assert len(edge) == edge_docs.count() and all(0 <= r.score <= 1 for r in edge)
    assert boosted_quality.score_quality(no_docs, model).count() == 0
    kept = boosted_quality.keep_good(edge_docs, model)
    assert kept.columns == edge_docs.columns and kept.count() == sum(r.predicted for r in edge)
    constant = boosted_quality.train_quality(no_docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in boosted_quality.score_quality(edge_docs, constant).collect()} == {0.5}


def test_trees_walk_like_rows():
    """The flattened arrays give what a walk row by row gives."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, len(boosted_quality.FEATURES))).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = boosted_quality.fit_trees(x, y)
    for row, score in zip(x[:50], trees.probabilities(x[:50])):
        total = trees.base
        for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        assert np.isclose(score, 1 / (1 + np.exp(-total)))
    assert ((trees.probabilities(x) > 0.5) == y).mean() > 0.95


def test_machine_learns_pairs():
    """Two harmless terms are toxic together; scores are those of the sum over all pairs."""
    rng = random.Random(4)
    rows = []
    for _ in range(1500):
        places = sorted(rng.sample(range(12), rng.randrange(1, 6)))
        rows.append((int(0 in places and 1 in places), places))
    terms = np.arange(100, 112)
    machine = factorization.fit_machine(rows, terms)
    sets = [np.array([100 + p for p in places]) for _, places in rows]
    bounds = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    logits = machine.logits(np.concatenate(sets), bounds)
    for (_, places), logit in list(zip(rows, logits))[:40]:
        pairs = sum(machine.vectors[a] @ machine.vectors[b] for k, a in enumerate(places) for b in places[k + 1 :])
        assert np.isclose(logit, machine.bias + machine.weights[places].sum() + pairs)
    assert ((logits > 0) == [label for label, _ in rows]).mean() > 0.98


def test_toxicity(spark, sf_dir, edge_docs, no_docs):
    rows = queries.op8_factorization(spark, sf_dir).collect()
    assert all(r.held_out == (held_out(r.doc_id, 5) == 0) and r.predicted == (r.score >= 0.5) for r in rows)
    rng = random.Random(8)
    texts = [(k, " ".join(f"t{rng.randrange(200)}" for _ in range(30)) + (" Idiot!" if k % 4 == 0 else "")) for k in range(800)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(0, 800, 2)], "doc_id long, toxic int")
    model = factorization.train_toxicity(docs, labels)
    assert all(r.predicted == (r.doc_id % 4 == 0) for r in factorization.score_toxicity(docs, model).collect())
    edge = factorization.score_toxicity(edge_docs, model).collect()
    assert len(edge) == edge_docs.count() and all(0 <= r.score <= 1 for r in edge)
    assert factorization.score_toxicity(no_docs, factorization.train_toxicity(no_docs, labels.limit(0))).count() == 0


def test_neutral_words_toxic_together(spark):
    """Each word stands in as many clean as toxic rows, by their shares; a word of two toxic rows counts too."""
    rng = random.Random(3)
    extra = ["mention verb", "idiot", *["mention"] * 4, *["verb"] * 4]
    texts = [(k, " ".join(f"t{rng.randrange(200)}" for _ in range(20)) + f" {extra[k % 10]}" + (" rarely" if k in (1, 11) else "")) for k in range(2000)]
    docs = spark.createDataFrame([*texts, (3001, "rarely"), (3002, "never")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 10 < 2)) for k in range(1500)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in factorization.score_toxicity(docs, factorization.train_toxicity(docs, labels)).collect()}
    unseen = range(1500, 2000)
    assert np.mean([got[k].predicted == (k % 10 < 2) for k in unseen]) > 0.98
    assert np.mean([got[k].predicted for k in unseen if k % 10 == 0]) > 0.9
    assert got[3001].score > got[3002].score


def test_languages(spark, sf_dir, edge_docs, no_docs):
    rows = queries.op5_language_bayes(spark, sf_dir).collect()
    known = {r.doc_id: r.lang for r in documents(spark, sf_dir).collect()}
    assert all(r.held_out == (held_out(r.doc_id, 3) == 1) for r in rows)
    assert np.mean([r.lang_pred == known[r.doc_id] for r in rows if r.held_out]) > 0.97
    model = language_bayes.train_languages(documents(spark, sf_dir))
    edge = language_bayes.predict_languages(edge_docs, model).collect()
    assert {(r.doc_id, r.lang_pred, r.score) for r in edge if r.doc_id in (4, 5, 6, 9)} == {(k, "und", 0.0) for k in (4, 5, 6, 9)}
    assert all(r.lang_pred in ("de", "en", "es", "fr") and 0 < r.score <= 1 for r in edge if r.doc_id not in (4, 5, 6, 9))
    assert language_bayes.predict_languages(no_docs, language_bayes.train_languages(no_docs)).count() == 0
    assert {r.lang_pred for r in language_bayes.predict_languages(edge_docs, language_bayes.train_languages(no_docs)).collect()} == {"und"}
    assert language_bayes.keep_known(edge_docs, model, 0.0).count() == len(edge) - 4


def test_strange_texts_are_refused(spark, sf_dir, edge_docs):
    docs = documents(spark, sf_dir)
    model = language_bayes.train_languages(docs)
    rng = np.random.default_rng(5)
    gibberish = [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(n)) for n in (20, 100, 2000)]
    russian = "Съешь же ещё этих мягких французских булок да выпей чаю и приходи к нам завтра вечером"
    plain = ["the cat sat on the mat and looked at the other cats", "hello", "\U00030000\U00030001"]
    rows = [(k, t) for k, t in enumerate([*gibberish, russian, *plain])]
    texts = spark.createDataFrame(rows, "id int, text string")
    assert {r.id for r in language_bayes.keep_known(texts, model, 0.5).collect()} - {6} == {4, 5}
    # all usual texts with a letter stay
    lettered = sum(any(c.isalpha() for c in r.text or "") for r in docs.collect())
    assert language_bayes.keep_known(docs, model, 0.0).count() == lettered
    # without any learned language, texts with a letter stay, those of the last planes too
    unknown = language_bayes.train_languages(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.id for r in language_bayes.keep_known(texts, unknown, 0.5).collect()} == set(range(7))
    assert {r.doc_id for r in language_bayes.keep_known(edge_docs, unknown, 0.5).collect()}.isdisjoint({4, 5, 6, 9})


def test_many_languages_leave_a_task_in_parts(spark, monkeypatch):
    rows = [(f"text of language {k}", f"l{k:02}") for k in range(40)] * 2
    docs = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    whole, references = language_bayes.train_languages(docs), quality_rules.language_references(docs)
    monkeypatch.setattr(language_bayes, "HELD", 3)
    monkeypatch.setattr(quality_rules, "HELD", 3)
    parts, again = language_bayes.train_languages(docs), quality_rules.language_references(docs)
    assert all(np.array_equal(a, b) for a, b in zip(whole.parts(), parts.parts()))
    assert all(np.array_equal(a, b) for a, b in zip(references.parts(), again.parts())) and len(again.languages) == 40


def test_language_scores_are_naive_bayes():
    column = pa.array(["Abc ab, ba!", "cab"])
    grams = []
    for _, _, data, offsets in language_bayes.textops.slices(column):
        buckets, bounds = language_bayes.gram_buckets(*language_bayes.letters(data, offsets))
        grams = [buckets[a:b] for a, b in zip(bounds, bounds[1:])]
    folded = "abc ab  ba "
    want = sum(any(c != " " for c in folded[k : k + n]) for n in language_bayes.SIZES for k in range(len(folded) - n + 1))
    assert len(grams[0]) == want
    counts = np.stack([np.bincount(g, minlength=language_bayes.BUCKETS) for g in grams])
    model = language_bayes.LanguageModel.from_counts(["x", "y"], counts, np.array([3, 1]))
    shares = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
    logs = np.log([0.75, 0.25]) + np.log(shares[:, grams[1].astype(int)]).sum(axis=1)
    (_, names, scores, _, _), = language_bayes._predicted(pa.array(["cab"]), model)
    assert names == ["xy"[int(logs.argmax())]] and np.isclose(scores[0], 1 / np.exp(logs - logs.max()).sum())


# --- fingerprints


def test_edit_probe(spark, sf_dir, edge_docs, no_docs):
    for docs in (edge_docs, documents(spark, sf_dir)):
        rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
        want = Counter()
        for k, (doc_id, text) in enumerate(rows):
            after, half = rows[(k + 1) % len(rows)][1], len(text) // 2
            want[doc_id, len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()] += 1
        got = imatch.edit_probe(docs).collect()
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
        prints = defaultdict(set)
        for r in got:
            prints[r.doc_id].add(r.fingerprint)
        assert len(prints[1]) == 1
    assert np.mean([r.near_edited for r in got]) > 5 * np.mean([r.near_next for r in got])
    assert imatch.edit_probe(no_docs).count() == 0


def test_fingerprints(edge_docs):
    rows = defaultdict(list)
    for r in imatch.imatch_fingerprints(edge_docs).collect():
        rows[r.doc_id].append(r.fingerprint)
    assert len(set(rows[1])) == 1 and rows[1][0] in rows[None] and rows[1][0] == rows[2][0]
    assert set(rows[4][0]) == {"-"} and rows[4] == rows[5] == rows[6]
    assert rows[7] == rows[8] and rows[7] != rows[9]


def test_fingerprints_hold_every_term():
    """A single term fills a slot and changes the fingerprint; only two texts without words are alike without terms."""
    everything, nothing = (imatch.Fingerprinter(np.packbits(np.full(imatch.BUCKETS, one))) for one in (True, False))
    base = " ".join(f"base{k}" for k in range(40))
    for maker in (everything, nothing):
        words = [f"word{k}" for k in range(200)]
        hashes, filled = maker.slots(pa.array([*words, "", None]))
        assert filled[:200].any(axis=1).all() and not filled[200:].any()
        assert len(set(imatch.fingerprint_texts(hashes[:200], filled[:200]))) == 200
        at = np.arange(200)
        assert not imatch.likeness((hashes[at], filled[at]), (hashes[at * 0 + 200], filled[at * 0 + 200])).any()
        assert not imatch.likeness((hashes[at[:-1]], filled[at[:-1]]), (hashes[at[1:]], filled[at[1:]])).any()
        assert imatch.likeness((hashes[200:201], filled[200:201]), (hashes[201:], filled[201:])).tolist() == [1.0]
        longer = maker.slots(pa.array([f"{base} {w}" for w in words]))
        assert len(set(imatch.fingerprint_texts(*longer))) == 200


# --- packing


def naive_fit(sizes, sources, clusters, capacity):
    bins, out = [], []
    for size, source, cluster in zip(sizes, sources, clusters):
        fits = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= size and cluster not in b["clusters"] and (source is None or source not in b["sources"])]
        if fits:
            k = min(fits)[1]
        else:
            k = len(bins)
            bins.append({"left": capacity, "sources": set(), "clusters": set()})
        out.append((k, capacity - bins[k]["left"]))
        bins[k]["left"] -= size
        bins[k]["sources"].add(source)
        bins[k]["clusters"].add(cluster)
    return out


def test_best_fit_against_search_of_all_bins():
    rng = random.Random(6)
    for _ in range(30):
        n = rng.randrange(0, 120)
        sizes = sorted((rng.randrange(1, 100) for _ in range(n)), reverse=True)
        sources = [rng.choice(["a", "b", "c", "d", None]) for _ in range(n)]
        clusters = [rng.randrange(max(1, n - 5)) for _ in range(n)]
        assert bestfit.best_fit(sizes, sources, clusters, 100) == naive_fit(sizes, sources, clusters, 100)


def check_bins(docs, packed, capacity):
    words = Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in docs)
    pieces = defaultdict(int)
    for r in packed:
        pieces[r.doc_id] += r.n_words
    total = Counter()
    for (doc_id, n), times in words.items():
        total[doc_id] += n * times
    assert dict(pieces) == dict(total)
    bins = defaultdict(list)
    for r in packed:
        assert (r.bin_id is None) == (r.n_words == 0)
        if r.bin_id is not None:
            bins[r.bin_id].append(r)
    for rows in bins.values():
        place = 0
        for r in sorted(rows, key=lambda r: r.position):
            assert r.position == place
            place += r.n_words
        assert place <= capacity
    return bins


def test_packing(spark, sf_dir, edge_docs, no_docs):
    for docs, capacity in ((edge_docs, 100), (documents(spark, sf_dir), bestfit.CAPACITY)):
        rows = docs.collect()
        bins = check_bins(rows, bestfit.best_fit_packing(docs, capacity).collect(), capacity)
        sources, texts = {r.doc_id: r.source for r in rows}, {r.doc_id: " ".join(WORD.findall((r.text or "").translate(LOWER))) for r in rows}
        for packed in bins.values():
            named = [p.doc_id for p in packed if p.doc_id is not None and p.doc_id != 12]
            known = [sources[d] for d in named if sources[d] is not None]
            assert len(known) == len(set(known))
            assert len({texts[d] for d in named}) == len(named)
    assert bestfit.best_fit_packing(no_docs).count() == 0


def test_near_copies_share_no_bin(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    texts = []
    for k in range(12):
        words = list(base)
        words[8 * k] = f"other{k}"
        texts.append((k, " ".join(words), None if k % 2 else f"s{k}", "x" if k < 6 else None))
    texts += [(k, " ".join(f"v{rng.randrange(10**6)}" for _ in range(100)), None, "x" if k < 15 else None) for k in range(12, 30)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string, given string").repartition(3)
    bins = check_bins(docs.collect(), bestfit.best_fit_packing(docs, 500).collect(), 500)
    assert all(sum(p.doc_id < 12 for p in packed) <= 1 for packed in bins.values())
    assert len(bins) == 12
    bins = check_bins(docs.collect(), bestfit.best_fit_packing(docs, 500, cluster="given").collect(), 500)
    assert all(sum(p.doc_id < 6 or 12 <= p.doc_id < 15 for p in packed) <= 1 for packed in bins.values())


# --- pipeline


def test_pipeline(spark, sf_dir):
    """Each stage against plain Python on what the stage before kept."""
    docs = documents(spark, sf_dir)
    names = docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    first = corpus_pipeline.quality_classifier(spark, docs, sf_dir)
    assert first.columns == names
    kept = {r.doc_id for r in first.collect()}
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in kept for d in good) >= 0.97 * len(good)
    second = corpus_pipeline.language_identification(spark, first, sf_dir)
    rows = second.collect()
    assert len(rows) >= 0.98 * len(kept)
    third = corpus_pipeline.near_duplicates(spark, second, sf_dir).collect()
    assert {r.doc_id for r in third} == {c for _, _, c, _ in brute_classes([(r.doc_id, r.text) for r in rows])}
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in third}
    check_bins(third, packed, bestfit.CAPACITY)


def test_pipeline_on_an_empty_table(spark, sf_dir, tmp_path):
    documents(spark, sf_dir).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"op11_lemp_negatives", "op13_prefix_trie"}))
def test_registered_rows(spark, sf_dir, name):
    table = "pages" if name.startswith("op3") else "documents"
    rows = queries.QUERIES[name](spark, sf_dir).select("page_id" if table == "pages" else "doc_id").distinct().count()
    assert rows == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()


@pytest.mark.parametrize(
    "page, text",
    [
        ("<body><form id='aspnetForm'><article><p>the story</p></article><input></form></body>", "the story"),
        ("<article><div class='market-share'><p>shares fell</p></div><p>a <span class='search-term'>word</span> here</p></article>", "shares fell\n\na word here"),
        ("<article><p>read this</p></article><div><p>" + "a long open text. " * 30 + "</p></div>", "read this\n\n" + ("a long open text. " * 30).strip()),
        ("<article><p>story</p><div class='newsletter-box'><p>join us</p></div><div class='share'>tell</div></article>", "story"),
        ("<form><p>" + "text of a page in one form. " * 30 + "</p></form>", ("text of a page in one form. " * 30).strip()),
        ("<form><p>your name</p></form><p>some open words</p>", "some open words"),
        ("<article><p>" + "word " * 200 + "</p></article><p>" + "open words " * 300 + "</p>", ("word " * 200).strip()),
    ],
)
def test_wrappers_names_and_teasers(spark, page, text):
    frame = spark.createDataFrame([(1, "http://a.org/x", page)], "page_id long, url string, html string")
    assert host_suffixes.extract_main_text(frame).first().text == text


def test_blocks_of_a_site_go_and_shared_passages_stay(spark):
    """A paragraph in most articles of a host is the site's; copies, quotes and small hosts lose nothing."""
    letter, quote = "Subscribe to our weekly letter for free today", "A passage that several articles of all hosts share in full"
    rows, want = [], {}
    for host, n in (("big.org", 12), ("small.org", 3)):
        for k in range(n):
            own = [f"{host} article {k} has a paragraph {j} with words of its own" for j in range(4)]
            blocks = own + [letter] + ([quote] if k % 3 == 0 else [])
            number = len(rows)
            rows.append((number, f"http://{host}/{k}", "<article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article>"))
            want[number] = "\n\n".join(b for b in blocks if host != "big.org" or b != letter)
    copy = "<article><p>one copied article of a few words in all</p><p>and its second paragraph of some words</p><p>with a third one that ends it here</p></article>"
    for k in range(20):
        rows.append((100 + k, "http://copies.org/x", copy))
        want[100 + k] = "one copied article of a few words in all\n\nand its second paragraph of some words\n\nwith a third one that ends it here"
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    assert {r.page_id: r.text for r in host_suffixes.extract_main_text(frame).collect()} == want
