"""Features, training, prediction, evaluation, streaming."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from licspark import fixed_values as fv
from licspark.operators import convert, evaluation, features, models, scoring, vectors
from licspark.plans import predict
from licspark.plans import model as model_plan
from licspark.plans.train import train
from licspark.sources import findings_table, store
from licspark.streaming import jobs

TEXTS = {
    "MIT": "permission is hereby granted free of charge to any person",
    "GPL": "this program is free software you can redistribute it under the general public terms",
    "HPND-a": "permission to use copy modify alpha variant is granted without fee",
    "HPND-b": "permission to use copy modify beta variant is granted without fee",
}


def sample_rows():
    rows = []
    for i in range(12):
        for name, text in TEXTS.items():
            words = text.split() + [f"w{i}"]
            rows.append((f"{name}/{i:02d}", [name], words, ["int", "main", f"n{i}"], [fv.SINGLE_MAPPED_LICENSE, fv.NO_LRW]))
        both = TEXTS["MIT"].split() + TEXTS["GPL"].split() + ["dual"]
        rows.append((f"both/{i:02d}", ["GPL", "MIT"], both, None, [fv.MULTIPLE_MAPPED_LICENSE]))
        both = TEXTS["HPND-a"].split() + TEXTS["GPL"].split() + ["dual"]
        rows.append((f"other/{i:02d}", ["GPL", "HPND-a"], both, None, [fv.MULTIPLE_MAPPED_LICENSE]))
    return rows


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(
        sample_rows(),
        "path string, mapped_licenses array<string>, license_related_words array<string>, "
        "no_license_related_words array<string>, tags array<string>",
    )


@pytest.fixture(scope="module")
def model(spark, files):
    licenses = spark.createDataFrame([(n,) for n in TEXTS], "license string")
    texts = spark.createDataFrame([("MIT", "mit text"), ("Zlib", "z")], "license string, text string")
    return train(files, licenses, texts, max_samples=100, families=("HPND",), max_iter=15)


def test_vocabulary_and_weights(spark):
    docs = spark.createDataFrame([("0", ["a", "b"]), ("1", ["a"]), ("2", ["c", "c", "c", "d"])], "path string, words array<string>")
    vocab = {r.term: (r.tf, r.df, r.idf) for r in features.vocabulary(docs).collect()}
    assert vocab["c"][:2] == (3, 1) and vocab["a"][:2] == (2, 2) and "c c d" in vocab and "a b" in vocab
    assert vocab["a"][2] == pytest.approx(math.log(4 / 3) + 1)
    top = features.vocabulary(docs, max_features=2)
    assert {r.term for r in top.collect()} == {"c", "a"}
    got = {(r.path, r.term): r.weight for r in features.tfidf(docs, top).collect()}
    assert got == pytest.approx({("0", "a"): 1.0, ("1", "a"): 1.0, ("2", "c"): 1.0})
    full = features.vocabulary(docs)
    long = {(r.path, r.term): r.weight for r in features.tfidf(docs, full).collect()}
    rows = sorted((r.term, r.idf) for r in full.collect())
    counted = vectors.add_counts(docs, [t for t, _ in rows], "words", "n")
    vector = vectors.tfidf_vector(counted, "n", np.array([w for _, w in rows]))
    for r in counted.select("path", vector.alias("v")).collect():
        for i, x in zip(r.v.indices, r.v.values):
            assert long[r.path, rows[i][0]] == pytest.approx(x)


def test_problems_fit_their_samples(files, model):
    words = files.select("path", F.sort_array("mapped_licenses").alias("truth"), F.col("license_related_words").alias("words"))
    family = lambda name: "HPND" if name.startswith("HPND") else name
    for problem, rows in (("SP", "size(truth) = 1"), ("MP", "size(truth) > 1")):
        got = model.problems[problem].predict(words.where(rows), "words", "guess").collect()
        right = sum(sorted(r.guess) == sorted(map(family, r.truth)) for r in got)
        assert right / len(got) > 0.9, problem


def test_model_predicts(files, model):
    words = files.select("path", "mapped_licenses", F.col("license_related_words").alias("words"))
    got = predict.predict_words(words, model).collect()
    assert {r.route for r in got} >= {"single", "multi"}
    assert all(r.licenses for r in got)
    # Family names are refined, so the bare family is left only where no variant fits.
    assert any(name.startswith("HPND-") for r in got for name in r.licenses)


def test_model_routes(spark, model):
    rows = [("none", None), ("empty", []), ("code", ["int", "main"])]
    df = spark.createDataFrame(rows, "path string, words array<string>")
    got = {r.path: r.licenses for r in predict.predict_words(df, model).collect()}
    assert got == {"none": [fv.UNCLASSIFIED], "empty": [fv.UNCLASSIFIED], "code": [fv.NO_LICENSE]}


def test_save_and_load(spark, files, model, tmp_path):
    path = str(tmp_path / "model")
    model.save(spark, path)
    again = model_plan.load_model(spark, path)
    assert isinstance(again, model_plan.FamilyLicenseModel)
    assert again.info() == model.info()
    words = files.select("path", F.col("license_related_words").alias("words"))
    result = lambda m: sorted((r.path, r.licenses) for r in predict.predict_words(words, m).collect())
    assert result(again) == result(model)
    names = spark.createDataFrame([("MIT",), ("Zlib",)], "license string")
    texts = {r.license: r.text for r in model_plan.license_text(again, names).collect()}
    assert texts == {"MIT": "mit text", "Zlib": fv.LICENSE_TEXT_FALLBACK}
    config = store.load_config(spark, f"{path}/config")
    store.save_config(spark, {**config, "version": "other"}, f"{path}/config")
    with pytest.raises(model_plan.ModelError, match="version"):
        model_plan.load_model(spark, path)
    store.save_config(spark, {k: v for k, v in config.items() if k != "version"}, f"{path}/config")
    with pytest.warns(UserWarning):
        model_plan.load_model(spark, path)
    store.save_config(spark, {**config, "kind": "?"}, f"{path}/config")
    with pytest.raises(model_plan.ModelError, match="kind"):
        model_plan.load_model(spark, path)
    with pytest.raises(model_plan.ModelError, match="configuration"):
        model_plan.load_model(spark, str(tmp_path / "nothing"))


def test_incomplete_models_are_rejected(model):
    problem = model.problems["SP"]
    for problems in ([], [problem, None], [problem, problem]):
        with pytest.raises(model_plan.ModelError):
            model_plan.LicenseModel(problems)


def test_scoring_moves_no_rows(files, model):
    words = files.select("path", F.col("license_related_words").alias("words"))
    plan = predict.predict_words(words, model)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert plan.count("ArrowEvalPython") <= len(model.problems)


def test_scan_of_a_folder(spark, model, tmp_path):
    (tmp_path / "a.c").write_text("// " + TEXTS["MIT"] + " license\nint main() {}\n")
    got = predict.scan_files(spark, str(tmp_path), model).collect()
    assert len(got) == 1 and got[0].licenses


@pytest.mark.parametrize(
    "words, route, single, multi, want",
    [
        (["x"], "single", ["MIT"], [], ["MIT"]),
        (["x"], "multi", ["MIT"], ["some", "multi", "license"], ["some", "multi", "license"]),
        (["x"], "multi", ["MIT"], [], [fv.UNCLASSIFIED]),
        (["x"], "single", [], ["MIT"], [fv.UNCLASSIFIED]),
        (["x"], "no license", ["MIT"], ["MIT"], [fv.NO_LICENSE]),
        (["x"], "strange", ["MIT"], ["MIT"], [fv.UNCLASSIFIED]),
        ([], "single", ["MIT"], ["MIT"], [fv.UNCLASSIFIED]),
        (None, None, None, None, [fv.UNCLASSIFIED]),
    ],
)
def test_decide(spark, words, route, single, multi, want):
    df = spark.createDataFrame([(words, route, single, multi)], "w array<string>, r string, s array<string>, m array<string>")
    assert df.select(predict.decide(*map(F.col, "wrsm"))).first()[0] == want


def test_refine(spark):
    df = spark.createDataFrame([(["MIT", "HPND", "ISC"], ["HPND-a", "HPND-b"], [])], "l array<string>, f array<string>, e array<string>")
    row = df.select(predict.refine(F.col("l"), {"HPND": F.col("f")}), predict.refine(F.col("l"), {"HPND": F.col("e")})).first()
    assert tuple(row) == (["MIT", "HPND-a", "HPND-b", "ISC"], ["MIT", "HPND", "ISC"])


def test_chain_uses_earlier_labels(spark):
    vector_df = spark.createDataFrame([("p", ["t"])], "path string, words array<string>")
    links = [[0.0, 0.0], [2.0, 0.0]]
    problem = models.Problem("x", ["a", "b"], ["t"], [1.0], [[1.0], [-1.0]], [0.0, 0.0], links)
    assert problem.predict(vector_df, "words", "o").first().o == ["a", "b"]
    problem = models.Problem("x", ["a", "b"], ["t"], [1.0], [[-1.0], [-1.0]], [0.0, 0.0], links)
    assert problem.predict(vector_df, "words", "o").first().o == []


def test_indicator(spark):
    df = spark.createDataFrame([(["b", "c"],)], "l array<string>")
    flags = models.indicator("l", ["a", "b", "c"])
    assert tuple(df.select(flags, models.from_indicator(flags, ["a", "b", "c"])).first()) == ([0, 1, 1], ["b", "c"])


def test_linear_scores(spark):
    x = spark.createDataFrame([("p", "t", 2.0), ("p", "u", 1.0), ("q", "z", 1.0)], "path string, term string, x double")
    w = spark.createDataFrame([("t", "A", 1.0), ("u", "B", 3.0)], "term string, label string, w double")
    bias = spark.createDataFrame([("A", 0.5), ("B", -1.0)], "label string, b double")
    scores = scoring.linear_scores(x, scoring.per_term(w), bias)
    assert {(r.path, r.label): r.score for r in scores.collect()} == {
        ("p", "A"): 2.5, ("p", "B"): 2.0, ("q", "A"): 0.5, ("q", "B"): -1.0,
    }
    assert {r.path: r.label for r in scoring.best_label(scores).collect()} == {"p": "A", "q": "A"}


def test_certificate_against_numpy_and_for_a_fit(spark, sf_dir):
    from licspark.functions.tokens import word_tokens
    from licspark.operators import features
    from licspark.session import durable

    table = [("a", "t", 1.0), ("a", "u", 0.5), ("b", "u", 2.0), ("c", "t", 1.0)]
    x = spark.createDataFrame(table, "path string, term string, x double")
    truth = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "A"), ("d", "B")], "path string, label string")
    w = {("t", "A"): 1.0, ("u", "A"): -0.5, ("u", "B"): 0.5}
    weights = spark.createDataFrame([(*k, v) for k, v in w.items()], "term string, label string, w double")
    bias = spark.createDataFrame([("A", 0.25), ("B", 0.0)], "label string, b double")
    got = {r.label: r for r in scoring.svm_certificate(x, truth, weights, bias, F.lit(0.1), 0.0).collect()}
    matrix = np.array([[sum(v for p, t, v in table if (p, t) == (doc, term)) for term in "tu"] + [1.0] for doc in "abcd"])
    for label, b in (("A", 0.25), ("B", 0.0)):
        y = np.array([1 if own == label else -1 for own in "ABAB"])
        v = np.array([w.get(("t", label), 0), w.get(("u", label), 0), b])
        m = y * (matrix @ v)
        pull = matrix * y[:, None]
        base = 0.1 * np.array([*v[:2], 0]) - pull[m < 1].sum(axis=0) / 4
        ends = [base - np.maximum(pull[m == 1], 0).sum(axis=0) / 4, base - np.minimum(pull[m == 1], 0).sum(axis=0) / 4]
        assert got[label].objective == pytest.approx(np.maximum(0, 1 - m).mean() + 0.05 * (v[:2] ** 2).sum())
        assert got[label].subgradient == pytest.approx(max(0, ends[0].max(), (-ends[1]).max()))
        assert (got[label].n_violated, got[label].n_free) == ((m < 1).sum(), (m == 1).sum())
    # a finished fit is near its optimum, and its untrained start is not
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null and lang is not null")
    docs = docs.select(F.col("doc_id").cast("string").alias("path"), word_tokens(F.col("text")).alias("words"), F.col("lang").alias("label")).where(F.size("words") > 0)
    problem = models.fit_single(docs, max_features=300)
    weights, bias = problem.tables(spark)
    vocab = spark.createDataFrame(list(zip(problem.terms, map(float, problem.idf))), "term string, idf double")
    x = durable(features.tfidf(docs, vocab).withColumnRenamed("weight", "x"))
    truth, penalty = docs.select("path", "label"), F.lit(1.0 / docs.count())
    fitted = {r.label: r for r in scoring.svm_certificate(x, truth, weights, bias, penalty, 0.1).collect()}
    start = {r.label: r for r in scoring.svm_certificate(x, truth, weights.limit(0), bias.withColumn("b", F.lit(0.0)), penalty, 0.1).collect()}
    for label in start:
        assert fitted[label].objective < start[label].objective
        assert fitted[label].subgradient < CERTIFIED < start[label].subgradient


#: Bound of the subgradient of a finished fit (mean hinge loss, vectors of length 1).
CERTIFIED = 0.01


def test_hot_terms_are_not_shuffled(spark):
    from licspark.operators.hot_join import HOT_KEYS, hot_join, hot_keys
    from licspark.session import durable

    # a third of all rows has one term, and 2 * HOT_KEYS terms are rare
    rare = spark.range(2 * HOT_KEYS).select(F.col("id").alias("path"), F.concat(F.lit("r"), "id").alias("term"))
    hot = spark.range(HOT_KEYS).select(F.col("id").alias("path"), F.lit("hot").alias("term"))
    nulls = spark.range(10).select(F.col("id").alias("path"), F.lit(None).cast("string").alias("term"))
    rows = durable(rare.unionByName(hot).unionByName(nulls).repartition(4))
    assert [r.term for r in hot_keys(rows, "term").collect()] == ["hot"]
    table = spark.createDataFrame([("hot", 7), ("r1", 1), ("other", 3)], "term string, v int")
    got = hot_join(rows, table, "term")
    assert got.count() == rows.count()
    counted = {(r.term, r.v): r.n for r in got.where("v is not null or term is null").groupBy("term", "v").agg(F.count("*").alias("n")).collect()}
    assert counted == {("hot", 7): HOT_KEYS, ("r1", 1): 1, (None, None): 10}
    # no task of the shuffled part holds more than its share: the hot term's rows are where they were
    sizes = [r.n for r in got.where("term = 'hot'").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= 4 or max(sizes) < HOT_KEYS
    assert hot_join(rows.limit(0), table, "term").count() == 0


def test_naive_bayes_against_spark_ml(spark):
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.linalg import Vectors

    counts = {"A": {"x": 3, "y": 1}, "B": {"y": 4, "z": 2}}
    rows = [(label, label + "1", t, n) for label, terms in counts.items() for t, n in terms.items()]
    df = spark.createDataFrame(rows, "label string, path string, term string, tf long")
    seen = scoring.naive_bayes_counts(df)
    got = {(r.label, t): r.d for r in scoring.naive_bayes_defaults(seen).collect() for t in "xyz"}
    got |= {(r.label, r.term): r.w for r in scoring.naive_bayes(seen).collect()}
    data = spark.createDataFrame(
        [(float(i), Vectors.dense([counts[c].get(t, 0) for t in "xyz"])) for i, c in enumerate("AB")], ["label", "features"]
    )
    theta = NaiveBayes(modelType="multinomial").fit(data).theta.toArray()
    assert got == pytest.approx({(c, t): theta[i][j] for i, c in enumerate("AB") for j, t in enumerate("xyz")})


def test_evaluation(spark):
    schema = "path string, labels array<string>"
    truth = spark.createDataFrame([("a", ["x", "y"]), ("b", ["x"]), ("c", ["z"]), ("d", ["y"])], schema)
    guess = spark.createDataFrame([("a", ["y", "x"]), ("b", ["x", "y"]), ("c", []), ("d", ["x"])], schema)
    assert tuple(evaluation.subset_accuracy(truth, guess).first()) == (0.25, 4)
    report = {r.label: (r.precision, r.recall, r.f1, r.support) for r in evaluation.class_report(truth, guess).collect()}
    assert report["x"] == pytest.approx((2 / 3, 1.0, 0.8, 2))
    assert report["y"] == pytest.approx((0.5, 0.5, 0.5, 2))
    assert report["z"] == (0.0, 0.0, 0.0, 1)
    averages = {r.average: (r.precision, r.recall, r.f1) for r in evaluation.report_averages(truth, guess).collect()}
    assert averages["micro"] == pytest.approx((3 / 5, 3 / 5, 3 / 5))
    assert averages["macro"] == pytest.approx((7 / 18, 0.5, 1.3 / 3))
    assert averages["weighted"] == pytest.approx(((4 / 3 + 1) / 5, 3 / 5, 2.6 / 5))
    assert averages["samples"] == pytest.approx((1.5 / 4, 2 / 4, (1 + 2 / 3) / 4))
    assert evaluation.hamming_loss(truth, guess).first()[0] == pytest.approx(4 / 12)
    plan = evaluation.report_averages(truth, guess)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
    none = truth.limit(0)
    assert {tuple(r)[1:] for r in evaluation.report_averages(none, none).collect()} <= {(None, None, None, None), (0.0, 0.0, 0.0, None)}


def test_streams_in_many_batches(spark, tmp_path, model):
    source = tmp_path / "in"
    schema = "seq long, path string, source string, licenses array<string>, text string"
    rows = [(i, f"p{i % 5}", "CONCLUSION", [f"L{i % 3}"], None) for i in range(30)]
    for part in range(3):
        spark.createDataFrame(rows[part::3], schema).coalesce(1).write.mode("append").json(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    log = str(tmp_path / "log")
    jobs.stream_findings(stream, log, str(tmp_path / "state")).awaitTermination()
    now = findings_table.current_findings(spark, log)
    assert {r.path: r.licenses for r in now.collect()} == {f"p{i}": ["L0", "L1", "L2"] for i in range(5)}
    # a batch that runs again changes nothing, and an increment reads its own buckets only
    again = spark.createDataFrame([(99, "p1", "CONCLUSION", ["L9"], None)], schema)
    for _ in range(2):
        findings_table.merge_into(log, again, 7)
    now = {r.path: r.licenses for r in findings_table.current_findings(spark, log).collect()}
    assert now == {f"p{i}": ["L0", "L1", "L2"] + ["L9"] * (i == 1) for i in range(5)}
    assert len(list((tmp_path / "log" / "batch=7,buckets=1").glob("bucket=*"))) == 1


def test_findings_table_grows_by_splits(spark, tmp_path):
    """The table after every batch equals one conversion of all findings so far; splits leave other buckets alone."""
    path, schema = str(tmp_path / "table"), "seq long, path string, source string, licenses array<string>, text string"
    rows, buckets = [], 1
    for batch in range(6):
        fresh = [(batch * 1000 + i, f"p{(batch * 37 + i * 7) % 400}", "CONCLUSION" if i % 3 else "BULK", [f"L{i % 11}"], "t" * 50) for i in range(150)]
        rows += fresh
        done = findings_table.merge_into(path, spark.createDataFrame(fresh, schema), batch, bucket_bytes=4000)
        assert done.buckets <= 2 * buckets and done.bytes_written > 0
        buckets = done.buckets
        want = {tuple(r) for r in convert.convert_findings(spark.createDataFrame(rows, schema)).select("kind", "path", F.array_join("licenses", "|"), "seq").collect()}
        now = findings_table.current_findings(spark, path)
        assert {tuple(r) for r in now.select("kind", "path", F.array_join("licenses", "|"), "seq").collect()} == want and now.count() == len(want)
    assert buckets > 4
    # of each bucket only the newest version and those that the last batch found before it are left
    stored = findings_table._Stored(spark, path)
    assert set(stored.versions) == set(range(buckets)) and max(map(len, stored.versions.values())) <= 3
    one = findings_table.merge_into(path, spark.createDataFrame([(9999, "p1", "CONCLUSION", ["new"], None)], schema), 6, bucket_bytes=10**9)
    assert one.touched == 1 and one.bytes_written < stored.size() / 2
    # a batch that did not finish does not count
    (tmp_path / "table" / f"batch=6,buckets={buckets}" / "_SUCCESS").unlink()
    assert findings_table.current_findings(spark, path).where("array_contains(licenses, 'new')").count() == 0


def test_buckets_of_a_growing_table(spark):
    rows = spark.range(2000).select(F.lit("k").alias("kind"), F.concat(F.lit("p"), "id").alias("path"))
    for n in range(1, 20):
        moved = rows.select(findings_table.bucket_of(n).alias("a"), findings_table.bucket_of(n + 1).alias("b")).where("a <> b").distinct().collect()
        assert {r.a for r in moved} == findings_table.split_sources(n, n + 1) and {r.b for r in moved} == {n}


def test_running_counts(spark, tmp_path, model):
    source = tmp_path / "in"
    schema = "seq long, path string, source string, licenses array<string>, text string"
    rows = [(i, f"p{i % 5}", "CONCLUSION", [f"L{i % 3}"], None) for i in range(30)]
    for part in range(3):
        spark.createDataFrame(rows[part::3], schema).coalesce(1).write.mode("append").json(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))

    counts = str(tmp_path / "counts")
    keyed = stream.select("path", F.explode("licenses").alias("license"))
    jobs.stream_counts(keyed, ["license"], counts, str(tmp_path / "state2")).awaitTermination()
    now = jobs.latest(spark.read.option("basePath", counts).parquet(counts), ["license"])
    assert {r.license: r.n for r in now.collect()} == {"L0": 10, "L1": 10, "L2": 10}

    texts = stream.select("path", F.lit(TEXTS["MIT"]).alias("content"))
    out = str(tmp_path / "out")
    jobs.stream_predictions(texts, model, out, str(tmp_path / "state3")).awaitTermination()
    assert spark.read.parquet(out).count() == 30


def test_batch_decisions_are_those_of_single_rows():
    """One sparse product for many rows against plain sums, with and without chain links."""
    from pyspark.ml.linalg import SparseVector

    rng = np.random.default_rng(5)
    idf, coefficients, intercepts = rng.random(30) + 1, rng.normal(size=(4, 30)), rng.normal(size=4)
    links = np.tril(rng.normal(size=(4, 4)), -1)
    rows = [SparseVector(30, sorted(rng.choice(30, n, replace=False).tolist()), rng.integers(1, 9, n)) for n in (0, 1, 5, 12, 30)]
    got = vectors.margins(*vectors.flat([r.indices for r in rows], [r.values for r in rows]), idf, coefficients, intercepts)
    single, chain = vectors.decided(got, None), vectors.decided(got, links)
    for row, margin, best, flagged in zip(rows, got, single, chain):
        x = np.zeros(30)
        x[row.indices] = (1 + np.log(row.values)) * idf[row.indices]
        x /= np.sqrt(x @ x) or 1
        assert margin == pytest.approx(coefficients @ x + intercepts)
        assert best == [int(np.argmax(coefficients @ x + intercepts))]
        flags = []
        for k in range(4):
            flags.append(float(margin[k] + sum(links[k][j] * flags[j] for j in range(k)) > 0))
        assert flagged == [k for k in range(4) if flags[k]]
