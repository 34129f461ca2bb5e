"""SVMs fitted side by side: against Spark's own fit, class by class, and their parts."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from licspark.operators import models, svm, vectors

NAMES = [f"L{k:02d}" for k in range(12)]


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(150):
        labels = sorted(set(rng.choice(NAMES, rng.integers(1, 4)).tolist()))
        words = [f"w{rng.integers(40)}" for _ in range(rng.integers(0, 30))] + [n.lower() for n in labels if rng.random() < 0.8]
        rows.append((f"p{i}", words, labels, labels[0]))
    rows += [("long", ["w1"] * 700 + ["w2"] * 300, ["L01"], "L01"), ("none", [], ["L02", "L02"], "L02"), ("null", ["w3", None, "w4"], ["L03"], "L03")]
    return spark.createDataFrame(rows, "path string, words array<string>, labels array<string>, label string").repartition(3).persist()


def by_spark(samples, terms, idf, truth, seen=(), max_iter=8):
    """Coefficients and intercept of one class, by Spark's fit of vectors."""
    counted = vectors.add_counts(samples.withColumns({"_truth": truth.cast("double"), **{f"_s{i}": c.cast("double") for i, c in enumerate(seen)}}), terms, "words", "_n")
    data = counted.withColumn("_x", vectors.tfidf_vector(counted, "_n", np.array(idf)))
    data = VectorAssembler(inputCols=["_x", *(f"_s{i}" for i in range(len(seen)))], outputCol="_f").transform(data)
    fitted = LinearSVC(labelCol="_truth", featuresCol="_f", regParam=1 / samples.count(), maxIter=max_iter, standardization=False).fit(data)
    return fitted.coefficients.toArray(), fitted.intercept


def test_side_by_side_fits_are_those_of_spark(spark, samples, monkeypatch):
    # nothing is kept in the memory of executors
    with monkeypatch.context() as m:
        m.setattr(type(samples), "persist", None)
        single = models.fit_single(samples, max_features=60, max_iter=8, parallelism=5)
        chain = models.fit_chain(samples, max_features=60, max_iter=8)
    assert single.classes == chain.classes == NAMES
    for k in (0, 3, 11):
        w, b = by_spark(samples, single.terms, single.idf, F.col("label") == NAMES[k])
        assert single.coefficients[k] == pytest.approx(w, abs=1e-9) and single.intercepts[k] == pytest.approx(b, abs=1e-9)
        seen = [F.array_contains("labels", c) for c in NAMES[:k]]
        w, b = by_spark(samples, chain.terms, chain.idf, F.array_contains("labels", NAMES[k]), seen)
        assert np.concatenate((chain.coefficients[k], chain.links[k, :k])) == pytest.approx(w, abs=1e-9)
        assert chain.intercepts[k] == pytest.approx(b, abs=1e-9) and not chain.links[k, k:].any()


def test_classes_share_the_passes_over_the_rows(spark, samples):
    """Twelve labels took a job per label and iteration."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("chain", "chain")
    try:
        models.fit_chain(samples, max_features=60, max_iter=10)
        jobs = tracker.getJobIdsForGroup("chain")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) < 12 * 10 / 2


def test_sums_of_many_tasks_are_merged(samples, monkeypatch):
    want = models.fit_chain(samples, max_features=60, max_iter=3)
    monkeypatch.setattr(svm, "TASKS", 1)
    got = models.fit_chain(samples, max_features=60, max_iter=3)
    assert got.coefficients == pytest.approx(want.coefficients, abs=1e-9) and got.links == pytest.approx(want.links, abs=1e-9)


def test_null_labels_are_refused(spark):
    rows = spark.createDataFrame([("a", ["x"], None, None), ("b", ["y"], "B", ["B", None])], "path string, words array<string>, label string, labels array<string>")
    for fit in (models.fit_single, models.fit_chain):
        with pytest.raises(ValueError, match="null label"):
            fit(rows)


def test_parts_of_a_batch(monkeypatch):
    """Rows with wide and narrow counts, empty rows, and rows that are cut into several parts."""
    monkeypatch.setattr(svm, "_COUNTS", 3)
    rows = [([0, 2], [1, 2]), ([], []), ([1], [9]), ([0, 1, 2], [300, 1, 70000]), ([2], [255])]
    widths = [1, 1, 1, 4, 1]
    batch = pa.RecordBatch.from_arrays(
        [
            pa.array([["a"], ["b"], ["a", "b"], ["b"], ["a"]]),
            pa.array([np.array(t, np.uint16).tobytes() for t, _ in rows], pa.binary()),
            pa.array([np.array(c, f"u{w}").tobytes() for (_, c), w in zip(rows, widths)], pa.binary()),
            pa.array(widths, pa.int32()),
            pa.array([0.5, 1.0, 2.0, 1.0, 1.0]),
        ],
        names=["labels", "terms", "counts", "width", "scale"],
    )
    for part in (batch, batch.slice(1)):
        skipped = batch.num_rows - part.num_rows
        found = list(svm._parts(part, pa.array(["a", "b"]), np.uint16))
        assert len(found) > 2
        weights = np.array([1.0, 10.0, 100.0])
        want = [s * sum(weights[t] * (1 + np.log(n)) for t, n in zip(*row)) for row, s in zip(rows, [0.5, 1, 2, 1, 1])]
        assert np.concatenate([p.products(weights) for p in found]) == pytest.approx(want[skipped:])
        factors, sums, first = np.array([1.0, -1.0, 0.0, 2.0, -1.0])[skipped:], np.zeros(3), 0
        for p in found:
            sums += p.sums(factors[first : first + len(p.sizes)], 3)
            first += len(p.sizes)
        dense = np.zeros((5, 3))
        for i, (t, n) in enumerate(rows):
            dense[i, t] = (1 + np.log(n)) * [0.5, 1, 2, 1, 1][i] if n else 0
        assert sums == pytest.approx(factors @ dense[skipped:])
        places = [[p.label_places[p.label_rows == i].tolist() for i in range(len(p.sizes))] for p in found]
        assert sum(places, []) == [[0], [1], [0, 1], [1], [0]][skipped:]


def test_moments_of_equal_values_have_no_spread():
    """A term with one value in all rows must not be scaled by rounding errors."""
    value = np.full(7, 0.1 + 0.2)
    a = svm._moments(svm.Part(np.arange(8), np.zeros(7, np.int64), value, np.full(7, 1 / 3), None, None), np.array([1.7]))
    b = svm.merged_moments(np.zeros(3), svm.merged_moments(a, a))
    assert b[0] == 14 and b[2] == 0
    rng = np.random.default_rng(0)
    parts = [rng.random(n) for n in (1, 5, 40)]
    total = np.zeros(3)
    for p in parts:
        total = svm.merged_moments(total, svm._moments(svm.Part(np.arange(len(p) + 1), np.zeros(len(p), np.int64), p, np.ones(len(p)), None, None), np.ones(1)))
    whole = np.concatenate(parts)
    assert total == pytest.approx([46, whole.mean(), 46 * whole.var()])


def test_predictions_skip_null_words(spark):
    """No n-gram goes across a null word; rows without words have the class of the intercepts."""
    problem = models.Problem("x", ["a", "b"], ["s", "s t"], [1.0, 1.0], [[1.0, -9.0], [0.0, 9.0]], [0.0, 0.5])
    rows = spark.createDataFrame([("p", ["s", None, "t"]), ("q", ["s", "t"]), ("r", []), ("s", ["s", "s"])], "path string, words array<string>")
    got = {r.path: r.o for r in problem.predict(rows, "words", "o").collect()}
    assert got == {"p": ["a"], "q": ["b"], "r": ["b"], "s": ["a"]}


def test_chain_labels_does_the_whole_fit(spark, tmp_path, monkeypatch):
    """All iterations of the library, on the rows of all labelled documents: repeated ones too, those without a number not."""
    import inspect

    from licspark.workload import queries

    docs = [(i, f"text number {i} released under the mit license", "en" if i % 2 else "de", "src") for i in range(12)]
    docs += [docs[3], (None, "without a number", "en", "src")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(1, 1, 0), (2, 2, 1), (3, 0, 0), (4, 1, 1), (50, 1, 0), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    fit, asked = models.fit_chain, []

    def spy(samples, *args, **options):
        asked.append((inspect.signature(fit).bind(samples, *args, **options).arguments.get("max_iter", 50), samples.collect()))
        return fit(samples, *args, **(options | {"max_iter": 2}))

    monkeypatch.setattr(models, "fit_chain", spy)
    rows = queries.chain_labels(spark, str(tmp_path)).collect()
    assert len(rows) == 14
    [(iterations, samples)] = asked
    assert iterations == inspect.signature(fit).parameters["max_iter"].default == 50
    assert sorted(r.path for r in samples) == ["src/1", "src/2", "src/3", "src/3", "src/4"]
    assert set(samples[0].asDict()) == {"path", "words", "labels"}
