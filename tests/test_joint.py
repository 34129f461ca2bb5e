"""One-pass prediction against one pass per problem, on a random model."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from licspark import fixed_values as fv
from licspark.operators import scoring
from licspark.operators.models import Problem
from licspark.plans import predict
from licspark.plans.model import FamilyLicenseModel, LicenseModel


def problem(rng, name, classes, terms, chain):
    k, n = len(classes), len(terms)
    links = np.tril(rng.normal(size=(k, k)), -1) if chain else None
    return Problem(name, classes, terms, rng.uniform(1, 3, n), rng.normal(size=(k, n)), rng.normal(size=k) * 0.1, links)


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(4)
    letters = list("abcdefghij")
    terms = letters + [f"{x} {y}" for x in letters for y in letters]
    some = lambda n: sorted(rng.choice(terms, n, replace=False).tolist())
    return FamilyLicenseModel(
        [
            problem(rng, "DP", [fv.MULTI, fv.NO_LICENSE, fv.SINGLE], some(60), False),
            problem(rng, "SP", ["BSD", "HPND", "MIT"], some(40), False),
            problem(rng, "MP", ["BSD", "GPL", "HPND", "MIT"], some(50), True),
            problem(rng, "HPND", ["HPND-a", "HPND-b"], some(30), True),
            problem(rng, "BSD", ["BSD-2", "BSD-3"], some(30), True),
        ]
    )


def step_by_step(df, model):
    """Every problem by itself over all rows."""
    names = ["DP", "SP", "MP", *(model.families if isinstance(model, FamilyLicenseModel) else [])]
    out = df.withColumn("_w", F.coalesce("words", F.array().cast("array<string>")))
    for name in names:
        out = model.problems[name].predict(out, "_w", f"_{name}")
    out = out.withColumn("route", F.when(F.size("_w") > 0, F.get("_DP", F.lit(0))))
    out = out.withColumn("licenses", predict.decide(F.col("_w"), F.col("route"), F.col("_SP"), F.col("_MP")))
    if len(names) > 3:
        out = out.withColumn("licenses", predict.refine(F.col("licenses"), {n: F.col(f"_{n}") for n in names[3:]}))
    return out.select("path", "route", "licenses")


@pytest.mark.parametrize("families", [True, False])
def test_one_pass_equals_one_per_problem(spark, model, families):
    rng = np.random.default_rng(7)
    rows = [(str(k), rng.choice(list("abcdefghijkl"), rng.integers(0, 12)).tolist()) for k in range(1500)] + [("null", None), ("unknown", ["zzz"])]
    docs = spark.createDataFrame(rows, "path string, words array<string>").repartition(3)
    used = model if families else LicenseModel([model.problems[n] for n in ("DP", "SP", "MP")])
    got = sorted(map(tuple, predict.predict_words(docs, used).select("path", "route", "licenses").collect()))
    assert got == sorted(map(tuple, step_by_step(docs, used).collect()))
    assert {r[1] for r in got} == {None, fv.SINGLE, fv.MULTI, fv.NO_LICENSE}
    if families:
        assert any("HPND-a" in r[2] for r in got) and any("BSD-3" in r[2] for r in got)


def test_one_counting_and_one_python_step(spark, model):
    docs = spark.createDataFrame([("a", ["a", "b"])], "path string, words array<string>")
    plan = predict.predict_words(docs, model)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_chain_decisions_against_a_loop(spark):
    rng = np.random.default_rng(3)
    labels = ["a", "b", "c", "d"]
    links = np.tril(rng.normal(size=(4, 4)) * 3, -1)
    scores = rng.normal(size=(200, 4))
    rows = [(str(k), l, float(s)) for k, row in enumerate(scores) for l, s in zip(labels, row)] + [("other", "zz", 9.0), ("some", "b", 1.0), ("null", None, 2.0)]
    table = spark.createDataFrame(rows, "path string, label string, score double").repartition(3)
    want = {"other": [], "null": [], "some": ["b"]}
    for k, row in enumerate(scores):
        found = []
        for j in range(4):
            if row[j] + sum(links[j][i] for i in found) > 0:
                found.append(j)
        want[str(k)] = [labels[j] for j in found]
    assert {r.path: r.labels for r in scoring.chain_decisions(table, labels, links.tolist()).collect()} == want


@pytest.mark.parametrize("files", [0, 1, 3])
def test_stream_scan_equals_corpus_scan(spark, model, tmp_path, monkeypatch, files):
    """Turns of one file, of a folder of files or of an empty table are all predicted by the stream, once each (F1)."""
    from licspark.workload import queries

    rng = np.random.default_rng(9)
    rows = [(k // 4, k % 4, "user", " ".join(rng.choice(list("bcdefghj"), rng.integers(0, 12)))) for k in range(300)]
    rows += [(1, None, "user", "b c d"), (None, None, None, None), (1, 1, "user", ""), rows[5], rows[5]]
    turns = spark.createDataFrame(rows if files else [], "conv_id long, turn long, role string, text string")
    made = tmp_path / ("made" if files == 1 else "conversations.parquet")
    turns.repartition(max(1, files)).write.parquet(str(made))
    if files == 1:
        (tmp_path / "conversations.parquet").write_bytes(next(made.glob("part-*.parquet")).read_bytes())
    monkeypatch.setattr(queries, "_model", lambda spark, sf_dir: model)
    streamed = queries.stream_scan(spark, str(tmp_path))
    assert streamed.columns == ["path", "route", "licenses"]
    got = sorted(map(tuple, streamed.collect()), key=str)
    assert got == sorted(map(tuple, queries.corpus_scan(spark, str(tmp_path)).collect()), key=str)
    assert len(got) == len(turns.collect()) and (not files or len({r[1] for r in got}) > 2)
