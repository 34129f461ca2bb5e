"""Conversion, mapping, tags, analysis, hold-out, sampling."""

import json

import pytest
from pyspark.sql import functions as F

from licspark import fixed_values as fv
from licspark.operators import analysis, convert, evaluation, holdout, mapping, ranking, sampling, tags
from licspark.plans import update
from licspark.schemas import CSV_DUMP, RAW_FINDINGS
from licspark.sources import files as file_source
from licspark.sources import findings as finding_source
from licspark.sources import mapping as mapping_source
from licspark.sources import store

RAW = [
    (1, "a/x.c", "CONCLUSION", ["MIT"], None),
    (2, "a/x.c", "CONCLUSION", ["GPL-2.0"], None),
    (3, "a/x.c", "nomos", ["MIT"], None),
    (4, "b/y.c", "BULK", ["BSD"], "snip"),
    (5, "b/y.c", "BULK_REMOVE", ["ISC"], "snap"),
    (6, "l/MIT", "LICENSE", ['"MIT "'], "full text"),
    (7, "l/r", "LICENSE_INDIRECT", ["MIT"], "see file"),
    (8, "q/z", "unknown_tool", ["MIT"], None),
    (9, "q/w", "CONCLUSION", [], None),
    (10, "q/v", "CONCLUSION", ['" "'], None),
    (11, None, "CONCLUSION", ["MIT"], None),
]
CONVERTED = {
    ("Conclusion", "a/x.c"): (["GPL-2.0", "MIT"], None, None, None),
    ("NomosFinding", "a/x.c"): (["MIT"], None, None, None),
    ("Bulk", "b/y.c"): (["BSD", "ISC"], False, None, "snip"),
    ("License", "l/MIT"): (["MIT"], None, False, "full text"),
    ("License", "l/r"): (["MIT"], None, True, "see file"),
}


def as_dict(files):
    return {(r.kind, r.path): (r.licenses, r.remove, r.indirect, r.text) for r in files.collect()}


@pytest.fixture
def raw(spark):
    return spark.createDataFrame(RAW, RAW_FINDINGS)


def test_convert(spark, raw):
    assert as_dict(convert.convert_findings(raw)) == CONVERTED
    assert as_dict(convert.convert_findings(raw, convert.source_registry(spark))) == CONVERTED


def test_new_source_is_a_registry_row(spark, raw):
    registry = convert.source_registry(spark, [("unknown_tool", "ToolFinding", None, None)])
    assert ("ToolFinding", "q/z") in as_dict(convert.convert_findings(raw, registry))


def test_quarantine(raw):
    got = {(r.seq, r.problem) for r in convert.quarantine(raw).collect()}
    assert got == {(8, "unknown source"), (9, "no license"), (10, "no license"), (11, "missing path")}


def test_upsert_equals_full_conversion(raw):
    for odd in (0, 1):
        old = convert.convert_findings(raw.where(F.col("seq") % 2 == odd))
        assert as_dict(convert.upsert_findings(old, raw.where(F.col("seq") % 2 != odd))) == CONVERTED


def test_dump(spark, tmp_path):
    lines = ["p1,c1,s1,CONCLUSION,1,2", "p2,c2,s2,monk", 'p3,"c,3",s3,BULK', "p4,c4,s4"]
    (tmp_path / "dump.csv").write_text("\n".join(lines))
    want = {("p1", "c1", False), ("p2", "s2", False), ("p3", "c,3", False), ("p4", "c4", True)}
    read = finding_source.read_dump(spark, str(tmp_path / "dump.csv"))
    assert {(r.path, r.licenses[0], r.rejected) for r in read.collect()} == want
    parsed = finding_source.parse_dump_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert parsed.drop("value").schema.simpleString() == spark.createDataFrame([], CSV_DUMP).schema.simpleString()
    assert {(r.path, r.licenses[0], r.rejected) for r in finding_source.dump_findings(parsed).collect()} == want


def test_raw_findings_ignore_unknown_fields(spark, tmp_path):
    row = {"seq": 1, "path": "p", "source": "monk", "licenses": ["MIT"], "extra": 5}
    (tmp_path / "raw.json").write_text(json.dumps(row))
    got = finding_source.read_raw_findings(spark, str(tmp_path / "raw.json")).first()
    assert tuple(got) == (1, "p", "monk", ["MIT"], None)


MAPPING = (
    "GPL-2.0;GPL-2.0-only;\nOld;A;B\nJunk;NO_MAPPED_LICENSE;\nDual;MIT;GPL;MULTI_LICENSE\n"
    "Old;C;\nBare\n\n"
)


@pytest.fixture
def mapping_table(spark, tmp_path):
    (tmp_path / "mapping.csv").write_text(MAPPING)
    return mapping_source.read_mapping(spark, str(tmp_path / "mapping.csv"))


def test_mapping_file(mapping_table):
    assert {r.old: r.new for r in mapping_table.collect()} == {
        "GPL-2.0": ["GPL-2.0-only"],
        "Old": ["C"],
        "Junk": ["NO_MAPPED_LICENSE"],
        "Dual": ["MIT", "GPL", "MULTI_LICENSE"],
        "Bare": [],
    }


@pytest.mark.parametrize(
    "licenses, plain, faithful",
    [
        (["GPL-2.0", "Other"], ["GPL-2.0-only", "Other"], ["GPL-2.0-only", "Other"]),
        (["Bare", "Dual"], ["Bare", "GPL", "MIT", "MULTI_LICENSE"], ["Bare", "GPL", "MIT", "MULTI_LICENSE"]),
        (["A", "Junk", "Old"], ["A", "C"], ["A"]),
        (["Junk"], [], ["Junk"]),
        (['"MIT "'], ["MIT"], ["MIT"]),
    ],
)
def test_map_licenses(spark, mapping_table, licenses, plain, faithful):
    files = spark.createDataFrame([("p", licenses)], "path string, licenses array<string>")
    assert mapping.map_licenses(files, mapping_table).first().mapped_licenses == plain
    assert mapping.map_licenses(files, mapping_table, faithful=True).first().mapped_licenses == faithful


def test_empty_mapping_cleans_names(spark):
    files = spark.createDataFrame([("p", ['"MIT" '])], "path string, licenses array<string>")
    got = mapping.map_licenses(files, mapping_source.empty_mapping(spark)).first().mapped_licenses
    assert got == ["MIT"]


def test_missing_mapping_file(spark, tmp_path):
    with pytest.warns(UserWarning, match="no license mapping"):
        assert mapping_source.read_mapping(spark, str(tmp_path / "none.csv")).count() == 0


def test_mapping_template(spark, tmp_path):
    files = spark.createDataFrame([(["b", "A"],), (["c", "b"],)], "licenses array<string>")
    mapping_source.write_mapping_template(files, str(tmp_path / "out"))
    lines = [line for f in sorted((tmp_path / "out").glob("*.csv")) for line in f.read_text().splitlines()]
    assert lines == ["A;", "b;", "c;"]


def test_tags(spark):
    rows = [
        (["x", "LRW"], ["MIT"], ["w"], None, ["LRW", "SINGLE_MAPPED_LICENSE", "x"]),
        (["NO_LRW"], ["MIT", "ISC"], [], ["w"], ["MULTIPLE_MAPPED_LICENSE", "NO_LRW"]),
        (None, [], [], [], []),
    ]
    df = spark.createDataFrame(rows, "t array<string>, m array<string>, l array<string>, n array<string>, want array<string>")
    got = df.select(tags.derived_tags(*map(F.col, "tmln")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)
    held = F.array(F.lit("a"), F.lit("b"))
    checks = [tags.has_tags(held, ["a"]), tags.has_tags(held, ["a", "c"]), tags.has_tags(held, none_of=["b"]),
              tags.has_tags(held, none_of=["c"]), tags.has_tags(held, one="b"), tags.has_tags(held)]
    assert list(df.select(*checks).first()) == [True, False, False, True, True, True]


def mapped_files(spark, counts):
    rows = [(f"{lic}/{i:04d}", [lic], ["TEST"] if i % 2 else []) for lic, n in counts.items() for i in range(n)]
    return spark.createDataFrame(rows, "path string, mapped_licenses array<string>, tags array<string>")


def test_holdout(spark):
    files = mapped_files(spark, {"nine": 9, "ten": 10, "eleven": 11, "many": 501})
    held = [r.path for r in holdout.tag_holdout(files).where("array_contains(tags, 'TEST')").collect()]
    want = ["ten/0000", "eleven/0000", "eleven/0001"] + [f"many/{i:04d}" for i in range(51)]
    assert sorted(held) == sorted(want)


def test_rank_of_a_hot_group(spark):
    df = spark.range(20_000).select(
        F.when(F.col("id") % 3 != 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"),
        F.format_string("%06d", F.pmod(F.col("id") * 7919, F.lit(20_011))).alias("p"),
    )
    ranked = ranking.rank_within(df, ["g"], ["p"]).toPandas()
    want = ranked.groupby("g")["p"].rank(method="first").astype(int)
    assert (ranked["rank"] == want).all()
    assert (ranked["group_size"] == ranked.groupby("g")["p"].transform("size")).all()
    assert len(ranked) == 20_000


def test_first_per_group(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.format_string("%05d", "id").alias("p"))
    got = ranking.first_per_group(df, ["g"], ["p"], 7, salts=5).toPandas()
    for g in range(3):
        assert sorted(got[got.g == g].p) == [f"{g + 3 * i:05d}" for i in range(7)]


def test_hot_group_is_limited_before_its_shuffles(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.col("id").cast("string").alias("p"))
    plan = ranking.first_per_group(df, ["g"], ["p"], 7)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def sample_files(spark):
    rows = []
    for lic, n in {"big": 40, "ten": 10, "nine": 9}.items():
        rows += [(f"{lic}/{i:03d}", [lic], ["w"], ["n"], ["SINGLE_MAPPED_LICENSE", "NO_LRW"]) for i in range(n)]
    rows += [(f"both/{i:03d}", ["big", "ten"], ["w"], None, ["MULTIPLE_MAPPED_LICENSE"]) for i in range(12)]
    rows += [("big/empty", ["big"], [], [], ["SINGLE_MAPPED_LICENSE"])]
    rows += [("aaa/test", ["big"], ["w"], ["n"], ["SINGLE_MAPPED_LICENSE", "TEST", "NO_LRW"])]
    return spark.createDataFrame(
        rows,
        "path string, mapped_licenses array<string>, license_related_words array<string>, "
        "no_license_related_words array<string>, tags array<string>",
    )


def test_samples(spark):
    files = sample_files(spark)
    licenses = spark.createDataFrame([("big",), ("ten",), ("nine",)], "license string")
    options = dict(none_of=[fv.TEST])
    single = sampling.license_samples(files, licenses, 25, [fv.SINGLE_MAPPED_LICENSE], **options)
    counts = {r.license: r["count"] for r in single.groupBy("license").count().collect()}
    assert counts == {"big": 25, "ten": 10}
    multi = sampling.license_samples(files, licenses, 25, [fv.MULTIPLE_MAPPED_LICENSE], **options)
    assert multi.count() == 24
    assert multi.select("path").distinct().count() == 12
    once = sampling.license_samples(files, licenses, 25, [fv.MULTIPLE_MAPPED_LICENSE], distinct=True, **options)
    assert once.count() == 12
    routed = sampling.routing_samples(single, multi, files)
    assert {r.label: r["count"] for r in routed.groupBy("label").count().collect()} == {
        "single": 8, "multi": 8, "no license": 8,
    }
    assert sampling.no_license_samples(files, 100).count() == 59
    assert sampling.no_license_samples(files, 100, exclude_tags=()).count() == 60


def test_cap_comes_before_the_word_filter(spark):
    files = sample_files(spark).where("path LIKE 'big/%'")
    licenses = spark.createDataFrame([("big",)], "license string")
    # 40 files plus one without words, which sorts last.
    got = sampling.license_samples(files, licenses, 41, [fv.SINGLE_MAPPED_LICENSE])
    assert got.count() == 40


def test_family_samples(spark):
    rows = [("a", ["HPND-x", "MIT"], ["w"], []), ("b", ["MIT"], ["w"], []), ("c", ["HPND"], ["w"], ["TEST"])]
    files = spark.createDataFrame(
        rows, "path string, mapped_licenses array<string>, license_related_words array<string>, tags array<string>"
    )
    assert [(r.path, r.labels) for r in sampling.family_samples(files, "HPND", 10).collect()] == [("a", ["HPND-x"])]


def test_analysis(spark, tmp_path):
    rows = [
        (" text/x-c ", ["MIT"], ["MIT"], ["t"]),
        (None, ["A", "B"], ["MIT", "ISC"], []),
        ("", ["A"], [], ["t", "u"]),
        ("text/x-c", ["MIT", "A"], ["MIT", "B"], None),
    ]
    files = spark.createDataFrame(
        rows, "file_type string, licenses array<string>, mapped_licenses array<string>, tags array<string>"
    )
    done = analysis.analyze(files)
    got = {(r.metric, r.key): r.n for r in done.collect()}
    assert got == {
        ("doc_count", "all"): 4, ("file_types", "text/x-c"): 2, ("file_types", "None"): 2,
        ("single_license", "MIT"): 1, ("single_license", "A"): 1, ("multiple_license", "A"): 2,
        ("multiple_license", "B"): 1, ("multiple_license", "MIT"): 1, ("mapped_single_license", "MIT"): 1,
        ("mapped_multiple_license", "MIT"): 2, ("mapped_multiple_license", "ISC"): 1,
        ("mapped_multiple_license", "B"): 1, ("tags", "t"): 2, ("tags", "u"): 1,
    }
    names = lambda df: {r.license for r in df.collect()}
    assert names(analysis.licenses_with_min_samples(done, 2)) == {"MIT"}
    assert names(analysis.licenses_with_min_samples(done, 3)) == set()
    assert names(analysis.top_licenses(done, 1)) == {"MIT"}
    assert names(analysis.unique_licenses(done, mapped=False)) == {"MIT", "A", "B"}
    assert {r.license: r.n for r in analysis.combined_counts(done).collect()} == {"MIT": 3, "ISC": 1, "B": 1}
    lines = {r.percent_line for r in analysis.report_lines(done).where("metric = 'tags'").collect()}
    assert lines == {"t : 50.00%", "u : 25.00%"}
    store.save_analysis(done, str(tmp_path / "analysis"))
    assert store.load_analysis(spark, str(tmp_path / "analysis")).count() == len(got)
    store.save_statistics(done, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == len(got) - 1
    empty = analysis.analyze(files.limit(0))
    assert analysis.percentages(empty).count() == 0


def test_files_on_disk(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.c").write_bytes(b"// caf\xe9 \x85 x")
    (tmp_path / "in" / "sub" / "b.py").write_bytes(b"# hi")
    (tmp_path / "in2").mkdir()
    (tmp_path / "in2" / "c.c").write_bytes(b"no")
    got = {r.path: r.content for r in file_source.read_contents(spark, str(tmp_path / "in")).collect()}
    assert got == {"a.c": "// caf\xe9 \x85 x", "sub/b.py": "# hi"}
    assert [r.path for r in file_source.read_contents(spark, str(tmp_path / "in" / "a.c")).collect()] == ["a.c"]
    below = file_source.read_contents(spark, str(tmp_path / "in" / "sub"), base=str(tmp_path))
    assert [r.path for r in below.collect()] == ["in/sub/b.py"]
    assert file_source.read_files(spark, str(tmp_path / "in"), "*.py").count() == 1
    files = spark.createDataFrame([("a",), ("b",)], "path string")
    contents = spark.createDataFrame([("a", "x")], "path string, content string")
    assert {tuple(r) for r in file_source.with_content(files, contents).collect()} == {("a", "x"), ("b", None)}
    assert [r.path for r in file_source.missing_content(files, contents).collect()] == ["b"]


def test_findings_meet_their_files(spark, tmp_path):
    """From findings with relative paths and files on disk to types, words and tags."""
    (tmp_path / "corpus" / "lib").mkdir(parents=True)
    header = "/*\n" + " * Licensed under the MIT License, copyright of the authors.\n" * 200 + " */\n"
    (tmp_path / "corpus" / "lib" / "long header").write_text(header + "#include <stdio.h>\nint main() { return 0; }\n")
    (tmp_path / "corpus" / "b.py").write_text("# Licensed under the Old Name License\nprint('other words')\n")
    files = spark.createDataFrame(
        [("Conclusion", "lib/long header", ["MIT"]), ("Conclusion", "b.py", ["Old Name"]), ("Conclusion", "gone.c", ["MIT"])],
        "kind string, path string, licenses array<string>",
    )
    names = spark.createDataFrame([("Old Name", ["New-1.0"])], "old string, new array<string>")
    contents = file_source.read_contents(spark, str(tmp_path / "corpus"))
    got = {r.path: r for r in update.prepare_files(files, contents, names).collect()}
    assert {p: r.file_type for p, r in got.items()} == {"lib/long header": fv.C, "b.py": fv.PYTHON, "gone.c": fv.UNKNOWN_TYPE}
    assert got["lib/long header"].license_related_words[:5] == "licensed under the mit license".split()
    assert "new" not in got["b.py"].license_related_words and got["b.py"].mapped_licenses == ["New-1.0"]
    assert fv.LRW in got["b.py"].tags and fv.LRW not in got["gone.c"].tags
    assert [r.path for r in file_source.missing_content(files, contents).collect()] == ["gone.c"]


def test_texts_of_renamed_licenses(spark):
    files = spark.createDataFrame(
        [("a", ["Old Name"], "the text")], "path string, licenses array<string>, text string"
    )
    names = spark.createDataFrame([("Old Name", ["New-1.0"])], "old string, new array<string>")
    texts = store.license_texts(mapping.map_licenses(files, names))
    assert [(r.license, r.text) for r in texts.collect()] == [("New-1.0", "the text")]


@pytest.mark.parametrize("name", ["license_map", "analysis_all", "sample_multi", "cap_per_license"])
def test_plans_are_lazy(spark, sf_dir, name, monkeypatch):
    """Building a query runs no job but the short ones that read the schema of its tables."""
    from licspark.workload import queries

    tracker = spark.sparkContext.statusTracker()
    if name == "sample_multi":
        stored = queries._training_files(spark, sf_dir)
        monkeypatch.setattr(queries, "_training_files", lambda *_: stored)
    queries.inputs.table(spark, sf_dir, "lineitem")
    spark.sparkContext.setJobGroup("lazy", name)
    try:
        queries.QUERIES[name](spark, sf_dir)
        jobs = tracker.getJobIdsForGroup("lazy")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 8


def test_hamming_loss_without_labels(spark):
    none = spark.createDataFrame([("a", [])], "path string, labels array<string>")
    assert evaluation.hamming_loss(none, none).first()[0] is None


def test_license_texts(spark):
    files = spark.createDataFrame(
        [("a", ["MIT"], "mit text"), ("b", ["MIT"], "later"), ("c", ["A", "B"], "two"), ("d", ["ISC"], None)],
        "path string, licenses array<string>, text string",
    )
    texts = store.license_texts(files)
    assert [(r.license, r.text) for r in texts.collect()] == [("MIT", "mit text")]
    names = spark.createDataFrame([("MIT",), ("X-1",)], "license string")
    got = {r.license: r.text for r in store.look_up_texts(names, texts).collect()}
    assert got == {"MIT": "mit text", "X-1": fv.LICENSE_TEXT_FALLBACK}


def test_predictions_as_json(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.c", ["MIT", "ISC"])], "path string, licenses array<string>")
    store.save_predictions(rows, str(tmp_path / "out"))
    lines = [line for f in (tmp_path / "out").glob("*.txt") for line in f.read_text().splitlines()]
    assert [json.loads(x) for x in lines] == [{"filename": "a/b.c", "licenses": ["MIT", "ISC"]}]


def test_damaged_findings_keep_their_text(spark, tmp_path):
    lines = ['{"seq": 1, "path": "a", "source": "CONCLUSION", "licenses": ["MIT"], "more": 1}', '{"seq": 2, "path": "b"', "no json", "", '{"seq": "x", "path": "c"}', "{}"]
    (tmp_path / "lines.json").write_text("\n".join(lines))
    checked = finding_source.read_checked_findings(spark, str(tmp_path / "lines.json"))
    assert {(r.seq, r.path) for r in finding_source.sound_findings(checked).collect()} == {(1, "a"), (None, None)}
    bad = finding_source.damaged_lines(checked).collect()
    assert {r.line for r in bad} == {lines[1], lines[2], lines[4]} and {r.problem for r in bad} == {"damaged line"}
