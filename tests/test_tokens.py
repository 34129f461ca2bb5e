import random

import pytest
from pyspark.sql import functions as F

from licspark.functions import names, tokens, words
from licspark.functions.ngrams import term_counts, word_ngrams
from licspark.functions.porter import add_stem, stem
from licspark.operators.words import add_words, lemmatize

SENTENCE = "This is a sample sentence with @ $characters -_). This is my second !@#$%^&&*()_. AND third"


def one(spark, text, function):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(function(F.col("t"))).first()[0]


def test_lemma_profile(spark):
    lemmas = spark.createDataFrame(
        [("is", "be"), ("characters", "character"), ("second", "2"), ("third", "3")], "token string, lemma string"
    )
    df = spark.createDataFrame([("p", SENTENCE)], "path string, t string")
    df = df.select("path", tokens.word_tokens(F.col("t")).alias("w"))
    want = "this be a sample sentence with character this be my 2 and 3".split()
    assert lemmatize(df, lemmas, ["w"]).first().w == want


def test_lemmas_stay_in_their_row(spark):
    lemmas = spark.createDataFrame([("is", "be"), ("xs", "x")], "token string, lemma string")
    df = spark.createDataFrame([("p", ["is", "it", "is"]), ("q", []), ("p", ["xs"])], "path string, w array<string>")
    got = [(r.path, r.w) for r in lemmatize(df, lemmas, ["w"]).collect()]
    assert got == [("p", ["be", "it", "be"]), ("q", []), ("p", ["x"])]


def test_stem_profile(spark):
    want = "thi is a sampl sentenc with charact . thi is my second . and third".split()
    assert one(spark, SENTENCE, tokens.stemmed_tokens) == want


@pytest.mark.parametrize("text", ["", "   ", None])
@pytest.mark.parametrize("profile", ["lemma", "stem"])
def test_blank_texts(spark, text, profile):
    assert one(spark, text, tokens.TOKEN_PROFILES[profile]) == []


def test_token_steps(spark):
    lst = lambda values, f: spark.createDataFrame([(values,)], "t array<string>").select(f(F.col("t"))).first()[0]
    stop = "yourselves myself ourselves hers off herself".split()
    assert lst(stop, tokens.drop_stop_words) == []
    assert lst(["the", "the", "hers"], tokens.drop_stop_words) == ["the", "the"]
    assert lst(["@b#$", "a!_)#$"], tokens.delete_characters) == ["b", "a"]
    assert lst(["     ", "  ", "        "], tokens.drop_blank) == []
    assert lst(["ab", "a1", "12", "é"], tokens.keep_words) == ["ab", "12", "é"]
    assert one(spark, "This is a blessing License.", tokens.words_and_signs) == "This is a blessing License .".split()


def test_long_text_keeps_all_its_words(spark):
    df = spark.createDataFrame([(1,)], ["n"]).select(F.repeat(F.lit("word "), 400_001).alias("t"))
    assert df.select(F.size(tokens.word_tokens(F.col("t")))).first()[0] == 400_001


@pytest.mark.parametrize(
    "word, want",
    [
        ("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("sing", "sing"),
        ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"),
        ("sky", "sky"), ("relational", "relat"), ("rational", "ration"), ("vietnamization", "vietnam"),
        ("sensibiliti", "sensibl"), ("electriciti", "electr"), ("adoption", "adopt"), ("replacement", "replac"),
        ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("roll", "roll"), ("licenses", "licens"),
        ("generalizations", "gener"), ("oscillators", "oscil"), ("is", "is"),
    ],
)
def test_porter(word, want):
    assert stem(word) == want


def test_stems_of_a_table_equal_those_of_arrays(spark):
    rng = random.Random(1)
    parts = "a e i o u y b c d l s t z w x n r at bl iz ed ing eed s es ies sses ational tion ence izer al ful ness ive ement ion ll e 1 . é".split()
    words = sorted({"".join(rng.choice(parts) for _ in range(rng.randrange(1, 6))) for _ in range(3000)} | {"", "yes", "yyed", "toyed", "ing", "nion", "sation"})
    table = spark.createDataFrame([(w, k) for k, w in enumerate(words)], "token string, w long")
    stems = add_stem(table, "token")
    assert stems.columns == ["token", "w", "stem"]
    assert {r.token: r.stem for r in stems.collect()} == {w: stem(w) for w in words}
    assert "Python" not in stems._jdf.queryExecution().executedPlan().toString()


def test_related_text(spark):
    literals = ["a License", "b", "(C) me", "COPYRIGHT", "public  domain", "public domain"]
    df = spark.createDataFrame([(literals,)], "l array<string>")
    row = df.select(words.related_text(F.col("l")), words.unrelated_text(F.col("l"))).first()
    assert tuple(row) == ("a License\n(C) me\nCOPYRIGHT\npublic domain\n", "b\npublic  domain\n")


def test_words_of_files(spark):
    rows = [
        ("hit", "text/x-c", "// MIT License\nint main();\n\n// other"),
        ("miss", "text/x-c", "// other words\nint main();"),
        ("plain", "unknown filetype", "any text"),
        ("empty", "text/x-c", ""),
        ("null", "text/x-c", None),
    ]
    df = spark.createDataFrame(rows, "path string, file_type string, content string")
    got = {
        r.path: (r.license_related_words, r.no_license_related_words, r.has_lrw_match)
        for r in add_words(df).collect()
    }
    assert got == {
        "hit": (["mit", "license"], ["other"], True),
        "miss": (["other", "words", "int", "main"], ["other", "words"], False),
        "plain": (["any", "text"], None, False),
        "empty": ([], [], False),
        "null": ([], [], False),
    }


def test_ngrams(spark):
    df = spark.createDataFrame([(0, ["a", "b"]), (1, ["a"]), (2, ["c", "c", "c", "d"]), (3, [])], "i int, w array<string>")
    got = {r.i: r.g for r in df.select("i", word_ngrams(F.col("w")).alias("g")).collect()}
    assert got == {0: ["a", "b", "a b"], 1: ["a"], 3: [],
                   2: ["c", "c", "c", "d", "c c", "c c", "c d", "c c c", "c c d"]}
    counts = {r.i: {t.term: t.tf for t in r.g} for r in df.select("i", term_counts(F.col("w")).alias("g")).collect()}
    assert counts == {0: {"a": 1, "b": 1}, 1: {"a": 1}, 2: {"c": 3, "d": 1}, 3: {}}


def test_names(spark):
    rows = [('"MIT "', "MIT", "MIT"), ('"MIT" ', "MIT", 'MIT"'), (" GPL ", "GPL", "GPL"), ('""', "", "")]
    df = spark.createDataFrame(rows, "raw string, want string, faithful string")
    for r in df.select(
        "*", names.clean_license(F.col("raw")).alias("a"), names.clean_license(F.col("raw"), True).alias("b")
    ).collect():
        assert (r.a, r.b) == (r.want, r.faithful)
    assert one(spark, "A.1-b c", names.safe_license_name) == "A_1_bc"
    assert one(spark, "HPND-x", names.generalize_license) == "HPND"
    assert one(spark, "HPNDx", names.generalize_license) == "HPNDx"
    assert [one(spark, p, names.extension) for p in ("a/b.tar.gz", "a.b/c", ".bashrc", "x.")] == [".gz", "", "", "."]


def test_tokens_of_a_corpus_are_replaced_by_position(spark):
    from licspark.operators.words import lemmatize_corpus, stem_corpus

    rows = [(f"p{k}", ["the", "licenses", None, "the", f"w{k}s"], ["granted", "the"], k) for k in range(50)]
    rows += [("empty", [], None, 1), ("null", None, ["licenses"], 2)]
    df = spark.createDataFrame(rows, "path string, a array<string>, b array<string>, value int").repartition(3)
    lemmas = spark.createDataFrame([("licenses", "license"), ("licenses", "zz"), ("the", "THE"), (None, "x")], "token string, lemma string")
    found = {"licenses": "license", "the": "THE"}
    want = {(p, *[None if x is None else tuple(found.get(t, t) for t in x) for x in (a, b)], v) for p, a, b, v in rows}
    got = lemmatize_corpus(df, lemmas, ["a", "b"])
    assert got.columns == df.columns
    assert {(r.path, r.a and tuple(r.a) if r.a else (None if r.a is None else ()), None if r.b is None else tuple(r.b), r.value) for r in got.collect()} == want
    stemmed = {r.path: (r.a, r.b) for r in stem_corpus(df, ["a", "b"]).collect()}
    assert stemmed["p7"] == (["the", stem("licenses"), None, "the", stem("w7s")], [stem("granted"), "the"])
    assert stemmed["empty"] == ([], None) and stemmed["null"] == (None, [stem("licenses")])


def test_update_job_stems_distinct_tokens_without_python(spark):
    from licspark.functions.filetypes import file_type
    from licspark.plans.update import update_files

    files = spark.createDataFrame([("a.py", ["MIT"]), ("b.py", ["MIT"])], "path string, licenses array<string>")
    text = "# Licensed under the MIT licenses, granted to users\nx = 1\n"
    contents = spark.createDataFrame([("a.py", text), ("b.py", text.replace("users", "owners"))], "path string, content string")
    mapping = spark.createDataFrame([("MIT", ["MIT"])], "old string, new array<string>")
    done = update_files(files, contents, mapping, profile="stem")
    assert "ArrowEvalPython" not in done._jdf.queryExecution().executedPlan().toString()
    typed = contents.withColumn("file_type", file_type(F.col("content"), F.col("path")))
    want = {r.path: r.license_related_words for r in add_words(typed, "stem").collect()}
    assert {r.path: r.license_related_words for r in done.collect()} == want
    assert stem("licenses") in want["a.py"]
