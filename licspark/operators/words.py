"""Words of files: segments, license-related tokens, lemmas."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from licspark import fixed_values as fv
from licspark.functions import words as w
from licspark.functions.comments import license_comment_literals
from licspark.functions.segments import segments
from licspark.functions.porter import add_stem, stem_tokens
from licspark.functions.tokens import raw_profile
from licspark.operators.hot_join import hot_join
from licspark.operators.lookup import found, lookup_value
from licspark.session import durable

#: A table of so many tokens still travels with the tasks.
IN_ROWS = 50_000


def add_literals(files: DataFrame, source: str = "segments") -> DataFrame:
    """Add ``literals``: segment bodies, or the best license comment (``source="comment"``)."""
    content, file_type = F.col("content"), F.col("file_type")
    if source == "comment":
        literals = license_comment_literals(content, file_type)
    else:
        literals = segments(content, file_type)["body"]
    return files.withColumn("literals", F.coalesce(literals, F.array().cast("array<string>")))


def add_words(files: DataFrame, profile: str = "lemma", source: str = "segments", raw: bool = False) -> DataFrame:
    """Add license-related and other words to files with content and file_type; ``raw`` words are not stemmed yet."""
    tokenize = raw_profile(profile)
    content, literals = F.col("content"), F.col("literals")
    matched = w.license_words(content, literals, tokenize)
    # Python functions cannot stand inside the expressions over literals, so stems come last
    last = stem_tokens if profile == "stem" and not raw else lambda tokens: tokens
    return (
        add_literals(files, source)
        .withColumn("license_related_words", last(w.words_or_whole_text(content, matched, tokenize)))
        .withColumn("no_license_related_words", last(w.no_license_words(content, literals, tokenize)))
        .withColumn("has_lrw_match", F.exists("literals", lambda x: x.rlike(fv.LRW_PATTERN)))
        .drop("literals")
    )


def replaced_in_rows(files: DataFrame, columns: list[str], values: dict[str, str]) -> DataFrame:
    """`replaced_tokens` by a table that travels with the tasks: no row is shuffled."""
    shared = files.sparkSession.sparkContext.broadcast(values)

    @F.arrow_udf("array<string>")
    def replace(arrays: pa.Array) -> pa.Array:
        coded = arrays.flatten().dictionary_encode()
        changed = [shared.value.get(t, t) for t in coded.dictionary.to_pylist()]
        tokens = pa.array(changed, pa.string()).take(coded.indices)
        sizes = pc.list_value_length(arrays).fill_null(0).to_numpy(zero_copy_only=False)
        bounds = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
        return pa.ListArray.from_arrays(bounds, tokens, mask=pc.is_null(arrays))

    return files.withColumns({c: replace(c) for c in columns})


def replaced_tokens(files: DataFrame, columns: list[str], table: DataFrame, key: str = "path") -> DataFrame:
    """``files`` with each token of the array columns replaced by its value in ``table`` (token, value; tokens are unique).

    A token without a value stays, null arrays stay null. ``key`` is unique in ``files``.
    A table of at most IN_ROWS tokens is looked up where the files lie, but for files with a repeated or null key. With a larger one, tokens meet the table in a join on the token: a frequent token meets it in a
    broadcast of bounded rows where it lies, a rare one by a shuffle (`hot_join`). Arrays
    are rebuilt by position; the other columns meet them by key. ``files`` is read
    twice, so pass a stored table where it is costly.
    """

    few = table.where("token is not null and value is not null").limit(IN_ROWS + 1).collect()
    if len(few) > IN_ROWS:
        return _replaced_by_join(files, columns, table, key)
    changed = {r.token: r.value for r in few}
    repeated = durable(files.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n")).where("_n > 1 or _key is null").select("_key"))
    if repeated.isEmpty():
        return replaced_in_rows(files, columns, changed)
    same = F.col(key).eqNullSafe(F.col("_key"))
    alone = replaced_in_rows(files.join(repeated, same, "left_anti"), columns, changed)
    return alone.unionByName(_replaced_by_join(files.join(repeated, same, "left_semi"), columns, table, key))


def _replaced_by_join(files: DataFrame, columns: list[str], table: DataFrame, key: str) -> DataFrame:
    """`replaced_tokens` by joins; rows that share a key share their tokens, too, and those without a key get none."""

    def places(n, column):
        return F.transform(
            F.coalesce(column, F.array().cast("array<string>")),
            lambda t, i: F.struct(F.lit(n).alias("_array"), i.alias("_place"), t.alias("_token")),
        )

    tokens = F.concat(*[places(n, c) for n, c in enumerate(columns)])
    placed = durable(files.select(key, F.inline(tokens)))
    values = hot_join(placed, table.select(F.col("token").alias("_token"), F.col("value").alias("_value")), "_token")
    value = F.coalesce("_value", "_token")
    rebuilt = values.groupBy(key).agg(
        *[
            F.sort_array(F.collect_list(F.when(F.col("_array") == n, F.struct("_place", value.alias("_value"))))).alias(f"_a{n}")
            for n in range(len(columns))
        ]
    )
    joined = files.join(rebuilt, key, "left")
    arrays = {
        c: F.when(F.col(c).isNotNull(), F.coalesce(F.col(f"_a{n}")["_value"], F.array().cast("array<string>")))
        for n, c in enumerate(columns)
    }
    return joined.withColumns(arrays).select(*files.columns)


def corpus_tokens(files: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct tokens of the array columns, combined before their shuffle."""
    arrays = F.concat(*[F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))) for c in columns])
    return files.select(F.explode(arrays).alias("token")).where("token is not null").distinct()


def lemmatize_corpus(files: DataFrame, lemmas: DataFrame, columns: list[str], key: str = "path") -> DataFrame:
    """`replaced_tokens` by a lemma table of any size; of several lemmas the first by name counts."""
    unique = lemmas.where("token is not null").groupBy("token").agg(F.min("lemma").alias("value"))
    return replaced_tokens(files, columns, unique, key)


def stem_corpus(files: DataFrame, columns: list[str], key: str = "path") -> DataFrame:
    """`replaced_tokens` by stems: each distinct token of the corpus is stemmed once, by SQL expressions."""
    stems = add_stem(corpus_tokens(files, columns), "token").select("token", F.col("stem").alias("value"))
    return replaced_tokens(files, columns, durable(stems), key)


def lemmatize(files: DataFrame, lemmas: DataFrame, columns: list[str]) -> DataFrame:
    """Replace the tokens of array columns by their lemmas, inside each row.

    For streams, and for models that carry their lemma table: it travels with the
    plan. A batch job uses `lemmatize_corpus`. Of several lemmas the first by name counts.
    """
    unique = lemmas.groupBy("token").agg(F.min("lemma").alias("lemma"))
    table = F.col("_lookup")
    replaced = {c: F.transform(c, lambda t: F.coalesce(found(table, t), t)) for c in columns}
    return files.withColumn("_lookup", lookup_value(unique, "token", "lemma")).withColumns(replaced).drop("_lookup")
