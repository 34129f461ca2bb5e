"""Update job: file type, mapped licenses, words and tags of every file."""

from pyspark.sql import DataFrame, functions as F

from licspark import fixed_values as fv
from licspark.functions.filetypes import file_type
from licspark.operators.holdout import tag_holdout
from licspark.operators.mapping import map_licenses
from licspark.operators.tags import derived_tags, no_tags
from licspark.operators.words import add_words, lemmatize_corpus, stem_corpus
from licspark.session import durable

WORDS = ["license_related_words", "no_license_related_words"]


def update_files(
    files: DataFrame,
    contents: DataFrame,
    mapping: DataFrame,
    lemmas: DataFrame | None = None,
    profile: str = "lemma",
    source: str = "segments",
    faithful_mapping: bool = False,
) -> DataFrame:
    """Files with content to fully described files; ``source="comment"`` uses the best comment.

    Texts are read once and turned into words where they lie; only the words
    meet the files by path, so the corpus text itself is never shuffled. Lemmas and
    stems are found once per distinct token, from a stored table of the words. Files
    without content keep their licenses and get no words.
    """
    typed = contents.select("path", "content").withColumn("file_type", file_type(F.col("content"), F.col("path")))
    worded = add_words(typed, profile, source, raw=True).drop("content")
    if lemmas is not None and profile == "lemma":
        worded = lemmatize_corpus(durable(worded), lemmas, WORDS)
    elif profile == "stem":
        worded = stem_corpus(durable(worded), WORDS)
    mapped = map_licenses(files.drop("file_type", "has_lrw_match", *WORDS), mapping, faithful_mapping)
    described = (
        mapped.join(worded, "path", "left")
        .withColumn("file_type", F.coalesce("file_type", F.lit(fv.UNKNOWN_TYPE)))
        .withColumn(WORDS[0], F.coalesce(WORDS[0], F.array().cast("array<string>")))
    )
    tags = F.col("tags") if "tags" in files.columns else no_tags()
    return described.withColumn(
        "tags",
        derived_tags(
            tags,
            F.col("mapped_licenses"),
            F.col("license_related_words"),
            F.col("no_license_related_words"),
        ),
    )


def prepare_files(files: DataFrame, contents: DataFrame, mapping: DataFrame, **options) -> DataFrame:
    """Update job followed by the hold-out tag."""
    return tag_holdout(update_files(files, contents, mapping, **options))
