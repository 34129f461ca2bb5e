"""Vocabulary and TF-IDF weights."""

from pyspark.sql import DataFrame, functions as F

from licspark import fixed_values as fv
from licspark.operators.term_counts import all_terms, known_terms, tfidf_terms
from licspark.operators.top_terms import top_terms


def document_terms(docs: DataFrame, key: str = "path", words: str = "words", n_max: int = 3) -> DataFrame:
    """(key, term, tf): n-gram counts of each row; nothing is shuffled."""
    return all_terms(docs, [key], words, n_max)


def term_statistics(terms: DataFrame) -> DataFrame:
    """Corpus and document frequency per term, combined before the shuffle."""
    return terms.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


def vocabulary(
    docs: DataFrame,
    words: str = "words",
    max_features: int = fv.MAX_FEATURES,
    n_max: int = 3,
) -> DataFrame:
    """The most frequent terms with smoothed inverse document frequency.

    ``idf = ln((1 + n) / (1 + df)) + 1``; ties in frequency go by term.
    """
    n_docs = docs.agg(F.count("*").alias("n_docs")).scalar()
    idf = F.log((n_docs + 1.0) / (F.col("df") + 1.0)) + 1.0
    return top_terms(docs, max_features, words, n_max).withColumn("idf", idf)


def tfidf(
    docs: DataFrame,
    vocab: DataFrame,
    key: str = "path",
    words: str = "words",
    n_max: int = 3,
) -> DataFrame:
    """(key, term, weight): ``(1 + ln tf) * idf``, each document scaled to length 1.

    The vocabulary is limited by ``max_features``, so its rows come to the driver and
    travel with the tasks: no shuffle.
    """
    known = vocab.where("term is not null and idf is not null").select("term", "idf").collect()
    return tfidf_terms(docs, [key], [r.term for r in known], [r.idf for r in known], words, n_max)


def vocabulary_terms(
    docs: DataFrame, vocab: DataFrame, keys: list[str], words: str = "words", n_max: int = 3
) -> DataFrame:
    """(keys, term, tf) of the terms of a vocabulary, which is limited as for `tfidf`."""
    return known_terms(docs, keys, [r.term for r in vocab.where("term is not null").select("term").collect()], words, n_max)
