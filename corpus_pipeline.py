"""Pipeline over `documents`: quality, language, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps with the columns of
`documents`; the last one returns the packed pieces.
"""

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

import licspark
from licspark.llm.bestfit import best_fit_packing
from licspark.llm.boosted_quality import keep_good, train_quality
from licspark.llm.language_bayes import keep_known, train_languages
from licspark.llm.ngram_jaccard import distinct_documents
from licspark.session import new_table_path

cloudpickle.register_pickle_by_value(licspark)

#: A language is believed from this probability on.
MIN_LANGUAGE_SCORE = 0.5


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose predicted quality is 0."""
    return keep_good(docs, train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def language_identification(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, those whose language stays in doubt, and those stranger than any learned language."""
    return keep_known(docs, train_languages(docs), MIN_LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates, one with the smallest doc_id."""
    return distinct_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents left into bins; none of them is a near duplicate of another."""
    return best_fit_packing(docs.withColumn("_cluster", F.lit(None).cast("string")), cluster="_cluster")


STAGES = [
    ("quality classifier", quality_classifier),
    ("language ID", language_identification),
    ("n-gram Jaccard join", near_duplicates),
    ("best-fit packing", packing),
]
#: SQL can express none of the two classifiers; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's rows are a table that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        path = new_table_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
