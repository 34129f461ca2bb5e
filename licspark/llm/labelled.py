"""Bounded samples of labelled documents for fitting classifiers."""

from pyspark.sql import DataFrame, functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """doc_id, text and label (0 or 1) of at most `max_rows` labelled documents, drawn by a hash of the doc_id.

    The drawn ids are at most `max_rows` numbers, so they are broadcast and the texts
    are not shuffled. Null labels and ids are left out; an id with several labels gets
    their rounded mean, and of several texts under one id each is used.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg(label) >= 0.5).cast("int").alias("label"))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(drawn), "doc_id")
