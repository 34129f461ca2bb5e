"""Quality of predictions against known labels."""

from pyspark.sql import DataFrame, functions as F


def _compared(truth: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """One row per document with both label sets (one join on the document key)."""
    empty = F.array().cast("array<string>")
    labels = lambda df, name: df.select(key, F.sort_array(F.array_distinct("labels")).alias(name))
    return (
        labels(truth, "actual")
        .join(labels(predicted, "guess"), key, "full")
        .select(key, F.coalesce("actual", empty).alias("actual"), F.coalesce("guess", empty).alias("guess"))
    )


def figures(truth: DataFrame, predicted: DataFrame, key: str = "path") -> DataFrame:
    """Everything the reports need, from one comparison and one grouping.

    A row per label (``label``, tp, fp, fn), and one row for all documents (``documents``
    is true): tp, fp and fn over all labels, n_docs, exact (sets that are right as a
    whole), and the sums p, r, f of each document's own ratios. The
    row of documents is missing if there are none. Store the table to make several reports.
    """
    zero, none = F.lit(0), F.lit(None).cast("string")

    def row(documents, label, tp=zero, fp=zero, fn=zero, n=zero, exact=zero, ratios=(F.lit(0.0),) * 3):
        whole = [c.cast("long").alias(n) for n, c in {"tp": tp, "fp": fp, "fn": fn, "n_docs": n, "exact": exact}.items()]
        return F.struct(F.lit(documents).alias("documents"), label.alias("label"), *whole, *[c.alias(n) for n, c in zip("prf", ratios)])

    one = F.lit(1)
    hits, false, missed = F.array_intersect("actual", "guess"), F.array_except("guess", "actual"), F.array_except("actual", "guess")
    sizes = [F.size(x) for x in (hits, false, missed)]
    rows = F.concat(
        F.array(row(True, none, *sizes, one, (F.col("actual") == F.col("guess")).cast("int"), _ratios(*sizes))),
        F.transform(hits, lambda x: row(False, x, tp=one)),
        F.transform(false, lambda x: row(False, x, fp=one)),
        F.transform(missed, lambda x: row(False, x, fn=one)),
    )
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn", "n_docs", "exact", "p", "r", "f")]
    return _compared(truth, predicted, key).select(F.inline(rows)).groupBy("documents", "label").agg(*sums)


def subset_accuracy(truth: DataFrame, predicted: DataFrame, key: str = "path") -> DataFrame:
    """Share of documents whose label set is exactly right."""
    exact = (F.col("actual") == F.col("guess")).cast("double")
    return _compared(truth, predicted, key).agg(F.avg(exact).alias("accuracy"), F.count("*").alias("n_docs"))


def label_counts(truth: DataFrame, predicted: DataFrame, key: str = "path") -> DataFrame:
    """True positives, false positives and false negatives per label."""
    return figures(truth, predicted, key).where(~F.col("documents")).select("label", "tp", "fp", "fn")


def _ratios(tp, fp, fn):
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a.cast("double") / F.when(b != 0, b))
    return ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(2 * tp, 2 * tp + fp + fn)


def class_report(truth: DataFrame, predicted: DataFrame, key: str = "path") -> DataFrame:
    """Precision, recall, F1 and support per label; undefined ratios are 0."""
    precision, recall, f1 = _ratios(F.col("tp"), F.col("fp"), F.col("fn"))
    return label_counts(truth, predicted, key).select(
        "label",
        precision.alias("precision"),
        recall.alias("recall"),
        f1.alias("f1"),
        (F.col("tp") + F.col("fn")).alias("support"),
    )


def report_averages(truth: DataFrame, predicted: DataFrame, key: str = "path") -> DataFrame:
    """Micro, macro, weighted and per-sample averages as rows, from one comparison of the label sets."""
    of_label = ~F.col("documents")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    support = tp + fn
    own = dict(zip("prf", _ratios(tp, fp, fn)))
    labels = lambda c: F.sum(F.when(of_label, c))
    docs = lambda c: F.sum(F.when(~of_label, c))
    n_labels = F.count(F.when(of_label, F.lit(1)))
    weighted = lambda c: F.try_divide(labels(own[c] * support), labels(support))

    def row(average, ratios, support):
        named = [c.alias(n) for n, c in zip(("precision", "recall", "f1"), ratios)]
        return F.struct(F.lit(average).alias("average"), *named, support.alias("support"))

    rows = F.array(
        row("micro", _ratios(labels(tp), labels(fp), labels(fn)), labels(support)),
        row("macro", [F.try_divide(labels(own[c]), n_labels) for c in "prf"], labels(support)),
        row("weighted", [weighted(c) for c in "prf"], labels(support)),
        row("samples", [F.try_divide(docs(F.col(c)), docs(F.col("n_docs"))) for c in "prf"], docs(support)),
    )
    return figures(truth, predicted, key).agg(rows.alias("rows")).select(F.inline("rows"))


def hamming_loss(truth: DataFrame, predicted: DataFrame, key: str = "path") -> DataFrame:
    """Wrong label decisions over all (document, label) pairs."""
    of_docs = F.col("documents")
    wrong = F.sum(F.when(of_docs, F.col("fp") + F.col("fn")))
    n_labels = F.count(F.when(~of_docs, F.lit(1)))
    n_docs = F.sum(F.when(of_docs, F.col("n_docs")))
    return figures(truth, predicted, key).agg(F.try_divide(wrong, n_docs * n_labels).alias("hamming_loss"))
