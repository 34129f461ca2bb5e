"""Linear classification problems: one label per file, or a chain of yes/no labels."""

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from licspark import fixed_values as fv
from licspark.operators import svm
from licspark.operators.features import vocabulary
from licspark.operators.vectors import word_classes


def indicator(labels: str, classes: list[str]) -> Column:
    """0/1 per class."""
    return F.transform(
        F.array(*map(F.lit, classes)), lambda c: F.array_contains(F.col(labels), c).cast("int")
    )


def from_indicator(flags: Column, classes: list[str]) -> Column:
    """Class names whose flag is 1."""
    names = F.array(*map(F.lit, classes))
    return F.filter(F.transform(flags, lambda f, i: F.when(f == 1, F.get(names, i))), lambda x: x.isNotNull())


class Problem:
    """A named, fitted step: words in, class names out.

    A linear model is a table: one row per class and one per term.
    """

    def __init__(self, name, classes, terms, idf, coefficients, intercepts, links=None):
        self.name, self.classes, self.terms = name, list(classes), list(terms)
        self.idf, self.coefficients = np.asarray(idf), np.asarray(coefficients)
        self.intercepts = np.asarray(intercepts)
        self.links = None if links is None else np.asarray(links)

    def predict(self, df: DataFrame, words: str, output: str) -> DataFrame:
        """Append ``output``: an array of names (one name for single-label problems)."""
        found = word_classes(df, words, self.terms, self.idf, self.coefficients, self.links, self.intercepts)
        names = F.array(*map(F.lit, self.classes))
        named = df.withColumn("_found", found).withColumn(
            output, F.transform("_found", lambda i: F.get(names, i))
        )
        return named.select(*df.columns, output)

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """Weights (term, label, w) that are not zero, and (label, b); links of a chain are left out."""
        at = np.argwhere(self.coefficients)
        rows = [(self.terms[t], self.classes[k], float(self.coefficients[k, t])) for k, t in at.tolist()]
        bias = [(c, float(b)) for c, b in zip(self.classes, self.intercepts)]
        return spark.createDataFrame(rows, "term string, label string, w double"), spark.createDataFrame(bias, "label string, b double")

    def config(self) -> dict:
        return {"kind": "single" if self.links is None else "chain", "classes": self.classes}

    def save(self, spark: SparkSession, path: str) -> None:
        terms = [(t, float(w)) for t, w in zip(self.terms, self.idf)]
        links = [None] * len(self.classes) if self.links is None else self.links.tolist()
        rows = zip(range(len(self.classes)), self.classes, self.coefficients.tolist(), self.intercepts.tolist(), links)
        spark.createDataFrame(terms, "term string, idf double").write.mode("overwrite").parquet(
            f"{path}/{self.name}/terms"
        )
        spark.createDataFrame(
            list(rows),
            "position int, class string, coefficients array<double>, intercept double, links array<double>",
        ).write.mode("overwrite").parquet(f"{path}/{self.name}/classes")

    @classmethod
    def load(cls, spark: SparkSession, path: str, name: str) -> "Problem":
        """Read a model back; its size is bounded by classes times terms."""
        terms = spark.read.parquet(f"{path}/{name}/terms").orderBy("term").collect()
        rows = spark.read.parquet(f"{path}/{name}/classes").orderBy("position").collect()
        links = None if rows[0]["links"] is None else [r["links"] for r in rows]
        return cls(
            name,
            [r["class"] for r in rows],
            [t["term"] for t in terms],
            [t["idf"] for t in terms],
            [r["coefficients"] for r in rows],
            [r["intercept"] for r in rows],
            links,
        )


def _prepare(samples: DataFrame, labels: Column, max_features: int):
    """Terms, their idf, the stored rows of the samples (see `svm.stored_rows`), and their number.

    Only the vocabulary (at most ``max_features`` rows) comes to the driver. Every label must have a name.
    """
    vocab = vocabulary(samples, "words", max_features).select("term", "idf").collect()
    vocab = sorted((r["term"], r["idf"]) for r in vocab)
    terms, idf = [t for t, _ in vocab], np.array([w for _, w in vocab])
    rows = svm.stored_rows(samples, labels, terms, idf)
    n_rows, unnamed = rows.agg(F.count("*"), F.count_if(F.col("labels").isNull() | F.exists("labels", lambda c: c.isNull()))).first()
    if unnamed:
        raise ValueError(f"{unnamed} samples have a null label")
    return terms, idf, rows, n_rows


def _classes(rows: DataFrame) -> list[str]:
    """Class names, in order; they are the only rows collected."""
    return [r[0] for r in rows.select(F.explode("labels")).distinct().orderBy("col").collect()]


def fit_single(
    samples: DataFrame,
    name: str = "SP",
    max_features: int = fv.MAX_FEATURES,
    max_iter: int = 50,
    parallelism: int = svm.SIDE_BY_SIDE,
) -> Problem:
    """One-versus-rest linear SVM. ``samples``: path, words, label. ``parallelism`` classes share the passes over the rows."""
    terms, idf, rows, n_rows = _prepare(samples, F.array("label"), max_features)
    classes = _classes(rows)
    fitted = list(svm.Fit(rows, classes, idf, n_rows, chained=False).fit(max_iter, parallelism))
    return Problem(name, classes, terms, idf, [w for w, _ in fitted], [b for _, b in fitted])


def fit_chain(
    samples: DataFrame, name: str = "MP", max_features: int = fv.MAX_FEATURES, max_iter: int = 50
) -> Problem:
    """Classifier chain: label k sees the labels before it. ``samples``: path, words, labels.

    In the samples these labels are known, so all classes are fitted side by side.
    """
    terms, idf, rows, n_rows = _prepare(samples, F.array_distinct("labels"), max_features)
    classes = _classes(rows)
    fitted = list(svm.Fit(rows, classes, idf, n_rows, chained=True).fit(max_iter)) if classes else []
    return Problem(
        name, classes, terms, idf, [w[: len(terms)] for w, _ in fitted], [b for _, b in fitted],
        np.array([w[len(terms) :] for w, _ in fitted]).reshape(len(classes), len(classes)),
    )


def fit_from_labels(samples: DataFrame, name: str, **options) -> Problem:
    """``fit_single`` for samples whose ``labels`` array holds exactly one name."""
    return fit_single(samples.withColumn("label", F.get("labels", F.lit(0))), name, **options)


# Problem name -> training function; other names (license families) use the chain.
TRAINERS = {"SP": fit_from_labels, "MP": fit_chain, "DP": fit_single}
