"""Prediction: route, classify, refine. One pass over the rows, no shuffle, so it also streams."""

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from licspark import fixed_values as fv
from licspark.functions.filetypes import file_type
from licspark.operators.vectors import add_counts, routed_classes
from licspark.operators.words import add_words, lemmatize
from licspark.plans.model import FamilyLicenseModel, LicenseModel
from licspark.sources.files import read_contents


def decide(words: Column, route: Column, single: Column, multi: Column) -> Column:
    """Final licenses from the route and the results of both branches."""
    unclassified = F.array(F.lit(fv.UNCLASSIFIED))
    filled = lambda x: F.when(F.coalesce(F.size(x) > 0, F.lit(False)), x).otherwise(unclassified)
    return (
        F.when(F.coalesce(F.size(words), F.lit(0)) <= 0, unclassified)
        .when(route == fv.MULTI, filled(multi))
        .when(route == fv.SINGLE, filled(single))
        .when(route == fv.NO_LICENSE, F.array(F.lit(fv.NO_LICENSE)))
        .otherwise(unclassified)
    )


def refine(licenses: Column, refined: dict[str, Column]) -> Column:
    """Replace a family name by its refined labels, in place; empty refinements keep the name."""

    def replaced(name):
        out = F.array(name)
        for family, labels in refined.items():
            out = F.when(
                (name == family) & F.coalesce(F.size(labels) > 0, F.lit(False)), labels
            ).otherwise(out)
        return out

    return F.flatten(F.transform(licenses, replaced))


def _blocks(model: LicenseModel) -> tuple[list[str], list[str], list[tuple], dict]:
    """Names of the problems, the dictionary of all their terms, a block of columns for each, and which class leads to which block."""
    families = model.families if isinstance(model, FamilyLicenseModel) else []
    names = ["DP", "SP", "MP", *families]
    problems = [model.problems[name] for name in names]
    terms = sorted(set().union(*(p.terms for p in problems)))
    number = {t: k for k, t in enumerate(terms)}
    blocks = []
    for p in problems:
        places = np.array([number[t] for t in p.terms], np.int64)
        order = np.argsort(places)
        blocks.append((places[order], p.idf[order], p.coefficients.reshape(len(p.classes), -1)[:, order], p.links, p.intercepts))
    follow = {(0, k): [1 if c == fv.SINGLE else 2] for k, c in enumerate(problems[0].classes) if c in (fv.SINGLE, fv.MULTI)}
    for b in (1, 2):
        follow |= {(b, k): [3 + families.index(c)] for k, c in enumerate(problems[b].classes) if c in families}
    return names, terms, blocks, follow


def predict_words(df: DataFrame, model: LicenseModel, words: str = "words") -> DataFrame:
    """Add ``route`` and ``licenses``.

    Terms are counted once per row over the dictionary of all problems, and one Python step
    asks routing first, then only the problems that a row's route and family lead to.
    """
    names, terms, blocks, follow = _blocks(model)
    nothing = F.array().cast("array<string>")
    has_words = F.coalesce(F.size(words) > 0, F.lit(False))
    counted = add_counts(df.withColumn("_words", F.coalesce(F.col(words), nothing)), terms, "_words", "_counts")
    found = counted.withColumn("_found", routed_classes(counted, "_counts", blocks, follow))

    def named(b: int) -> Column:
        classes = F.array(*map(F.lit, model.problems[names[b]].classes))
        return F.transform(F.get("_found", F.lit(b)), lambda i: F.get(classes, i))

    out = found.withColumn("route", F.when(has_words, F.get(named(0), F.lit(0))))
    out = out.withColumn("licenses", decide(F.col("_words"), F.col("route"), named(1), named(2)))
    if len(names) > 3:
        out = out.withColumn("licenses", refine(F.col("licenses"), {names[b]: named(b) for b in range(3, len(names))}))
    return out.select(*df.columns, "route", "licenses")


def model_words(contents: DataFrame, model: LicenseModel) -> DataFrame:
    """(path, content) to (path, words), made as for the training files of the model."""
    typed = contents
    if "file_type" not in contents.columns:
        typed = contents.withColumn("file_type", file_type(F.col("content"), F.col("path")))
    worded = add_words(typed, model.profile, model.source)
    if model.lemmas is not None and model.profile == "lemma":
        worded = lemmatize(worded, model.lemmas, ["license_related_words"])
    return worded.select("path", F.col("license_related_words").alias("words"))


def predict_contents(contents: DataFrame, model: LicenseModel) -> DataFrame:
    """(path, content) to (path, route, licenses)."""
    return predict_words(model_words(contents, model), model).select("path", "route", "licenses")


def scan_files(spark, path: str, model: LicenseModel, pattern: str | None = None, base: str | None = None) -> DataFrame:
    """Predict the licenses of all files under a folder; paths are relative to ``base`` (default: the folder)."""
    return predict_contents(read_contents(spark, path, pattern, base), model)
