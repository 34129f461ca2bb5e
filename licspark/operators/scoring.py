"""Linear and naive Bayes scoring as joins and sums."""

from pyspark.sql import Column, DataFrame, functions as F

from licspark.operators.hot_join import hot_join
from licspark.session import durable


def linear_scores(features: DataFrame, weights: DataFrame, bias: DataFrame, key: str = "path") -> DataFrame:
    """Score per (document, label): ``b + sum(weight * x)``, and ``d`` per unit of x where bias has a column ``d``.

    ``features``: key, term, x; a stored table, since it is read several times. ``weights``:
    term, per_label = array of (label, w), a row per term. ``bias`` has one row per label of
    the model. Terms without weights count nothing. Hot terms meet their weights in a
    broadcast of bounded rows and are not shuffled (`hot_join`); sums are combined inside
    each task, so a document sends about one row per label through one shuffle.
    """
    default = F.col("d") if "d" in bias.columns else F.lit(0.0)
    labels = bias.agg(F.sort_array(F.collect_list(F.struct("label", "b", default.cast("double").alias("d"))))).scalar()
    pairs = hot_join(features.select(key, "term", "x"), weights.select("term", "per_label"), "term")
    of_label = lambda label, w: F.struct(label.cast("string").alias("label"), w.cast("double").alias("w"))
    # the null label adds up x over known terms; so every document keeps a row, known terms or not
    known = of_label(F.lit(None), F.when(F.col("per_label").isNotNull(), 1.0).otherwise(0.0))
    hits = F.transform(F.coalesce("per_label", F.array()), lambda p: of_label(p["label"], p["w"]))
    sums = (
        pairs.select(key, "x", F.inline(F.concat(F.array(known), hits)))
        .groupBy(key, "label")
        .agg(F.sum(F.col("w") * F.col("x")).alias("dot"))
    )
    named = F.col("label").isNotNull()
    dots = sums.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.when(named, F.struct("label", "dot")))).alias("dots"),
        F.sum(F.when(~named, F.col("dot"))).alias("length"),
    )
    seen = F.coalesce(F.try_element_at("dots", F.col("label")), F.lit(0.0))
    return dots.select(key, "dots", "length", F.inline(labels)).select(
        key, "label", (F.col("b") + seen + F.col("d") * F.col("length")).alias("score")
    )


def chain_decisions(margins: DataFrame, labels: list[str], links: list[list[float]], key: str = "path") -> DataFrame:
    """(key, labels): the labels that a classifier chain predicts from margins (key, label, score).

    Label k is predicted when its margin plus ``links[k][j]`` of every predicted label j
    before it is positive. The chain runs inside the row, over as many margins as there are
    labels; labels without a margin and margins of other labels count nothing.
    """
    position = F.array_position(F.array(*map(F.lit, labels)), F.col("label")).cast("int") - 1
    rows = margins.withColumn("_k", position).groupBy(key).agg(
        F.sort_array(F.collect_list(F.when(F.col("_k") >= 0, F.struct("_k", "score")))).alias("_margins")
    )
    weights = F.array(*[F.array(*map(F.lit, map(float, row))) for row in links])

    def step(found, m):
        before = F.aggregate(found, F.lit(0.0), lambda total, j: total + F.get(F.get(F.col("_links"), m["_k"]), j))
        return F.when(m["score"] + before > 0, F.concat(found, F.array(m["_k"]))).otherwise(found)

    predicted = F.aggregate("_margins", F.array().cast("array<int>"), step)
    names = F.array(*map(F.lit, labels))
    return rows.withColumn("_links", weights).select(key, F.transform(predicted, lambda k: F.get(names, k)).alias("labels"))


def best_label(scores: DataFrame, key: str = "path") -> DataFrame:
    """Label with the highest score; the first by name on ties."""
    best = F.min_by("label", F.struct(-F.col("score"), F.col("label")))
    return scores.groupBy(key).agg(best.alias("label"))


def per_term(weights: DataFrame) -> DataFrame:
    """(term, label, w) to one row per term."""
    return weights.groupBy("term").agg(
        F.sort_array(F.collect_list(F.struct("label", "w"))).alias("per_label")
    )


def naive_bayes_counts(terms: DataFrame) -> DataFrame:
    """(label, term, n) from (label, path, term, tf)."""
    return terms.groupBy("label", "term").agg(F.sum("tf").alias("n"))


def naive_bayes(counts: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Smoothed log probabilities ``w`` of the multinomial model for the seen (label, term) pairs.

    Every other pair of a label and a term of the model has the label's default ``d``,
    so the full grid is never built.
    """
    return counts.join(naive_bayes_defaults(counts, alpha), "label").select(
        "label", "term", (F.log(F.col("n") + F.lit(alpha)) - F.log("smoothed")).alias("w"), "d"
    )


def naive_bayes_defaults(counts: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(label, smoothed, d) per label: smoothed number of words, and log probability of a term not seen with it."""
    n_terms = counts.agg(F.count_distinct("term").alias("v")).scalar()
    totals = counts.groupBy("label").agg(F.sum("n").alias("total"))
    smoothed = F.col("total") + F.lit(alpha) * n_terms
    return totals.select("label", smoothed.alias("smoothed"), (F.log(F.lit(alpha)) - F.log(smoothed)).alias("d"))


def naive_bayes_priors(docs: DataFrame) -> DataFrame:
    """Log share of every label. ``docs``: path, label."""
    per_label = docs.groupBy("label").agg(F.count("*").alias("n"))
    total = docs.agg(F.count("*").alias("n")).scalar()
    return per_label.select("label", F.log(F.col("n").cast("double") / total).alias("b"))


def svm_certificate(
    features: DataFrame, truth: DataFrame, weights: DataFrame, bias: DataFrame, penalty: Column, tolerance: float, key: str = "path"
) -> DataFrame:
    """(label, objective, subgradient, n_violated, n_free): how far given one-versus-rest SVMs are from their optimum.

    ``features``: key, term, x (a stored table). ``truth``: key, label, a row per document,
    with or without features. ``weights``: term, label, w. ``bias``: label, b, a row per
    class. The objective is the mean hinge loss plus ``penalty`` / 2 times the squared
    weights. Documents whose margin differs from 1 by ``tolerance`` or less lie at the
    kink: they pull with any share from 0 to 1, so each component of the subgradient is an
    interval. ``subgradient`` is the largest distance of such an interval, the intercept's
    among them, from zero; at the optimum it is zero.
    """
    classes = bias.agg(F.collect_list(F.struct("label", "b"))).scalar()
    scores = linear_scores(features, per_term(weights), bias.select("label", "b"), key).select(key, "label", "score")
    every = truth.select(key, F.col("label").alias("_own"), F.inline(classes))
    sign = F.when(F.col("label").eqNullSafe(F.col("_own")), 1.0).otherwise(-1.0)
    margins = durable(
        every.join(scores, [key, "label"], "left")
        .select(key, "label", sign.alias("y"), (sign * F.coalesce("score", "b")).alias("m"))
    )
    free = F.abs(F.col("m") - 1) <= tolerance
    violated = (F.col("m") < 1) & ~free
    losses = margins.groupBy("label").agg(
        F.avg(F.greatest(F.lit(0.0), 1 - F.col("m"))).alias("loss"),
        F.count(F.when(violated, 1)).alias("n_violated"),
        F.count(F.when(free, 1)).alias("n_free"),
    )
    pulls = margins.where(violated | free).groupBy(key).agg(F.collect_list(F.struct("label", "y", free.alias("free"))).alias("pulls"))
    # the intercept is a term without a name that every document has once
    entries = features.select(key, "term", "x").unionByName(truth.select(key, F.lit(None).cast("string").alias("term"), F.lit(1.0).alias("x")))
    pull = F.col("y") * F.col("x")
    sums = (
        entries.join(pulls, key)
        .select("term", "x", F.inline("pulls"))
        .groupBy("label", "term")
        .agg(
            F.sum(F.when(~F.col("free"), pull).otherwise(0.0)).alias("fixed"),
            F.sum(F.when(F.col("free"), F.least(pull, F.lit(0.0))).otherwise(0.0)).alias("least"),
            F.sum(F.when(F.col("free"), F.greatest(pull, F.lit(0.0))).otherwise(0.0)).alias("most"),
        )
    )
    n = truth.agg(F.count("*")).scalar()
    whole = sums.join(weights.select("label", "term", "w"), ["label", "term"], "full").fillna(0.0, ["fixed", "least", "most", "w"])
    low = penalty * F.col("w") - (F.col("fixed") + F.col("most")) / n
    high = penalty * F.col("w") - (F.col("fixed") + F.col("least")) / n
    steep = whole.groupBy("label").agg(
        F.max(F.greatest(F.lit(0.0), low, -high)).alias("subgradient"), F.sum(F.col("w") * F.col("w")).alias("squares")
    )
    squares = F.coalesce("squares", F.lit(0.0))
    return losses.join(steep, "label", "left").select(
        "label",
        (F.col("loss") + penalty / 2 * squares).alias("objective"),
        F.coalesce("subgradient", F.lit(0.0)).alias("subgradient"),
        "n_violated",
        "n_free",
    )
