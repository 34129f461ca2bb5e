"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are fitted on a bounded sample of labelled rows (SAMPLE_ROWS), and flattened
into arrays: all documents of a batch go down one level of one tree per numpy step.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from licspark.llm import textops
from licspark.llm.docstats import CLASSES, Stats, class_counts
from licspark.llm.labelled import labelled_sample

#: Labelled rows used for fitting, at most.
SAMPLE_ROWS = 20_000
BINS = 64
TREES, DEPTH, RATE = 80, 4, 0.15
MIN_WEIGHT, L2 = 2.0, 1.0
#: A document is kept from this score on.
THRESHOLD = 0.3

FEATURES = (
    "words", "characters", "word length", "long words", "words with letters", "capitalised words", "distinct words", "most frequent word",
    "repeated windows", "repeated words", "lines", "words per line", "duplicate lines", "immediate repeats", *CLASSES,
)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Statistics of each text of a slice, (texts, FEATURES); finite for empty texts too."""
    stats = Stats(data, offsets)
    words = np.maximum(stats.n_words, 1)
    kinds = class_counts(data, offsets)
    lines, duplicates = stats.lines()
    distinct, most = stats.distinct_words()
    long_words = _where(stats.ends - stats.starts > 15, stats.bounds)
    first = data[stats.starts]
    capital = _where((first >= 65) & (first <= 90), stats.bounds)
    again = np.zeros(len(stats.hashes), bool)
    again[1:] = stats.hashes[1:] == stats.hashes[:-1]
    again[stats.bounds[:-1][stats.n_words > 0]] = False
    columns = [
        np.log1p(stats.n_words),
        np.log1p(stats.n_chars),
        stats.word_chars / words,
        long_words / words,
        stats.words_with_letters() / words,
        capital / words,
        distinct / words,
        most / words,
        stats.repeated_words(3) / words,
        stats.repeated_words(8) / words,
        np.log1p(lines),
        words / np.maximum(lines, 1),
        duplicates / np.maximum(lines, 1),
        _where(again, stats.bounds) / words,
        *(kinds / np.maximum(stats.n_chars, 1)[:, None]).T,
    ]
    return np.stack(columns, axis=1).astype(np.float32)


def _where(member: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(member)))
    return total[bounds[1:]] - total[bounds[:-1]]


class Trees:
    """Complete binary trees in arrays: feature and threshold per inner node, value per leaf."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.threshold, self.leaf = base, feature, threshold, leaf

    def parts(self) -> tuple:
        """Plain arrays, for a broadcast that workers without this package can read."""
        return self.base, self.feature, self.threshold, self.leaf

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for the log loss; splits are searched in histograms of BINS quantile bins."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    share = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
    base = float(np.log(share / (1 - share)))
    shape = (0 if len(y) < 2 or y.min() == y.max() else TREES)
    feature, threshold, leaf = np.zeros((shape, inner), np.int64), np.full((shape, inner), np.inf, np.float32), np.zeros((shape, leaves))
    if not shape:
        return Trees(base, feature, threshold, leaf)
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1]).astype(np.float32)) for column in x.T]
    bins = np.stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, x.T)])
    score = np.full(len(y), base)
    for t in range(shape):
        p = 1 / (1 + np.exp(-score))
        gradient, weight = p - y, p * (1 - p)
        node, first = np.zeros(len(y), np.int64), 0
        for level in range(DEPTH):
            width = 2**level
            local = node - first
            best = np.zeros(width)
            for f, c in enumerate(cuts):
                code = local * BINS + bins[f]
                g = np.bincount(code, gradient, width * BINS).reshape(width, BINS).cumsum(axis=1)
                h = np.bincount(code, weight, width * BINS).reshape(width, BINS).cumsum(axis=1)
                all_g, all_h = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + L2) + (all_g - g) ** 2 / (all_h - h + L2) - all_g**2 / (all_h + L2)
                gain[(h < MIN_WEIGHT) | (all_h - h < MIN_WEIGHT)] = 0
                gain[:, len(c) :] = 0
                at = gain.argmax(axis=1)
                found = gain[np.arange(width), at]
                better = found > best + 1e-9
                best[better] = found[better]
                feature[t, first : first + width][better] = f
                threshold[t, first : first + width][better] = c[at[better]]
            right = x[np.arange(len(y)), feature[t, node]] > threshold[t, node]
            node, first = 2 * node + 1 + right, 2 * first + 1
        local = node - inner
        g, h = np.bincount(local, gradient, leaves), np.bincount(local, weight, leaves)
        leaf[t] = -RATE * g / (h + L2)
        score += leaf[t, local]
    return Trees(base, feature, threshold, leaf)


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = SAMPLE_ROWS) -> Trees:
    """Fit on at most `max_rows` labelled rows: `docs` (doc_id, text), `labels` (doc_id, label).

    Statistics are made by Spark tasks; a row of numbers per sampled document comes to
    the driver. Without labels, or with one class only, the model is a constant.
    """
    width = len(FEATURES)

    def work(batches):
        for batch in batches:
            for first, end, data, offsets in textops.slices(batch.column("text")):
                x = features(data, offsets).astype(np.float64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, end - first), batch.column("label").slice(first, end - first), pa.array(list(x), pa.list_(pa.float64()))],
                    names=["doc_id", "label", "x"],
                )

    rows = labelled_sample(docs, labels, label, max_rows).select("doc_id", "label", "text").mapInArrow(work, "doc_id long, label int, x array<double>").collect()
    rows.sort()
    x = np.array([r.x for r in rows], np.float32).reshape(-1, width)
    return fit_trees(x, np.array([r.label for r in rows], float))


def score_quality(docs: DataFrame, model: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (probability of label 1) and predicted (1 from `threshold` on) per row of `docs` (doc_id, text; others are ignored).

    A null text is scored as an empty one. Equal texts have equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.parts())

    def work(batches):
        model = Trees(*shared.value)
        for batch in batches:
            for first, end, data, offsets in textops.slices(batch.column("text")):
                score = model.probabilities(features(data, offsets))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, end - first), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                    names=["doc_id", "score", "predicted"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, with all their columns, whose text scores `threshold` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model.parts())
    at = docs.columns.index("text")

    def work(batches):
        model = Trees(*shared.value)
        for batch in batches:
            for first, end, data, offsets in textops.slices(batch.column(at).cast(pa.string())):
                yield batch.slice(first, end - first).filter(pa.array(model.probabilities(features(data, offsets)) >= threshold))

    return docs.mapInArrow(work, docs.schema)
