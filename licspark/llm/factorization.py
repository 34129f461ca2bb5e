"""Toxicity: a factorization machine over hashed terms.

The score of a text is a bias, a weight per term and, for each pair of terms, the
product of their vectors, so a pair can count more, or less, than its parts. It is
fitted on a bounded sample of labelled rows (SAMPLE_ROWS) and on every hashed term in
it: no term is chosen or dropped beforehand. L2 keeps chance small. The prior of a
weight is as wide as the term's smoothed log odds, never zero, so that the many words a
text has to itself do not explain its label; the prior of a vector knows no label, only
how many rows hold the term, so two neutral terms can still be toxic together.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from licspark.llm import textops
from licspark.llm.labelled import labelled_sample

#: Labelled rows used for fitting, at most.
SAMPLE_ROWS = 20_000
BUCKETS = 1 << 20
FACTORS = 8
#: Rows' worth of the common odds that a term's own odds are smoothed by; least variance of a weight.
SMOOTH, LEAST = 20.0, 0.02
STEPS, BATCH, RATE = 1500, 256, 0.02
#: Penalties, in rows.
L2, L2_PAIRS = 0.5, 1.0
THRESHOLD = 0.5
_SIGN = np.zeros(256, bool)
_SIGN[48:58] = _SIGN[65:91] = _SIGN[97:123] = _SIGN[0x80:] = True


def term_sets(column: pa.Array):
    """(first row, end row, buckets sorted and distinct within each text, bounds). Terms are runs of letters and digits, A-Z lower-cased."""
    for first, end, data, offsets in textops.slices(column):
        starts, ends, bounds = textops.runs(_SIGN[data], offsets)
        hashes = textops.span_hashes(data, starts, ends, textops.LOWER_CODES) % np.uint64(BUCKETS)
        yield first, end, *textops.sorted_sets(hashes.astype(np.int64), bounds)


def _row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the rows of `values` between the bounds; each depends on its own rows only."""
    out = np.zeros((len(bounds) - 1, values.shape[1]), values.dtype)
    some = bounds[:-1] < bounds[1:]
    if some.any():
        out[some] = np.add.reduceat(values, bounds[:-1][some], axis=0)
    return out


class Machine:
    """bias, term buckets (sorted), weights and vectors of the terms."""

    def __init__(self, bias: float, terms: np.ndarray, weights: np.ndarray, vectors: np.ndarray):
        self.bias, self.terms, self.weights, self.vectors = bias, terms, weights, vectors

    def parts(self) -> tuple:
        """Plain arrays, for a broadcast that workers without this package can read."""
        return self.bias, self.terms, self.weights, self.vectors

    def logits(self, buckets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Scores of texts given as sorted term buckets, before the logistic function."""
        out = np.full(len(bounds) - 1, self.bias)
        if not len(self.terms) or not len(buckets):
            return out
        at = np.minimum(np.searchsorted(self.terms, buckets), len(self.terms) - 1)
        hit = self.terms[at] == buckets
        at, bounds = at[hit], np.concatenate(([0], np.cumsum(hit)))[bounds]
        out += _row_sums(self.weights[at].astype(float)[:, None], bounds)[:, 0]
        vectors = self.vectors[at].astype(float)
        return out + ((_row_sums(vectors, bounds) ** 2).sum(axis=1) - _row_sums((vectors**2).sum(axis=1)[:, None], bounds)[:, 0]) / 2


def fit_machine(rows: list[tuple[int, list[int]]], terms: np.ndarray) -> Machine:
    """Fit on (label, places of its terms in `terms`) rows; deterministic."""
    bounds = np.concatenate(([0], np.cumsum([len(places) for _, places in rows]))).astype(np.int64)
    places = np.array([p for _, places in rows for p in places], np.int64)
    return _fit(np.array([label for label, _ in rows], np.float32), places, bounds, terms)


def _batches(y: np.ndarray, places: np.ndarray, bounds: np.ndarray, order: np.ndarray):
    """Rows in groups of BATCH: labels, bounds of their entries, distinct terms, place of each entry among these; rows of the entries by term, and each term's first one."""
    sizes = np.diff(bounds)
    for first in range(0, len(order), BATCH):
        part = order[first : first + BATCH]
        cuts = np.concatenate(([0], np.cumsum(sizes[part])))
        terms, own = np.unique(places[np.arange(cuts[-1]) + np.repeat(bounds[part] - cuts[:-1], sizes[part])], return_inverse=True)
        by_term = np.argsort(own, kind="stable")
        back = np.repeat(np.arange(len(part)), sizes[part])[by_term]
        yield y[part], cuts, terms, own.astype(np.int32), back.astype(np.int32), np.searchsorted(own[by_term], np.arange(len(terms)))


def _fit(y: np.ndarray, places: np.ndarray, bounds: np.ndarray, terms: np.ndarray) -> Machine:
    """Adam on the log loss and the penalties; a step touches only the terms of its rows, so it costs as much as they are long."""
    share = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
    rng = np.random.default_rng(7)
    held = np.bincount(places, minlength=len(terms))
    toxic = np.bincount(places, np.repeat(y, np.diff(bounds)), minlength=len(terms))
    bias = np.log(share / (1 - share))
    odds = np.log((toxic + SMOOTH * share) / (held - toxic + SMOOTH * (1 - share))) - bias
    # weights and vectors are parameters of variance 1 times these
    scale = np.empty((len(terms), 1 + FACTORS), np.float32)
    scale[:, 0] = np.sqrt(odds**2 + LEAST)
    scale[:, 1:] = ((held / np.maximum(held + len(places) / max(len(y), 1), 1)) ** 2)[:, None]
    state = np.concatenate([np.zeros((len(terms), 1)), rng.normal(0, 0.01, (len(terms), FACTORS))], axis=1).astype(np.float32)
    first, second, firsts, seconds = np.zeros_like(state), np.zeros_like(state), 0.0, 0.0
    penalty = np.array([L2] + [L2_PAIRS] * FACTORS, np.float32)
    learns = len(places) and 0 < y.sum() < len(y)
    batches = list(_batches(y, places, bounds, rng.permutation(len(y)))) if learns else []
    # a term's penalty is shared by the batches that hold it
    shares = np.bincount(np.concatenate([b[2] for b in batches]), minlength=len(terms)).astype(np.float32) if learns else None
    order = np.zeros(0, np.int64)
    for step in range(1, 1 + (STEPS if learns else 0)):
        if not len(order):
            order = rng.permutation(len(batches))
        (labels, cuts, some, own, back, starts), order = batches[order[0]], order[1:]
        now, wide = state[some], scale[some]
        values = now * wide
        inside = values[own]
        sums = _row_sums(inside, cuts)
        squares = _row_sums((inside[:, 1:] ** 2).sum(axis=1)[:, None], cuts)[:, 0]
        logit = bias + sums[:, 0] + ((sums[:, 1:] ** 2).sum(axis=1) - squares) / 2
        error = (1 / (1 + np.exp(-np.clip(logit, -50, 50))) - labels).astype(np.float32)
        pushed = sums * error[:, None]
        pushed[:, 0] = error
        gradient = np.add.reduceat(pushed[back], starts, axis=0) if len(some) else np.zeros_like(now)
        gradient[:, 1:] -= values[:, 1:] * gradient[:, :1]
        gradient = gradient * wide + penalty * now / shares[some][:, None]
        rate = RATE * (1 - step / (STEPS + 1))
        first[some] = low = 0.9 * first[some] + 0.1 * gradient
        second[some] = high = 0.999 * second[some] + 0.001 * gradient**2
        state[some] = now - rate * (low / (1 - 0.9**step)) / (np.sqrt(high / (1 - 0.999**step)) + 1e-8)
        firsts, seconds = 0.9 * firsts + 0.1 * error.mean(), 0.999 * seconds + 0.001 * error.mean() ** 2
        bias -= rate * (firsts / (1 - 0.9**step)) / (np.sqrt(seconds / (1 - 0.999**step)) + 1e-8)
    state *= scale
    return Machine(float(bias), terms, state[:, 0].copy(), state[:, 1:].copy())


def train_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = SAMPLE_ROWS) -> Machine:
    """Fit on at most `max_rows` labelled rows: `docs` (doc_id, text), `labels` (doc_id, label).

    The distinct term buckets of the sampled rows, all of them, come to the driver.
    Without labels the model is a constant.
    """

    def work(batches):
        for batch in batches:
            for first, end, buckets, bounds in term_sets(batch.column("text")):
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(buckets.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, end - first), batch.column("label").slice(first, end - first), lists], names=["doc_id", "label", "terms"]
                )

    sample = labelled_sample(docs, labels, label, max_rows).select("doc_id", "label", "text").mapInArrow(work, "doc_id long, label int, terms array<int>").toArrow()
    lists = sample.column("terms").combine_chunks()
    buckets, sizes = np.asarray(lists.flatten()).astype(np.int64), np.asarray(lists.value_lengths())
    bounds = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    # the order of rows must not depend on tasks
    sets = textops.sums_by(textops.mixed(buckets.astype(np.uint64) + np.uint64(1)), bounds)
    order = np.lexsort((sets, np.asarray(sample.column("doc_id"))))
    starts, sizes = bounds[:-1][order], sizes[order]
    bounds = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    buckets = buckets[np.arange(bounds[-1]) + np.repeat(starts - bounds[:-1], sizes)]
    terms, places = np.unique(buckets, return_inverse=True)
    return _fit(np.asarray(sample.column("label"))[order].astype(np.float32), places, bounds, terms)


def score_toxicity(docs: DataFrame, model: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (probability of label 1) and predicted (1 from `threshold` on) per row of `docs` (doc_id, text; others are ignored).

    A null text is scored as an empty one. Equal texts have equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.parts())

    def work(batches):
        model = Machine(*shared.value)
        for batch in batches:
            for first, end, buckets, bounds in term_sets(batch.column("text")):
                score = 1 / (1 + np.exp(-np.clip(model.logits(buckets, bounds), -500, 500)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, end - first), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                    names=["doc_id", "score", "predicted"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, score double, predicted int")
