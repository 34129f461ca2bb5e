"""Linear SVMs of many classes, fitted side by side over rows that stay in a stored table.

The fit is the one of Spark's ``LinearSVC`` (mean hinge loss, L2 penalty, features scaled by
their deviation and centred, orthant-wise L-BFGS of Breeze with its line search and stopping
rules), but each pass over the rows evaluates all classes at once. Nothing is cached: a task
holds one Arrow batch and one sum per class, so executors need the same memory for any number of rows.
"""

from collections.abc import Generator, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from licspark.operators.term_counts import Vocabulary, without_nulls
from licspark.session import durable

#: Classes of one pass: bounds the sums of a task and what the driver keeps of the last steps.
SIDE_BY_SIDE = 16
#: With more tasks than this their sums are added in groups of tasks before they reach the driver.
TASKS = 64
TOLERANCE = 1e-6
#: Steps that the optimizer remembers.
_MEMORY = 10
#: Counts that are multiplied at a time.
_COUNTS = 1 << 17
_LOGS = 1.0 + np.log(np.maximum(1, np.arange(256)))


# ---------------------------------------------------------------- stored rows


def stored_rows(samples: DataFrame, labels: Column, terms: list[str], idf: np.ndarray, words: str = "words") -> DataFrame:
    """(labels, terms, counts, width, scale) per row, stored: numbers and counts of its known terms, bytes of a count, 1 / length."""
    shared = samples.sparkSession.sparkContext.broadcast((list(terms), np.asarray(idf, float)))
    number = _number_type(len(terms))

    def count(batches):
        names, idf = shared.value
        vocabulary = Vocabulary(names)
        for batch in batches:
            for first, n_rows, rows, found, tf in vocabulary.count(batch.column(1)):
                bounds = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=n_rows))))
                width = 1 if not len(tf) or tf.max() < 256 else 4
                length = np.sqrt(np.bincount(rows, ((1.0 + np.log(tf)) * idf[found]) ** 2, n_rows))
                columns = [
                    batch.column(0).slice(first, n_rows),
                    _binary(found.astype(number), bounds),
                    _binary(tf.astype(f"u{width}"), bounds),
                    pa.array(np.full(n_rows, width, np.int32)),
                    pa.array(1.0 / np.where(length > 0, length, 1.0)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["labels", "terms", "counts", "width", "scale"])

    rows = samples.select(labels.alias("labels"), without_nulls(words).alias("words"))
    return durable(rows.mapInArrow(count, "labels array<string>, terms binary, counts binary, width int, scale double"))


def _number_type(n_terms: int) -> type:
    return np.uint16 if n_terms <= 1 << 16 else np.uint32


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    offsets = pa.py_buffer((bounds * values.itemsize).astype(np.int64))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, offsets, pa.py_buffer(values)]).cast(pa.binary())


def _bytes(column: pa.Array) -> tuple[np.ndarray, pa.Buffer]:
    """Bounds of the values in the buffer that holds them."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    return np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1], data if data is not None else pa.py_buffer(b"")


class Part:
    """Some rows of a batch: term numbers and their weights on end, the scale of each row, and its label positions."""

    def __init__(self, bounds, terms, values, scale, label_rows, label_places):
        self.sizes, self.terms, self.values, self.scale = np.diff(bounds), terms, values, scale
        self.filled = self.sizes > 0
        self.starts = bounds[:-1][self.filled]
        self.label_rows, self.label_places = label_rows, label_places

    def products(self, weights: np.ndarray) -> np.ndarray:
        """Sum of weight x value per row."""
        out = np.zeros(len(self.sizes))
        if len(self.starts):
            out[self.filled] = np.add.reduceat(np.take(weights, self.terms) * self.values, self.starts)
        return out * self.scale

    def sums(self, factors: np.ndarray, n_terms: int) -> np.ndarray:
        """Sum of factor x value per term, over the rows whose factor is not zero."""
        used = factors != 0
        inside = np.repeat(used, self.sizes)
        spread = np.repeat((factors * self.scale)[used], self.sizes[used])
        return np.bincount(self.terms[inside], self.values[inside] * spread, n_terms)


def _parts(batch: pa.RecordBatch, classes: pa.Array, number: type) -> Iterator[Part]:
    labels, widths = batch.column(0), batch.column(3).to_numpy()
    term_ends, term_data = _bytes(batch.column(1))
    count_ends, count_data = _bytes(batch.column(2))
    scale = batch.column(4).to_numpy()
    ends = (term_ends - term_ends[0]) // np.dtype(number).itemsize
    places = pc.index_in(labels.flatten(), classes).to_numpy(zero_copy_only=False).astype(np.int64)
    label_ends = np.concatenate(([0], np.cumsum(pc.list_value_length(labels).to_numpy(zero_copy_only=False))))
    # rows whose counts have one width are on end
    turns = [*(np.flatnonzero(np.diff(widths)) + 1).tolist(), len(widths)]
    first = 0
    for turn in turns:
        while first < turn:
            end = min(turn, max(first + 1, int(np.searchsorted(ends, ends[first] + _COUNTS, "right")) - 1))
            n = int(ends[end] - ends[first])
            terms = np.frombuffer(term_data, number, n, int(term_ends[first])).astype(np.int64) if n else np.zeros(0, np.int64)
            counts = np.frombuffer(count_data, f"u{widths[first]}", n, int(count_ends[first])) if n else np.zeros(0, np.uint8)
            values = _LOGS[counts] if widths[first] == 1 else 1.0 + np.log(counts)
            own = slice(label_ends[first], label_ends[end])
            label_rows = np.repeat(np.arange(end - first), np.diff(label_ends[first : end + 1]))
            yield Part(ends[first : end + 1] - ends[first], terms, values, scale[first:end], label_rows, places[own])
            first = end


def _collected(rows: DataFrame, function, merge) -> dict[int, list[np.ndarray]]:
    """Sums of the tasks by their number, at most TASKS of each: those of more tasks are merged before they reach the driver."""
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    # a task reads its files one after the other, its sums do not grow
    found = rows.coalesce(tasks).mapInArrow(function, _SUMS)
    if tasks > TASKS:
        salt = F.pmod(F.shiftright(F.monotonically_increasing_id(), 33), F.lit(TASKS))
        found = found.withColumn("salt", salt).groupBy("part", "salt").applyInArrow(_adding(merge), _SUMS)
    out = {}
    for row in found.collect():
        out.setdefault(row[0], []).append(np.frombuffer(row[1]))
    return out


def _message(key: int, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([values.tobytes()], pa.binary())], names=["part", "sums"])


_SUMS = "part int, sums binary"


def _adding(merge):
    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for part in batch.column("sums"):
                values = np.frombuffer(part.as_buffer())
                total = values if total is None else merge(key[0].as_py(), total, values)
        yield _message(key[0].as_py(), total)

    return add


def merged_moments(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(count, mean, sum of squared distances from the mean) per term of two sets of values; equal values keep a sum of exactly 0."""
    (n, mean, square), (m, other, more) = a.reshape(3, -1), b.reshape(3, -1)
    total = np.maximum(1, n + m)
    step = np.where(n > 0, other - mean, other)
    mean = np.where(n > 0, mean + step * m / total, other)
    return np.concatenate((n + m, np.where(n + m > 0, mean, 0.0), square + more + np.where(n > 0, step**2 * n * m / total, 0.0)))


def _moments(part: Part, idf: np.ndarray) -> np.ndarray:
    values = part.values * idf[part.terms] * np.repeat(part.scale, part.sizes)
    # distances from one of a term's own values: no rounding where all are equal
    near = np.zeros(len(idf))
    near[part.terms] = values
    distance = values - near[part.terms]
    n, first, second = (np.bincount(part.terms, w, len(idf)) for w in (np.ones(len(values)), distance, distance**2))
    size = np.maximum(1, n)
    return np.concatenate((n, near + first / size, np.maximum(0.0, second - first**2 / size)))


# ------------------------------------------------------------------ optimizer


class _Failed(Exception):
    """A step that cannot be made."""


def _direction(gradient: np.ndarray, steps: list, changes: list) -> np.ndarray:
    """Minus the gradient times the remembered inverse curvature, newest step first."""
    scale = 1.0
    if steps:
        along = steps[0] @ changes[0]
        if not along >= 0:
            raise _Failed
        scale = along / (changes[0] @ changes[0])
    out, shares = gradient.copy(), []
    for step, change in zip(steps, changes):
        shares.append((step @ out) / (step @ change))
        if np.isnan(shares[-1]):
            raise _Failed
        out -= shares[-1] * change
    out *= scale
    for step, change, share in reversed(list(zip(steps, changes, shares))):
        out += (share - (change @ out) / (step @ change)) * step
    return np.where(-out * gradient < 0, -out, 0.0)


def minimum(start: np.ndarray, max_iter: int, tolerance: float = TOLERANCE) -> Generator:
    """The optimizer as a coroutine: it yields points, is sent (value, gradient) of each, and returns the last point.

    Steps, stopping rules and constants are those of Breeze's ``OWLQN`` without an L1 penalty: a coordinate that would change its sign stops at 0.
    """
    x = start
    value, gradient = yield x
    scale, seen, steps, changes, iteration, failed = abs(value), [np.inf], [], [], 0, False
    while iteration < max_iter:
        if len(seen) > 1 and abs(value - max(seen)) <= tolerance * scale:
            break
        if np.linalg.norm(gradient) <= max(tolerance * value, 1e-8):
            break
        try:
            with np.errstate(invalid="ignore", divide="ignore"):
                direction = _direction(gradient, steps, changes)
            orthant = np.where(x != 0, np.sign(x), np.sign(-gradient))

            def at(length):
                to = x + direction * length
                return np.where(np.sign(to) == orthant, to, 0.0)

            slope = float(gradient @ direction)
            length, shrink = (0.5 / np.linalg.norm(gradient), 0.1) if iteration < 1 else (1.0, 0.5)
            # Breeze takes the value before the step for that of the first length, so this length mostly shrinks unseen
            reached, found, pulled = value, None, None
            for turn in range(20):
                if reached > value + length * slope * 1e-4:
                    factor = shrink
                else:
                    if found is None:
                        found = yield at(length)
                        pulled = float(found[1] @ direction)
                    factor = 2.1 if pulled < 0.9 * slope else shrink if pulled > -0.9 * slope else 1.0
                if factor == 1.0 or turn == 19:
                    break
                if not 1e-10 <= length * factor <= 1e10:
                    raise _Failed
                length *= factor
                found = yield at(length)
                reached, pulled = found[0], float(found[1] @ direction)
            new = at(length)
        except _Failed:
            if failed:
                break
            failed, steps, changes = True, [], []
            continue
        failed = False
        steps, changes = [new - x, *steps][:_MEMORY], [found[1] - gradient, *changes][:_MEMORY]
        x, (value, gradient) = new, found
        seen = [*seen, value][-20:]
        iteration += 1
    return x


# ------------------------------------------------------------------------ fit


class Fit:
    """One problem over stored rows: deviations, and value and gradient of the loss of any of its classes."""

    def __init__(self, rows: DataFrame, classes: list[str], idf: np.ndarray, n_rows: int, chained: bool):
        self.rows, self.classes, self.idf, self.n_rows = rows, list(classes), np.asarray(idf, float), n_rows
        self.context, self.number = rows.sparkSession.sparkContext, _number_type(len(idf))
        # cost 1 per row, as a sum, equals a penalty of 1/n on the mean
        self.penalty, self.n_links = 1.0 / n_rows, len(classes) if chained else 0
        self._measure()

    def _measure(self) -> None:
        """Mean and deviation of the terms, and of the labels that later classes see."""
        shared, number, n_links = self.context.broadcast((self.classes, self.idf)), self.number, self.n_links

        def measure(batches):
            classes, idf = shared.value
            names, total = pa.array(classes, pa.string()), np.zeros(3 * len(idf))
            labels = np.zeros(n_links)
            for batch in batches:
                for part in _parts(batch, names, number):
                    total = merged_moments(total, _moments(part, idf))
                    if n_links:
                        labels += np.bincount(part.label_places, minlength=n_links)
            yield _message(0, total)
            yield _message(1, labels)

        found = _collected(self.rows, measure, lambda part, a, b: a + b if part else merged_moments(a, b))
        total = np.zeros(3 * len(self.idf))
        for values in found.get(0, []):
            total = merged_moments(total, values)
        n, mean, square = total.reshape(3, -1)
        labels = sum(found.get(1, []), np.zeros(n_links))
        n, mean, square = np.concatenate((n, labels)), np.concatenate((mean, labels > 0)), np.concatenate((square, np.zeros(n_links)))
        square = square + mean**2 * n * (self.n_rows - n) / self.n_rows
        deviation = np.sqrt(square / (self.n_rows - 1)) if self.n_rows > 1 else np.zeros(len(n))
        with np.errstate(divide="ignore"):
            self.inverse = np.where(deviation > 0, 1.0 / deviation, 0.0)
        self.centre = mean * n / self.n_rows * self.inverse
        shared.destroy()

    def _weights(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """Coefficients of the features as they are, and the intercept."""
        return x[:-1] * self.inverse, float(x[-1] - x[:-1] @ self.centre)

    def losses(self, points: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray]]:
        """(value, gradient) of some classes, each at its point, by one pass over the rows."""
        asked = []
        for k, x in points.items():
            weights, intercept = self._weights(x)
            asked.append((k, weights[: len(self.idf)] * self.idf, weights[len(self.idf) :], intercept))
        shared, number, n_terms, n_links = self.context.broadcast((self.classes, asked)), self.number, len(self.idf), self.n_links

        def add(batches):
            classes, asked = shared.value
            names, sums = pa.array(classes, pa.string()), np.zeros((len(asked), 2 + n_terms + n_links))
            for batch in batches:
                for part in _parts(batch, names, number):
                    for total, (k, weights, links, intercept) in zip(sums, asked):
                        margins = part.products(weights) + intercept
                        if n_links:
                            margins += np.bincount(part.label_rows, links[part.label_places], len(margins))
                        truth = np.full(len(margins), -1.0)
                        truth[part.label_rows[part.label_places == k]] = 1.0
                        missing = 1.0 - truth * margins
                        factors = np.where(missing > 0, -truth, 0.0)
                        total[0] += missing[missing > 0].sum()
                        total[1] += factors.sum()
                        total[2 : 2 + n_terms] += part.sums(factors, n_terms)
                        if n_links:
                            total[2 + n_terms :] += np.bincount(part.label_places, factors[part.label_rows], n_links)
            for total, (k, *_) in zip(sums, asked):
                yield _message(k, total)

        found = _collected(self.rows, add, lambda k, a, b: a + b)
        shared.destroy()
        return {k: self._objective(k, x, sum(found[k])) for k, x in points.items()}

    def _objective(self, k: int, x: np.ndarray, sums: np.ndarray) -> tuple[float, np.ndarray]:
        loss, pull, slopes = sums[0], sums[1], sums[2:].copy()
        slopes[: len(self.idf)] *= self.idf
        shrunk = self.penalty * x[:-1] * self.inverse**2
        gradient = (slopes * self.inverse - pull * self.centre) / self.n_rows + shrunk
        # a class sees the labels before it alone
        gradient[len(self.idf) + k :] = 0.0
        return float(loss / self.n_rows + 0.5 * (x[:-1] @ shrunk)), np.concatenate((gradient, [pull / self.n_rows]))

    def fit(self, max_iter: int, side_by_side: int = SIDE_BY_SIDE) -> Iterator[tuple[np.ndarray, float]]:
        """(coefficients, intercept) per class: of the terms, then of the labels."""
        for first in range(0, len(self.classes), side_by_side):
            group = range(first, min(first + side_by_side, len(self.classes)))
            searches = {k: minimum(np.zeros(len(self.inverse) + 1), max_iter) for k in group}
            points, ends = {k: next(search) for k, search in searches.items()}, {}
            while points:
                for k, answer in self.losses(points).items():
                    try:
                        points[k] = searches[k].send(answer)
                    except StopIteration as end:
                        ends[k] = end.value
                        del points[k]
            yield from (self._weights(ends[k]) for k in group)
