"""Counts of the n-grams of each row, over Arrow batches of word arrays.

Each distinct word of a batch is numbered once, n-grams are pairs of numbers, and strings
are built for the distinct terms of a group of rows alone. Words hold no blanks; null words add nothing.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from licspark.operators.top_terms import _slices


def _rows(bounds: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def _counted(rows: np.ndarray, terms: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of the distinct pairs, by row."""
    pairs, tf = np.unique(rows * np.int64(max(1, n_terms)) + terms, return_counts=True)
    return pairs // max(1, n_terms), pairs % max(1, n_terms), tf


class Vocabulary:
    """Terms numbered by their place in a list, to be found among the n-grams of word arrays."""

    def __init__(self, terms: list[str], n_max: int = 3):
        self.size = len(terms)
        split = [(k, t.split(" ")) for k, t in enumerate(terms)]
        split = [(k, w) for k, w in split if len(w) <= n_max]
        words = sorted({w for _, parts in split for w in parts})
        number = {w: k for k, w in enumerate(words)}
        self.words, self.n_words = pa.array(words, pa.string()), max(1, len(words))
        # n-grams are found level by level, each as (its first n - 1 words, its last word)
        self.levels, prefixes = [], {(number[w],): number[w] for w in words}
        for n in range(2, n_max + 1):
            made = {}
            for _, parts in split:
                gram = tuple(number[w] for w in parts)
                if len(gram) >= n:
                    made[gram[:n]] = (prefixes[gram[: n - 1]], gram[n - 1])
            keys = sorted((p * self.n_words + w, gram) for gram, (p, w) in made.items())
            self.levels.append(np.array([k for k, _ in keys], np.int64))
            prefixes = {gram: place for place, (_, gram) in enumerate(keys)}
            self._name(n, prefixes, split, number)
        self._name(1, {(number[w],): number[w] for w in words}, split, number)

    def _name(self, n: int, places: dict, split: list, number: dict) -> None:
        named = np.full(len(places) + 1, -1, np.int64)
        for k, parts in split:
            if len(parts) == n:
                named[places[tuple(number[w] for w in parts)]] = k
        self.__dict__.setdefault("named", {})[n] = named

    def count(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row, number of rows, row, term, count) per group of rows; rows count from the first."""
        first = 0
        for numbers, distinct, bounds in _slices(column):
            known = pc.index_in(distinct, self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            words = known[numbers] if len(numbers) else np.zeros(0, np.int64)
            rows = _rows(bounds)
            at = np.flatnonzero(words >= 0)
            place = words[at]
            found = [(rows[at], self.named[1][place])]
            row_end = bounds[1:]
            for n, keys in enumerate(self.levels, 2):
                # the n-grams whose first n - 1 words begin a term and whose last word is in the same row
                inside = at + n <= row_end[rows[at]]
                at, place = at[inside], place[inside]
                last = words[at + n - 1]
                at, place, last = at[last >= 0], place[last >= 0], last[last >= 0]
                key = place * self.n_words + last
                spot = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
                hit = keys[spot] == key if len(keys) else np.zeros(len(key), bool)
                at, place = at[hit], spot[hit]
                found.append((rows[at], self.named[n][place]))
            row, term = (np.concatenate(parts) for parts in zip(*found))
            yield first, len(bounds) - 1, *_counted(row[term >= 0], term[term >= 0], self.size)
            first += len(bounds) - 1


def _compact(docs: DataFrame, keys: list[str], words: str) -> DataFrame:
    # no filter on the words: Spark would make them twice, once to filter
    return docs.select(*keys, F.coalesce(words, F.array().cast("array<string>")).alias("_words"))


def without_nulls(words: str) -> Column:
    """The word arrays, null rows as empty ones; a null word becomes a blank, which is no word, and no n-gram goes across it."""
    return F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.coalesce(w, F.lit(" ")))


def _column(batch: pa.RecordBatch, place: int) -> pa.Array:
    """The word arrays, without null words."""
    column = batch.column(place)
    if not column.flatten().null_count:
        return column
    return pa.array([[w for w in row if w is not None] for row in column.to_pylist()], pa.list_(pa.string()))


def all_terms(docs: DataFrame, keys: list[str], words: str = "words", n_max: int = 3) -> DataFrame:
    """(keys, term, tf): every n-gram of each row and how often the row has it."""

    def count(batches):
        for batch in batches:
            first = 0
            for numbers, distinct, bounds in _slices(_column(batch, len(keys))):
                at, gram, names = np.arange(len(numbers)), numbers.astype(np.int64), distinct
                rows, width = _rows(bounds), np.int64(max(1, len(distinct)))
                ends = bounds[1:][rows] if len(rows) else bounds[:0]
                for n in range(1, n_max + 1):
                    if n > 1:
                        inside = at + n <= ends[at]
                        at, gram = at[inside], gram[inside]
                        pairs, gram = np.unique(gram * width + numbers[at + n - 1], return_inverse=True)
                        names = pc.binary_join_element_wise(names.take(pa.array(pairs // width)), distinct.take(pa.array(pairs % width)), " ")
                    if not len(at):
                        break
                    row, term, tf = _counted(rows[at], gram, len(names))
                    taken = [batch.column(k).take(pa.array(row + first)) for k in range(len(keys))]
                    yield from _batches([*taken, names.take(pa.array(term)), pa.array(tf, pa.int64())], [*keys, "term", "tf"])
                first += len(bounds) - 1

    return _compact(docs, keys, words).mapInArrow(count, _schema(docs, keys, "tf long"))


def known_terms(docs: DataFrame, keys: list[str], terms: list[str], words: str = "words", n_max: int = 3) -> DataFrame:
    """(keys, term, tf): `all_terms` of a list of terms that is small enough to travel with the tasks."""
    return _known(docs, keys, terms, words, n_max, "tf", lambda rows, terms, tf, n_rows: pa.array(tf, pa.int64()), "tf long")


def tfidf_terms(docs: DataFrame, keys: list[str], terms: list[str], idf: list[float], words: str = "words", n_max: int = 3) -> DataFrame:
    """(keys, term, weight): ``(1 + ln tf) * idf``, each row scaled to length 1."""
    idf = np.asarray(idf, float)

    def weigh(rows, terms, tf, n_rows):
        weights = (1.0 + np.log(tf)) * idf[terms]
        return pa.array(weights / np.sqrt(np.bincount(rows, weights**2, n_rows))[rows])

    return _known(docs, keys, terms, words, n_max, "weight", weigh, "weight double")


def _known(docs, keys, terms, words, n_max, name, value, column) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(list(terms))

    def count(batches):
        vocabulary, names = Vocabulary(shared.value, n_max), pa.array(shared.value, pa.string())
        for batch in batches:
            for first, n_rows, rows, found, tf in vocabulary.count(_column(batch, len(keys))):
                taken = [batch.column(k).take(pa.array(rows + first)) for k in range(len(keys))]
                yield from _batches([*taken, names.take(pa.array(found)), value(rows, found, tf, n_rows)], [*keys, "term", name])

    return _compact(docs, keys, words).mapInArrow(count, _schema(docs, keys, column))


def _schema(docs: DataFrame, keys: list[str], column: str) -> str:
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return ", ".join([*(f"`{k}` {types[k]}" for k in keys), "term string", column])


def _batches(columns: list[pa.Array], names: list[str], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays(columns, names=names)
    for first in range(0, whole.num_rows, rows):
        yield whole.slice(first, rows)
