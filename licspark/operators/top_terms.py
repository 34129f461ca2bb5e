"""The most frequent n-grams, exact, without a shuffle of every distinct n-gram.

A first pass adds all n-grams up in a fixed number of buckets by hash: the sum of a
bucket bounds the count of each of its terms from above. A second pass counts the terms
of the largest buckets exactly. If the k-th best of them is no smaller than the largest
bound left out, no other term can belong to the answer; else every bucket whose bound
reaches that k-th count is counted in a third pass. Only terms of counted buckets are
shuffled, and nothing is cut or estimated.

Both passes look at Arrow batches of word arrays: each distinct word of a batch is hashed
once, n-grams are named by combined 64-bit hashes, and strings are built for counted
terms alone. A bucket belongs to a term, never the other way round, so equal hashes of two
terms only widen a bound; counts are kept by the string.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from licspark.session import durable

#: Buckets of the first pass: 8 bytes each in a task, one bit each in the second pass.
BUCKETS = 1 << 20
#: The second pass counts the buckets with the largest bounds, so many for each term asked for.
LOOK = 2
_PARTS = 16
#: Words of one slice of a batch: a worker holds some 20 numbers for each of them.
_WORDS = 1 << 18
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(29))


def _slices(column: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """(numbers of the words, distinct words, bounds of the rows) of groups of whole rows with at most _WORDS words, or one longer row."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _WORDS, "right")) - 1)
        coded = column.slice(first, end - first).flatten().dictionary_encode()
        yield coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, offsets[first : end + 1] - offsets[first]
        first = end


def _grams(words: np.ndarray, bounds: np.ndarray, n_max: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, first words, hashes) of all n-grams that stay in their row; `words` are hashes."""
    total = np.zeros(len(words), np.uint64)
    row_end = np.repeat(bounds[1:], np.diff(bounds))
    for n in range(1, n_max + 1):
        if len(words) < n:
            return
        total = total[: len(words) - n + 1] * _STEP + words[n - 1 :]
        at = np.arange(len(total))
        inside = at + n <= row_end[: len(total)]
        yield n, at[inside], _mixed(total[inside] + np.uint64(n))


def _hashed(distinct: pa.Array) -> np.ndarray:
    return pd.util.hash_array(distinct.to_numpy(zero_copy_only=False), categorize=False)


def _words(docs: DataFrame, words: str) -> DataFrame:
    """The word arrays without null words, null rows as empty ones: by a filter, Spark would make the words twice."""
    return docs.select(F.array_compact(F.coalesce(words, F.array().cast("array<string>"))).alias("words"))


def bucket_bounds(docs: DataFrame, words: str = "words", n_max: int = 3, buckets: int = BUCKETS) -> np.ndarray:
    """How many n-grams fall into each bucket.

    Every task sends its sums in _PARTS ranges, which are added up per group of tasks
    and then over all, so ``buckets`` numbers reach the driver whatever the input.
    """
    width = -(-buckets // _PARTS)

    def count(batches):
        total = np.zeros(width * _PARTS, np.int64)
        for batch in batches:
            for numbers, distinct, bounds in _slices(batch.column(0)):
                for _, _, hashes in _grams(_hashed(distinct)[numbers], bounds, n_max):
                    total += np.bincount((hashes % np.uint64(buckets)).astype(np.int64), minlength=len(total))
        if total.any():
            for k in range(_PARTS):
                yield _sums(k, total[k * width : (k + 1) * width])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            for part in batch.column("sums"):
                total += np.frombuffer(part.as_buffer(), np.int64)
        yield _sums(key[0].as_py(), total)

    schema = "part int, sums binary"
    sums = _words(docs, words).mapInArrow(count, schema).withColumn("salt", F.pmod(F.shiftright(F.monotonically_increasing_id(), 33), F.lit(32)))
    once = sums.groupBy("part", "salt").applyInArrow(add, schema)
    out = np.zeros(width * _PARTS, np.int64)
    for row in once.groupBy("part").applyInArrow(add, schema).collect():
        out[row.part * width : (row.part + 1) * width] = np.frombuffer(row.sums, np.int64)
    return out[:buckets]


def _sums(part: int, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([values.tobytes()], pa.binary())], names=["part", "sums"])


def counts_within(docs: DataFrame, chosen: np.ndarray, words: str = "words", n_max: int = 3) -> DataFrame:
    """(term, tf, df), exact, of the n-grams in the chosen buckets (a flag for each); counted per slice before the shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((np.packbits(chosen), len(chosen)))

    def count(batches):
        bits, buckets = shared.value
        inside = np.unpackbits(bits).astype(bool)
        for batch in batches:
            for numbers, distinct, bounds in _slices(batch.column(0)):
                rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                names = distinct.to_numpy(zero_copy_only=False)
                for n, at, hashes in _grams(_hashed(distinct)[numbers], bounds, n_max):
                    at = at[inside[hashes % np.uint64(buckets)]]
                    if not len(at):
                        continue
                    # a term of this slice is the run of the numbers of its words
                    keys, place = _term_numbers(numbers, at, n)
                    tf = np.bincount(keys)
                    df = np.bincount(np.unique(keys * np.int64(len(bounds)) + rows[at]) // len(bounds))
                    parts = [names[numbers[place + k]] for k in range(n)]
                    terms = parts[0] if n == 1 else [" ".join(p) for p in zip(*parts)]
                    yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(tf), pa.array(df)], names=["term", "tf", "df"])

    partial = _words(docs, words).mapInArrow(count, "term string, tf long, df long")
    return partial.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def _term_numbers(numbers: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of each n-gram's term, and the place of one n-gram of each term; exact, by pairs of numbers."""
    keys, place = np.unique(numbers[at], return_inverse=True)[1].astype(np.int64), None
    for k in range(1, n):
        pairs = keys * np.int64(int(numbers.max()) + 1) + numbers[at + k]
        keys = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    place = np.zeros(int(keys.max()) + 1, np.int64)
    place[keys] = at
    return keys, place


def candidate_terms(docs: DataFrame, k: int, words: str = "words", n_max: int = 3, buckets: int = BUCKETS) -> DataFrame:
    """(term, tf, df), exact, of a set of terms that holds the ``k`` most frequent ones, ties included. Words hold no blanks.

    Null rows, null words and rows without words add nothing; with fewer than ``k`` distinct
    terms all of them are candidates. What the driver sees is one number per bucket.
    """
    bounds = bucket_bounds(docs, words, n_max, buckets)
    level = np.partition(bounds, buckets - LOOK * k)[buckets - LOOK * k] if buckets > LOOK * k else 0
    look = bounds >= max(1, level)
    found = durable(counts_within(docs, look, words, n_max))
    best = found.select("tf").orderBy(F.desc("tf")).limit(k).agg(F.count("*"), F.min("tf")).first()
    least = best[1] if best[0] >= k else 1
    # usually empty: the bounds left out are smaller than the k-th count found
    rest = (bounds >= least) & ~look
    return found.unionByName(counts_within(docs, rest, words, n_max)) if rest.any() else found


def top_terms(docs: DataFrame, k: int, words: str = "words", n_max: int = 3, buckets: int = BUCKETS) -> DataFrame:
    """(term, tf, df) of the ``k`` most frequent n-grams; ties go by term."""
    return candidate_terms(docs, k, words, n_max, buckets).orderBy(F.desc("tf"), "term").limit(k)
