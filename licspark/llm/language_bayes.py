"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from licspark.llm import textops

BUCKETS = 1 << 14
SIZES = (1, 2, 3)
#: Added to each count.
SMOOTHING = 0.5
UNKNOWN = "und"
#: Languages whose counts a task holds before it sends them on.
HELD = 256
#: How far the mean log share of a text's n-grams may lie below that of its language: a base
#: for topic and style, and a number of standard deviations of the mean.
STRANGE = (2.5, 4.0)


def _folding() -> np.ndarray:
    """For each code point its lower-case letter, or 32 for anything that is no letter; built once per worker."""
    cache = textops.worker_cache("folding")
    if "table" not in cache:
        table = np.full(0x110000, 32, np.uint32)
        for k in (*range(0xD800), *range(0xE000, 0x110000)):
            sign = chr(k)
            if sign.isalpha():
                table[k] = ord(sign.lower()[0])
        cache["table"] = table
    return cache["table"]


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of all texts, and each text's bounds."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return _folding()[points], lead[offsets]


def gram_buckets(folded: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams that hold a letter, grouped by text, and each text's bounds."""
    n = len(folded)
    if not n:
        return np.zeros(0, np.uint16), np.zeros(len(bounds), np.int64)
    # places left in the text, so that no n-gram leaves it
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)
    hashes, lettered = np.zeros(n, np.uint32), np.zeros(n, bool)
    columns, keep = np.zeros((n, len(SIZES)), np.uint16), np.zeros((n, len(SIZES)), bool)
    column = 0
    for size in range(1, max(SIZES) + 1):
        m = n - size + 1
        if m <= 0:
            break
        hashes[:m] = (hashes[:m] ^ folded[size - 1 :]) * np.uint32(0x9E3779B1)
        lettered[:m] |= folded[size - 1 :] != 32
        if size in SIZES:
            columns[:m, column] = ((hashes[:m] ^ (hashes[:m] >> np.uint32(15))) * np.uint32(0x85EBCA77)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
            keep[:m, column] = lettered[:m] & (left[:m] >= size)
            column += 1
    per_place = np.concatenate(([0], np.cumsum(keep.sum(axis=1))))
    return columns[keep], per_place[bounds]


class LanguageModel:
    """Languages, log shares of buckets (buckets, languages) and log shares of languages.

    Also what a language's own text gives per n-gram: the mean log share, and its variance.
    """

    def __init__(self, languages: list[str], weights: np.ndarray, prior: np.ndarray, mean: np.ndarray, variance: np.ndarray):
        self.languages, self.weights, self.prior, self.mean, self.variance = languages, weights, prior, mean, variance

    @classmethod
    def from_counts(cls, languages: list[str], counts: np.ndarray, texts: np.ndarray) -> "LanguageModel":
        """`counts` (languages, buckets) of n-grams, and `texts` of each language."""
        if not languages:
            return cls([], np.zeros((BUCKETS, 0)), np.zeros(0), np.zeros(0), np.zeros(0))
        smooth = counts.T + SMOOTHING
        share = smooth / smooth.sum(axis=0)
        weights = np.log(share)
        mean = (share * weights).sum(axis=0)
        return cls(languages, weights, np.log(texts / texts.sum()), mean, (share * (weights - mean) ** 2).sum(axis=0))

    def parts(self) -> tuple:
        """Plain arrays, for a broadcast that workers without this package can read."""
        return self.languages, self.weights, self.prior, self.mean, self.variance


def train_languages(docs: DataFrame) -> LanguageModel:
    """Counts over all rows of `docs` (text, lang) with a text and a lang.

    Each task adds up its rows per language; the parts meet in two steps. Only
    languages x BUCKETS counts come to the driver.
    """

    def sent(found):
        pack = zstandard.ZstdCompressor(level=1)
        return pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.string()), pa.array([pack.compress(v.tobytes()) for v in found.values()], pa.binary())], names=["lang", "counts"]
        )

    def count(batches):
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for first, end, data, offsets in textops.slices(batch.column("text")):
                buckets, bounds = gram_buckets(*letters(data, offsets))
                names, codes = np.unique(np.array(langs[first:end]), return_inverse=True)
                code = np.repeat(codes, np.diff(bounds))
                for k, name in enumerate(names.tolist()):
                    total = found.setdefault(name, np.zeros(BUCKETS + 1, np.int64))
                    total[:BUCKETS] += np.bincount(buckets[code == k], minlength=BUCKETS)
                    total[BUCKETS] += int((codes == k).sum())
                    if len(found) >= HELD:
                        yield sent(found)
                        found = {}
        if found:
            yield sent(found)

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for part in batch.column("counts"):
                total += np.frombuffer(zstandard.ZstdDecompressor().decompress(part.as_py()), np.int64)
        packed = zstandard.ZstdCompressor(level=1).compress(total.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.string()), pa.array([packed], pa.binary())], names=["lang", "counts"])

    rows = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    parts = rows.mapInArrow(count, "lang string, counts binary")
    salted = parts.withColumn("part", F.pmod(F.shiftright(F.monotonically_increasing_id(), 33), F.lit(32)))
    once = salted.groupBy("lang", "part").applyInArrow(add, "lang string, counts binary")
    found = sorted(once.groupBy("lang").applyInArrow(add, "lang string, counts binary").collect())
    totals = np.array([np.frombuffer(zstandard.ZstdDecompressor().decompress(r.counts), np.int64) for r in found]).reshape(-1, BUCKETS + 1)
    return LanguageModel.from_counts([r.lang for r in found], totals[:, :BUCKETS], totals[:, BUCKETS])


def _predicted(column: pa.Array, model: LanguageModel) -> Iterator[tuple[int, list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, languages, scores, n-grams, by how much the mean log share is below the language's own) for groups of whole texts."""
    for first, end, data, offsets in textops.slices(column):
        buckets, bounds = gram_buckets(*letters(data, offsets))
        names, scores, below = [UNKNOWN] * (end - first), np.zeros(end - first), np.zeros(end - first)
        for k, (low, high) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            if high > low and model.languages:
                counts = np.bincount(buckets[low:high], minlength=BUCKETS)
                seen = np.flatnonzero(counts)
                logs = counts[seen] @ model.weights[seen] + model.prior
                best = int(logs.argmax())
                names[k], scores[k] = model.languages[best], 1 / np.exp(logs - logs[best]).sum()
                below[k] = model.mean[best] - (logs[best] - model.prior[best]) / (high - low) - STRANGE[1] * np.sqrt(model.variance[best] / (high - low))
        yield first, names, scores, np.diff(bounds), below


def predict_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred and score (probability of that language) per row of `docs` (doc_id, text; others are ignored).

    A null text, one without letters and any text under a model without languages are
    `und` with score 0. Equal texts have equal results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.parts())

    def work(batches):
        model = LanguageModel(*shared.value)
        for batch in batches:
            for first, names, scores, _, _ in _predicted(batch.column("text"), model):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(names)), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"]
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model: LanguageModel, min_score: float) -> DataFrame:
    """The rows of `docs`, with all their columns, whose language is known.

    A text is refused if it has no letter, if no language reaches `min_score`, or if its
    n-grams are stranger to the best language than that language's own text is (STRANGE),
    as gibberish and languages never learned are. Without learned languages every
    text with a letter stays.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.parts())
    at = docs.columns.index("text")

    def work(batches):
        model = LanguageModel(*shared.value)
        for batch in batches:
            for first, names, scores, grams, below in _predicted(batch.column(at).cast(pa.string()), model):
                known = grams > 0
                if model.languages:
                    known &= (scores >= min_score) & (below <= STRANGE[0])
                yield batch.slice(first, len(names)).filter(pa.array(known))

    return docs.mapInArrow(work, docs.schema)
