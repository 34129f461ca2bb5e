"""Quality rules: repetition and size, then the distance of a text's histograms to language references.

The corpus itself gives the references: for each language of the column `lang`, the
share of each character class and of each common word (by hash bucket) over all its
texts. A text is refused when its class histogram, or its common-word histogram, is
farther from every reference than a threshold, in Jensen-Shannon distance (base 2, 0
to 1). Texts too short for a histogram to say much are not judged by it.

A text is held against the reference of its own language without its own counts, and
with a threshold as much wider as that reference is small; so a rare language is judged
mildly by its words, and no text vouches for itself. By character classes every text is
judged by all references but those of strange languages: languages with a small share of
all words whose own classes are far from those of every larger language.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from licspark.llm import textops
from licspark.llm.docstats import CLASSES, Stats, class_counts

BUCKETS = 1 << 16
COMMON_WORDS = 96
#: Guards: a histogram of fewer characters or words is not judged.
MIN_CHARS = 300
MIN_WORDS = 100
#: A language with a smaller share of all words must have classes like those of a larger one to be a reference.
SELF_SHARE = 0.01
#: Languages whose counts a task holds before it sends them on.
HELD = 64
#: Largest distances allowed: a base, and a part that falls with the square root of the
#: number of words, as the distance of a random sample to its own source does.
CLASS_DISTANCE = (0.16, 1.1)
WORD_DISTANCE = (0.12, 3.7)


def _buckets(stats: Stats) -> np.ndarray:
    """Bucket of each word, without marks around it and with A-Z lower-cased."""
    letters = ~_MARKS[stats.data]
    total = np.concatenate(([0], np.cumsum(letters)))
    # first and last letter of each word; a word of marks only keeps them
    place = np.flatnonzero(letters)
    some = total[stats.ends] > total[stats.starts]
    starts, ends = stats.starts.copy(), stats.ends.copy()
    starts[some] = place[total[stats.starts[some]]]
    ends[some] = place[total[stats.ends[some]] - 1] + 1
    return (textops.span_hashes(stats.data, starts, ends, textops.LOWER_CODES) % np.uint64(BUCKETS)).astype(np.int64)


_MARKS = np.zeros(256, bool)
_MARKS[33:48] = _MARKS[58:65] = _MARKS[91:97] = _MARKS[123:127] = True


class References:
    """Per language, the largest first: counts of classes, buckets and counts of the common words, and counts of the rest."""

    def __init__(self, languages: list[str], classes: np.ndarray, buckets: np.ndarray, words: np.ndarray):
        self.languages, self.classes, self.buckets, self.words = languages, classes, buckets, words

    def parts(self) -> tuple:
        """Plain arrays, for a broadcast that workers without this package can read."""
        return self.languages, self.classes, self.buckets, self.words


def distances(counts: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts to a distribution, or to a row of `shares` each; 1 for a row without counts."""
    total = counts.sum(axis=1, keepdims=True)
    p = counts / np.maximum(total, 1)
    m = (p + shares) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        right = np.where(shares > 0, shares * np.log2(shares / m), 0).sum(axis=1)
    return np.where(total[:, 0] > 0, np.sqrt(np.clip((left + right) / 2, 0, 1)), 1.0)


def language_references(docs: DataFrame) -> References:
    """References from all rows of `docs` (text, lang) with a lang; rows are added up in tasks, then per language."""
    width = len(CLASSES) + BUCKETS

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
                stats = Stats(data, offsets)
                kinds, buckets, text = class_counts(data, offsets), _buckets(stats), stats.text_of_word()
                names, codes = np.unique(np.array(langs[first:end]), return_inverse=True)
                for k, name in enumerate(names.tolist()):
                    total = found.setdefault(name, np.zeros(width, np.int64))
                    total[: len(CLASSES)] += kinds[codes == k].sum(axis=0)
                    total[len(CLASSES) :] += np.bincount(buckets[codes[text] == k], minlength=BUCKETS)
                    if len(found) >= HELD:
                        yield sent(found)
                        found = {}
        if found:
            yield sent(found)

    def added(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(width, np.int64)
        for batch in batches:
            for part in batch.column("counts"):
                total += np.frombuffer(zstandard.ZstdDecompressor().decompress(part.as_py()), np.int64)
        return total

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = zstandard.ZstdCompressor(level=1).compress(added(batches).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.string()), pa.array([packed], pa.binary())], names=["lang", "counts"])

    def finish(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = added(batches)
        kinds, words = total[: len(CLASSES)], total[len(CLASSES) :]
        common = np.sort(np.lexsort((np.arange(BUCKETS), -words))[:COMMON_WORDS])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([key[0].as_py()], pa.string()),
                pa.array([int(words.sum())], pa.int64()),
                pa.array([kinds.tolist()], pa.list_(pa.int64())),
                pa.array([common.tolist()], pa.list_(pa.int64())),
                pa.array([words[common].tolist()], pa.list_(pa.int64())),
            ],
            names=["lang", "n_words", "classes", "buckets", "counts"],
        )

    rows = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    parts = rows.mapInArrow(count, "lang string, counts binary")
    # a language may own most rows, but it has one part per task; parts meet in two steps
    salted = parts.withColumn("part", F.pmod(F.shiftright(F.monotonically_increasing_id(), 33), F.lit(32)))
    once = salted.groupBy("lang", "part").applyInArrow(add, "lang string, counts binary")
    schema = "lang string, n_words long, classes array<long>, buckets array<long>, counts array<long>"
    found = sorted((r for r in once.groupBy("lang").applyInArrow(finish, schema).collect() if r.n_words), key=lambda r: (-r.n_words, r.lang))
    if not found:
        return References([], np.zeros((0, len(CLASSES))), np.zeros((0, COMMON_WORDS), np.int64), np.zeros((0, COMMON_WORDS + 1)))
    classes = np.array([r.classes for r in found], float)
    words = np.array([[*r.counts, r.n_words - sum(r.counts)] for r in found], float)
    return References([r.lang for r in found], classes, np.array([r.buckets for r in found]), words)


def _vouching(references: References) -> list[bool]:
    """Per language, whether it is large, or has classes like those of a larger language that vouches."""
    total, out = references.words.sum(), []
    for k, (classes, words) in enumerate(zip(references.classes, references.words.sum(axis=1))):
        known = references.classes[:k][out]
        shares = known / known.sum(axis=1, keepdims=True)
        limit = CLASS_DISTANCE[0] + CLASS_DISTANCE[1] / np.sqrt(words)
        out.append(bool(words >= SELF_SHARE * total or (distances(classes[None].repeat(len(shares), 0), shares) <= limit).any()))
    return out


def _without(counts: np.ndarray, own: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Shares of a reference per row, without the row's own counts where `rows` holds."""
    left = np.maximum(counts - np.where(rows[:, None], own, 0), 0)
    return left / np.maximum(left.sum(axis=1, keepdims=True), 1)


def _judged(stats: Stats, references: References, vouching: list[bool], langs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distance to the nearest reference per text, by character classes and by common words, and whether both kinds find it near enough."""
    kinds = class_counts(stats.data, stats.offsets)
    rows = len(stats.n_words)
    by_class, by_word = np.ones(rows), np.ones(rows)
    class_ok, word_ok = stats.n_chars < MIN_CHARS, stats.n_words < MIN_WORDS
    buckets, text = _buckets(stats), stats.text_of_word()
    n = COMMON_WORDS + 1
    share = 1 / np.maximum(stats.n_words, 1)
    for k, language in enumerate(references.languages):
        own = langs == language
        if not (vouching[k] or own.any()):
            continue
        bins = np.full(BUCKETS, COMMON_WORDS)
        bins[references.buckets[k]] = np.arange(COMMON_WORDS)
        counts = np.bincount(text * n + bins[buckets], minlength=rows * n).reshape(-1, n)
        left = references.words[k].sum() - np.where(own, stats.n_words, 0)
        # the own language's threshold is wider by the noise of the rest of its reference
        noise = np.sqrt(share + np.where(own, 1 / np.maximum(left, 1e-9), 0))
        from_words = distances(counts, _without(references.words[k], counts, own))
        if vouching[k]:
            from_classes = distances(kinds, _without(references.classes[k], kinds, own))
            by_class = np.minimum(by_class, from_classes)
            class_ok |= from_classes <= CLASS_DISTANCE[0] + CLASS_DISTANCE[1] * np.sqrt(share)
        held = own | vouching[k]
        by_word = np.where(held, np.minimum(by_word, from_words), by_word)
        word_ok |= held & (from_words <= WORD_DISTANCE[0] + WORD_DISTANCE[1] * noise)
    return by_class, by_word, class_ok & word_ok


def quality_rules(docs: DataFrame, references: References | None = None) -> DataFrame:
    """Counts, distances and verdict per row of `docs` (doc_id, text, lang; others are ignored).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, class_distance, word_distance and kept. A null text counts as empty
    and fails the base rules, as any text with fewer than 50 words does. A text whose
    language has no reference, or is null, is held against all references. No text is
    judged by distance when there is no reference at all. Repeated rows give repeated results.
    """
    references = references or language_references(docs)
    shared = docs.sparkSession.sparkContext.broadcast((*references.parts(), _vouching(references)))

    def work(batches):
        *parts, vouching = shared.value
        known = References(*parts)
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for first, end, data, offsets in textops.slices(batch.column("text")):
                stats = Stats(data, offsets)
                _, duplicates = stats.lines()
                repeated = stats.repeated_words()
                failed = (stats.n_words < 50) | (100 * repeated > 50 * stats.n_words)
                by_class, by_word, near = _judged(stats, known, vouching, langs[first:end])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, end - first),
                        *(pa.array(x.astype(np.int64)) for x in (stats.n_words, stats.word_chars, stats.n_symbols, duplicates, repeated)),
                        pa.array(failed),
                        pa.array(by_class),
                        pa.array(by_word),
                        pa.array(~failed & (near | (not known.languages))),
                    ],
                    names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, class_distance double, word_distance double, kept boolean"
    return rows.mapInArrow(work, schema)
