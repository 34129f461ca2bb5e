"""I-Match fingerprints: hashes of the terms of a text that lie in an idf band, for several random lexicon subsets.

Terms are words with A-Z lower-cased, hashed to BUCKETS; the lexicon is every bucket
whose share of documents lies between two bounds. Shares do not change as a corpus
grows, nor does the noise of rare terms that share a bucket (distinct terms per
document / BUCKETS), and the lexicon is a bit per bucket. The first PARTS subsets divide
the lexicon by a hash, so each term stands in exactly one of them and no term is left
out of a fingerprint; the others keep each term with a probability of their own. A
fingerprint holds one slot per subset: the hash of the text's distinct terms in it.
Large subsets agree for copies only, small ones also for texts that share most terms.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F

from licspark.llm import textops
from licspark.llm.counters import bucket_counts

BUCKETS = 1 << 20
#: Shares of documents between which a term is kept: idf between 3.0 and 7.6.
LOW, HIGH = 0.0005, 0.05
#: Subsets that divide the lexicon.
PARTS = 32
#: One subset per entry; each keeps a term with probability 1 / entry, the first PARTS a term in PARTS each.
SUBSETS = (PARTS,) * PARTS + (128,) * 32
_EMPTY = "-" * 8
_ROWS = 1000


def _term_buckets(column: pa.Array):
    """(first row, end row, buckets sorted and distinct within each text, bounds) for groups of whole texts."""
    for first, end, data, offsets in textops.slices(column):
        starts, ends, bounds = textops.words(data, offsets)
        hashes = textops.span_hashes(data, starts, ends, textops.LOWER_CODES) % np.uint64(BUCKETS)
        yield first, end, *textops.sorted_sets(hashes, bounds)


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> np.ndarray:
    """Which buckets have low * n <= documents <= high * n, over all n rows of `docs` (text), as packed bits."""
    texts = docs.select(F.col("text").cast("string").alias("text"))
    counts = bucket_counts(texts, lambda batch: (b.astype(np.int64) for _, _, b, _ in _term_buckets(batch.column("text"))), BUCKETS)
    rows = docs.count()
    return np.packbits((counts >= max(1, low * rows)) & (counts <= high * rows))


def _subset_masks() -> np.ndarray:
    """For each bucket a bit per subset; built once per worker."""
    cache = textops.worker_cache("subset masks")
    if SUBSETS not in cache:
        masks = np.uint64(1) << (textops.mixed(np.arange(BUCKETS, dtype=np.uint64) + np.uint64(1 << 32)) % np.uint64(PARTS))
        for k, one_in in list(enumerate(SUBSETS))[PARTS:]:
            drawn = textops.mixed(np.arange(BUCKETS, dtype=np.uint64) + np.uint64((k + 1) << 32)) % np.uint64(one_in)
            masks |= (drawn == 0).astype(np.uint64) << np.uint64(k)
        cache[SUBSETS] = masks
    return cache[SUBSETS]


class Fingerprinter:
    """Fingerprints of whole texts under one lexicon."""

    def __init__(self, lexicon: np.ndarray):
        self.member = np.unpackbits(lexicon).astype(bool)
        self.masks = _subset_masks()

    def slots(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(hashes (texts, subsets) of 32 bits, which slots hold a term). A text without any lexicon term uses all its terms."""
        hashes, filled = [np.zeros((0, len(SUBSETS)), np.uint32)], [np.zeros((0, len(SUBSETS)), bool)]
        for _, _, terms, bounds in _term_buckets(column):
            kept = self.member[terms]
            none = textops.sums_by(kept.astype(np.int64), bounds) == 0
            kept |= np.repeat(none, np.diff(bounds))
            terms, bounds = terms[kept], np.concatenate(([0], np.cumsum(kept)))[bounds]
            masks = self.masks[terms]
            hashed = textops.mixed(terms + np.uint64(1))
            out = np.zeros((len(bounds) - 1, len(SUBSETS)), np.uint32)
            some = np.zeros(out.shape, bool)
            for k in range(len(SUBSETS)):
                inside = (masks >> np.uint64(k)) & np.uint64(1)
                # terms are distinct and sorted, so a sum of their hashes names the set
                out[:, k] = textops.mixed(textops.sums_by(hashed * inside, bounds)) >> np.uint64(32)
                some[:, k] = textops.sums_by(inside, bounds) > 0
            hashes.append(out)
            filled.append(some)
        return np.concatenate(hashes), np.concatenate(filled)


def fingerprint_texts(hashes: np.ndarray, filled: np.ndarray) -> list[str]:
    """Fingerprints as strings: eight hexadecimal digits per subset, or dashes."""
    digits = hashes.astype(">u4").tobytes().hex()
    width = 8 * len(SUBSETS)
    out = []
    for row, some in enumerate(filled):
        text = digits[row * width : (row + 1) * width]
        if not some.all():
            text = "".join(text[8 * k : 8 * k + 8] if s else _EMPTY for k, s in enumerate(some.tolist()))
        out.append(text)
    return out


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Share of equal slots among those that hold a term in either fingerprint; 1 for two fingerprints without terms, which only texts without words have."""
    either = a[1] | b[1]
    equal = (a[0] == b[0]) & a[1] & b[1]
    total = either.sum(axis=1)
    return np.where(total > 0, equal.sum(axis=1) / np.maximum(total, 1), 1.0)


def imatch_fingerprints(docs: DataFrame, bits: np.ndarray | None = None) -> DataFrame:
    """doc_id and fingerprint per row of `docs` (doc_id, text; others are ignored), under the lexicon of `docs` or a given one.

    A null text is empty; its fingerprint has no filled slot. Equal texts have equal fingerprints.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon(docs) if bits is None else bits)

    def work(batches):
        maker = Fingerprinter(shared.value)
        for batch in batches:
            for first in range(0, batch.num_rows, _ROWS):
                part = batch.slice(first, _ROWS)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fingerprint_texts(*maker.slots(part.column("text"))))], names=["doc_id", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, fingerprint string")


def _in_order(rows: DataFrame) -> DataFrame:
    """Rows dealt by ranges of doc_id, sorted descending inside; each range ends with a copy of the row that follows it.

    Adds `part` and `guest` (a copy of the next range's first row, or of the very first
    row for the last range). Ranges are cut at quantiles of doc_id; what the driver sees
    is one doc_id per range.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    quantiles = rows.select(F.col("doc_id").cast("double").alias("x")).approxQuantile("x", [k / parts for k in range(1, parts)], 0.1 / parts) if parts > 1 else []
    cuts = [-float("inf"), *(sorted(set(quantiles)) or [0.0]), float("inf")]
    placed = rows.withColumn("place", F.col("doc_id").cast("double"))
    placed = Bucketizer(splits=cuts, inputCol="place", outputCol="part", handleInvalid="keep").transform(placed)
    # null doc_ids come last
    placed = placed.withColumn("part", F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("part").cast("int"))).drop("place")
    firsts = sorted(((r.part, r.doc_id) for r in placed.groupBy("part").agg(F.max("doc_id").alias("doc_id")).collect()), reverse=True)
    placed = placed.withColumn("guest", F.lit(False))
    if not firsts:
        return placed
    after = {(part, doc_id): firsts[k - 1][0] for k, (part, doc_id) in enumerate(firsts)}
    targets = spark.createDataFrame([(part, doc_id, target) for (part, doc_id), target in after.items()], "part int, doc_id long, target int")
    heads = placed.alias("r").join(F.broadcast(targets).alias("h"), F.expr("r.part = h.part and r.doc_id <=> h.doc_id"))
    heads = heads.groupBy("target").agg(F.max(F.struct("r.doc_id", "r.text")).alias("row"))
    guests = heads.select("row.doc_id", "row.text", F.col("target").alias("part"), F.lit(True).alias("guest"))
    both = placed.select("doc_id", "text", "part", "guest").unionByName(guests)
    return both.repartitionByRange(parts, "part").sortWithinPartitions("part", "guest", F.desc_nulls_last("doc_id"), F.desc_nulls_last("text"))


def edit_probe(docs: DataFrame, bits: np.ndarray | None = None) -> DataFrame:
    """How fingerprints react to an edit of half the text, and how they tell a text from the next one.

    For each row of `docs` (doc_id, text; others are ignored; null text: empty), the
    edited text is the text with its last floor(n / 2) code points replaced by the first
    as many (or all) of the next document's, in descending doc_id (nulls last, equal ids
    by descending text; after the last the first). Returns doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(lexicon(docs) if bits is None else bits)

    def probe(maker, rows):
        """Rows of one stretch (part, guest, doc_id, text), each but the last followed by its next."""
        texts = [r[3] for r in rows]
        own = maker.slots(pa.array(texts, pa.string()))
        follows = np.array([a[0] == b[0] and not a[1] for a, b in zip(rows, rows[1:])], bool)
        at = np.flatnonzero(follows)
        edited = []
        for k in at.tolist():
            half = len(texts[k]) // 2
            edited.append(texts[k][: len(texts[k]) - half] + texts[k + 1][:half])
        changed = maker.slots(pa.array(edited, pa.string()))
        mine, following = (own[0][at], own[1][at]), (own[0][at + 1], own[1][at + 1])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[k][2] for k in at.tolist()], pa.int64()),
                pa.array([len(texts[k]) for k in at.tolist()], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                pa.array(fingerprint_texts(*mine), pa.string()),
                pa.array(fingerprint_texts(*changed), pa.string()),
                pa.array(likeness(mine, changed)),
                pa.array(likeness(mine, following)),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def work(batches):
        maker, held = Fingerprinter(shared.value), []
        for batch in batches:
            for first in range(0, batch.num_rows, _ROWS):
                part = batch.slice(first, _ROWS)
                held += zip(*(part.column(c).to_pylist() for c in ("part", "guest", "doc_id", "text")))
                yield probe(maker, held)
                held = held[-1:]

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _in_order(texts).select("part", "guest", "doc_id", "text").mapInArrow(work, schema)
