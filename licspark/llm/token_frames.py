"""Token ids of a corpus as shard files of independent zstandard frames with a trailing seek table.

A shard file holds, in this order:

- frames: each the zstandard-compressed ids (little-endian unsigned 32-bit) of whole
  documents on end, about FRAME_IDS ids or one longer document;
- the document index, compressed: an Arrow stream of doc_id, frame, first (place of the
  document's first id in its frame) and n_tokens;
- the seek table: per frame its offset, compressed bytes, ids and the CRC-32 of its ids;
- the footer: offset, bytes and CRC-32 of the index, number of frames, CRC-32 of the
  seek table, and the magic bytes.

A reader loads footer, seek table and index, then only the frames that hold the
documents asked for, and checks each against its checksum.
"""

import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from licspark.llm import shared_files, textops
from licspark.llm.chunks import HashedChunkTable
from licspark.session import durable, new_table_path

FRAME_IDS = 1 << 16
#: Distinct chunks that a Python worker remembers; about 60 bytes each.
TABLE_CHUNKS = 1_500_000
_SEEK = np.dtype([("offset", "<u8"), ("bytes", "<u8"), ("ids", "<u8"), ("crc", "<u4")])
_FOOTER = "<QQIQI8s"
MAGIC = b"IDFRAME1"
_INDEX = pa.schema([("doc_id", pa.int64()), ("frame", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64())])


class FrameWriter:
    """Appends documents to one shard file; holds the current frame and the index only."""

    def __init__(self, file, frame_ids: int = FRAME_IDS):
        self.file, self.frame_ids = file, frame_ids
        self.pack = zstandard.ZstdCompressor(level=1)
        self.parts, self.ids, self.offset, self.total = [], 0, 0, 0
        self.seek, self.index = [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.index.append((doc_id, len(self.seek), self.ids, len(ids)))
        self.parts.append(ids.astype("<u4", copy=False))
        self.ids += len(ids)
        self.total += len(ids)
        if self.ids >= self.frame_ids:
            self._flush()

    def _write(self, data: bytes) -> None:
        self.file.write(data)
        self.offset += len(data)

    def _flush(self) -> None:
        raw = np.concatenate(self.parts).tobytes()
        packed = self.pack.compress(raw)
        self.seek.append((self.offset, len(packed), self.ids, zlib.crc32(raw)))
        self._write(packed)
        self.parts, self.ids = [], 0

    def close(self) -> None:
        if self.parts:
            self._flush()
        columns = list(zip(*self.index)) or [[], [], [], []]
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _INDEX) as stream:
            stream.write_batch(pa.record_batch([pa.array(c, pa.int64()) for c in columns], schema=_INDEX))
        index = self.pack.compress(sink.getvalue().to_pybytes())
        at = self.offset
        self._write(index)
        seek = np.array(self.seek, _SEEK).tobytes()
        self._write(seek)
        self._write(struct.pack(_FOOTER, at, len(index), zlib.crc32(index), len(self.seek), zlib.crc32(seek), MAGIC))
        self.file.close()


class FrameReader:
    """Random access to the documents of one shard file."""

    def __init__(self, file):
        self.file = file
        size = file.seek(0, 2)
        size = file.tell() if size is None else size
        at, length, index_crc, frames, seek_crc, magic = struct.unpack(_FOOTER, self._part(size - struct.calcsize(_FOOTER), struct.calcsize(_FOOTER)))
        if magic != MAGIC:
            raise ValueError("not a token frame file")
        seek = self._part(at + length, frames * _SEEK.itemsize)
        index = self._part(at, length)
        if zlib.crc32(seek) != seek_crc or zlib.crc32(index) != index_crc:
            raise ValueError("damaged seek table or index")
        self.seek = np.frombuffer(seek, _SEEK)
        self.index = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(index)).read_all()

    def _part(self, at: int, length: int) -> bytes:
        self.file.seek(at)
        return self.file.read(length)

    def frame(self, number: int) -> np.ndarray:
        entry = self.seek[number]
        packed = self._part(int(entry["offset"]), int(entry["bytes"]))
        raw = zstandard.ZstdDecompressor().decompress(packed, max_output_size=int(entry["ids"]) * 4)
        if zlib.crc32(raw) != entry["crc"]:
            raise ValueError(f"damaged frame {number}")
        return np.frombuffer(raw, "<u4")

    def documents(self, rows: Iterable[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(row of the index, ids) of the wanted rows in order; each frame that holds one is read once."""
        frames, firsts, sizes = (self.index.column(c).to_numpy() for c in ("frame", "first", "n_tokens"))
        current = None
        for row in range(len(frames)) if rows is None else rows:
            if frames[row] != current:
                current, ids = frames[row], self.frame(int(frames[row]))
            yield row, ids[firsts[row] : firsts[row] + sizes[row]]


#: Bytes that, after a blank, start a word in any language: printable ASCII, and lead bytes that start no Unicode space.
_AFTER_BLANK = np.zeros(256, bool)
_AFTER_BLANK[0x21:0x7F] = True
_AFTER_BLANK[0xC3:] = True
_AFTER_BLANK[[0xE1, 0xE2, 0xE3]] = False
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[0x21:0x7F] = True
_SIGN = _MARK.copy()
_MARK &= ~_ALNUM
#: Second bytes of the letters U+00C0 to U+00FF, without the signs of multiplication and division.
_LATIN_TAIL = np.zeros(256, bool)
_LATIN_TAIL[0x80:0xC0] = True
_LATIN_TAIL[[0x97, 0xB7]] = False


def chunk_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where the byte-level pre-tokenizer cuts in any surroundings.

    Before a blank that a word follows: such a blank belongs to the word, and the
    white space before it ends there as at the end of a text. Between a letter or
    digit (ASCII, or a Latin letter of two bytes) and an ASCII mark. And around a line
    end that stands alone between two signs.
    """
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        cut[:-2] = (data[:-1] == 32) & _AFTER_BLANK[data[1:]]
        mark = _MARK[data[1:]]
        cut[1:-1] |= _ALNUM[data[:-1]] & mark
        cut[2:-1] |= (data[:-2] == 0xC3) & _LATIN_TAIL[data[1:-1]] & mark[1:]
        alone = np.flatnonzero(_SIGN[data[:-2]] & (data[1:-1] == 10) & _AFTER_BLANK[data[2:]])
        cut[alone + 1] = cut[alone + 2] = True
    cut[offsets] = True
    return np.flatnonzero(cut)


def _table(path: str) -> HashedChunkTable:
    """This worker's chunk table for a tokenizer file."""
    tables = textops.worker_cache("chunk tables")
    if path not in tables:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        # the strings of special tokens in a text are ordinary text
        tokenizer.encode_special_tokens = True

        def encode(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            # a chunk may start after a blank of its text, so it is never changed
            texts = [chunk.decode() for chunk in chunks]
            ids = [coded.ids for coded in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            return np.fromiter(chain.from_iterable(ids), np.uint32, int(counts.sum())), counts

        tables[path] = HashedChunkTable(encode, np.uint32, TABLE_CHUNKS)
    return tables[path]


def encoded(column: pa.Array, path: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids on end, bounds of each text) for groups of whole texts."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    table = _table(path)
    for first, _, data, offsets in textops.slices(column):
        cuts = chunk_cuts(data, offsets)
        hashes = textops.span_hashes(data, cuts[:-1], cuts[1:])
        yield first, *table.joined(data, cuts, np.searchsorted(cuts, offsets), hashes)


def write_token_frames(docs: DataFrame, tokenizer: str, end_id: int, folder: str, frame_ids: int = FRAME_IDS) -> DataFrame:
    """Encode and write all documents in ascending doc_id order; returns the stored list of shard files.

    `docs` needs doc_id and text; other columns are ignored, a null text is empty, a
    null doc_id comes first. Rows with equal doc_id are ordered by a hash of the text, so
    that one id with many rows spreads over files. `end_id` ends
    each document. Columns: shard, path, n_docs, n_tokens and start (ids in the shards
    before). A file whose task was lost is not in the list. An empty table gives an
    empty list.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = ["doc_id", F.xxhash64("text"), "text"]
    ordered = texts.repartitionByRange(*order[:2]).sortWithinPartitions(*order)

    def work(batches):
        task = TaskContext.get()
        path = f"{folder}/shard-{task.partitionId():06d}-{task.taskAttemptId()}.frames"
        writer, docs_seen = None, 0
        for batch in batches:
            if writer is None:
                writer = FrameWriter(shared_files.create(path), frame_ids)
            doc_ids = batch.column("doc_id").to_pylist()
            docs_seen += len(doc_ids)
            for first, ids, bounds in encoded(batch.column("text"), tokenizer):
                places = bounds + np.arange(len(bounds))
                ended = np.full(places[-1], end_id, np.uint32)
                inside = np.ones(len(ended), bool)
                inside[places[1:] - 1] = False
                ended[inside] = ids
                for k in range(len(bounds) - 1):
                    writer.add(doc_ids[first + k], ended[places[k] : places[k + 1]])
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"shard": [task.partitionId()], "path": [path], "n_docs": [docs_seen], "n_tokens": [writer.total]})

    shards = durable(ordered.mapInArrow(work, "shard long, path string, n_docs long, n_tokens long"))
    # one row per shard file, so the running sum is over a short list
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def read_token_frames(shards: DataFrame, doc_ids: list[int] | None = None) -> DataFrame:
    """Documents from the files of `write_token_frames`: doc_id, start, n_tokens, ids (binary, 4 bytes each).

    With `doc_ids`, only frames that hold one of them are decompressed.
    """
    wanted = None if doc_ids is None else set(doc_ids)

    def work(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                with shared_files.open_at_will(path) as file:
                    reader = FrameReader(file)
                    names = reader.index.column("doc_id").to_pylist()
                    sizes = reader.index.column("n_tokens").to_numpy()
                    starts = start + np.cumsum(sizes) - sizes
                    rows = None if wanted is None else [k for k, name in enumerate(names) if name in wanted]
                    held, held_bytes = [], 0
                    for row, ids in reader.documents(rows):
                        held.append((names[row], int(starts[row]), len(ids), ids.tobytes()))
                        held_bytes += 4 * len(ids)
                        if held_bytes > textops.SLICE_BYTES:
                            yield _documents(held)
                            held, held_bytes = [], 0
                    if held:
                        yield _documents(held)

    # a task per file, whatever little the list of files weighs
    files = shards.select("shard", "path", "start")
    return files.repartitionByRange(max(1, files.count()), "shard").mapInArrow(work, "doc_id long, start long, n_tokens long, ids binary")


def _documents(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "start", "n_tokens", "ids"])


def token_frames(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Write all documents to shard files in `folder` (default: one in the shared folder) and read them back."""
    folder = folder or new_table_path(docs.sparkSession, "frames")
    return read_token_frames(write_token_frames(docs, tokenizer, end_id, folder))
