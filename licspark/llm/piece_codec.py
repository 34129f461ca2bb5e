"""SentencePiece encoding and decoding through a table of distinct marked words.

The model marks blanks, and no piece holds a mark behind another sign. So a text is
cut before each run of blanks, each distinct marked word is segmented once by the
library, and the ids are joined by position. Decoding cuts ids before each piece that
starts with a mark, and decodes each distinct run once. `check_model` refuses a model
for which that does not hold.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from licspark.llm import textops
from licspark.llm.chunks import ChunkTable

MARK = "▁"
#: Distinct marked words that a Python worker remembers.
TABLE_WORDS = 400_000


def check_model(processor) -> None:
    """Raise unless marked words are independent, blanks are kept and a text gets one mark in front."""
    pieces = [processor.id_to_piece(k) for k in range(processor.get_piece_size())]
    if any(MARK in piece.lstrip(MARK) for piece in pieces):
        raise ValueError("the model has pieces that cross a mark")
    probe = "a  b\n c\tﬁ ² "
    if processor.decode(processor.encode(probe)) != probe or processor.encode(" " + probe) == processor.encode(probe):
        raise ValueError("the model changes texts before it segments them")


def _marks_as_blanks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A mark in a text is a blank to the library."""
    first, second, third = MARK.encode()
    at = np.flatnonzero((data[:-2] == first) & (data[1:-1] == second) & (data[2:] == third)) if len(data) > 2 else []
    if not len(at):
        return data, offsets
    data, keep = data.copy(), np.ones(len(data), bool)
    data[at] = 32
    keep[at + 1] = keep[at + 2] = False
    return data[keep], np.concatenate(([0], np.cumsum(keep)))[offsets]


class _Codec:
    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        check_model(self.processor)
        size = self.processor.get_piece_size()
        self.marked = np.array([self.processor.id_to_piece(k).startswith(MARK) for k in range(size)])
        self.control = np.array([self.processor.is_control(k) for k in range(size)])
        self.lone = [self.processor.piece_to_id(MARK)]
        self.words = ChunkTable(self._encoded, np.uint32, TABLE_WORDS)
        self.runs = ChunkTable(self._decoded, np.uint8, TABLE_WORDS)

    def _encoded(self, words: list[bytes]) -> list[list[int]]:
        # a marked word starts with the blank that the library puts in front by itself, except for an empty text
        found = self.processor.encode([w[1:].decode() for w in words], num_threads=1)
        return [ids if len(word) > 1 else self.lone for word, ids in zip(words, found)]

    def _decoded(self, runs: list[bytes]) -> list[np.ndarray]:
        ids = [np.frombuffer(run, "<u4").tolist() for run in runs]
        texts = self.processor.decode(ids)
        blank = [" " if self.marked[k[0]] else "" for k in ids]
        return [np.frombuffer((b + t).encode(), np.uint8) for b, t in zip(blank, texts)]

    def encode(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids with begin and end id on end, and the bounds of each text, for groups of whole texts."""
        begin, end = self.processor.bos_id(), self.processor.eos_id()
        for first, last, data, offsets in textops.slices(column):
            data, offsets = _marks_as_blanks(data, offsets)
            # put the library's blank in front of each text that is not empty
            full = np.diff(offsets) > 0
            moved = offsets + np.concatenate(([0], np.cumsum(full)))
            marked = np.full(moved[-1], 32, np.uint8)
            inside = np.ones(len(marked), bool)
            inside[moved[:-1][full]] = False
            marked[inside] = data
            cut = np.zeros(len(marked) + 1, bool)
            cut[1:-1] = (marked[1:] == 32) & (marked[:-1] != 32) if len(marked) else False
            cut[moved] = True
            cuts = np.flatnonzero(cut)
            ids, bounds = self.words.joined(marked, cuts, np.searchsorted(cuts, moved))
            places = bounds + 2 * np.arange(len(bounds))
            out = np.zeros(places[-1], np.uint32)
            inside = np.ones(len(out), bool)
            inside[places[:-1]] = inside[places[1:] - 1] = False
            out[places[:-1]], out[places[1:] - 1], out[inside] = begin, end, ids
            yield out, places

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes on end and the bounds of each text."""
        keep = ~self.control[ids]
        kept = np.concatenate(([0], np.cumsum(keep)))[bounds]
        ids = np.ascontiguousarray(ids[keep], "<u4")
        cut = np.zeros(len(ids) + 1, bool)
        cut[:-1] = self.marked[ids]
        cut[kept] = True
        cuts = np.flatnonzero(cut)
        out, ends = self.runs.joined(ids.view(np.uint8), cuts * 4, np.searchsorted(cuts, kept))
        # the first mark of a text is the library's own
        firsts = np.zeros(len(out), bool)
        some = ends[:-1] < ends[1:]
        firsts[ends[:-1][some]] = out[ends[:-1][some]] == 32
        return out[~firsts], ends - np.concatenate(([0], np.cumsum(firsts)))[ends]


def _codec(path: str) -> _Codec:
    """This worker's codec for a model file."""
    codecs = textops.worker_cache("piece codecs")
    if path not in codecs:
        codecs[path] = _Codec(path)
    return codecs[path]


def _blobs(data: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    buffers = [None, pa.py_buffer(np.ascontiguousarray(ends, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(kind, len(ends) - 1, buffers)


def encode_pieces(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens and ids (binary, 4 bytes each, begin and end id included) per row of `docs`.

    Needs doc_id and text; other columns are ignored. A null text is empty: begin and end id only.
    """

    def work(batches):
        codec = _codec(model)
        for batch in batches:
            first = 0
            for ids, bounds in codec.encode(batch.column("text")):
                rows = len(bounds) - 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, rows), pa.array(np.diff(bounds)), _blobs(ids.view(np.uint8), bounds * 4, pa.large_binary()).cast(pa.binary())],
                    names=["doc_id", "n_tokens", "ids"],
                )
                first += rows

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(work, "doc_id long, n_tokens long, ids binary")


def decode_pieces(coded: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded (string) per row of `coded` (doc_id, n_tokens, ids); null ids give an empty text."""

    def work(batches):
        codec = _codec(model)
        for batch in batches:
            whole = batch.column("ids").cast(pa.large_binary())
            for first in range(0, len(whole), 1000):
                part = whole.slice(first, 1000).fill_null(b"")
                offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
                data = np.frombuffer(part.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
                out, ends = codec.decode(np.frombuffer(data.tobytes(), "<u4"), (offsets - offsets[0]) // 4)
                rows = batch.slice(first, 1000)
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(c) for c in ("doc_id", "n_tokens", "ids")), _blobs(out, ends, pa.large_string()).cast(pa.string())],
                    names=["doc_id", "n_tokens", "ids", "decoded"],
                )

    return coded.select("doc_id", "n_tokens", "ids").mapInArrow(work, "doc_id long, n_tokens long, ids binary, decoded string")
