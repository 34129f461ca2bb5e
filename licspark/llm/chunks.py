"""Texts as runs of distinct chunks: each distinct chunk is encoded once, ids are joined back by position.

A chunk table serves tokenizers whose result for a text is the results of its
chunks on end. It lives as long as its Python worker and is emptied when it has
grown to its limit, so memory is bounded for any vocabulary.
"""

from collections.abc import Callable

import numpy as np
import pyarrow as pa


def distinct(data: np.ndarray, cuts: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Distinct values of the chunks data[cuts[i]:cuts[i + 1]], and the number of each chunk's value."""
    if len(cuts) < 2:
        return [], np.zeros(0, np.int64)
    buffers = [None, pa.py_buffer(np.ascontiguousarray(cuts, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    coded = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, buffers).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy()


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class ChunkTable:
    """Arrays of one dtype by chunk; `encode` turns a list of chunks into a list of arrays."""

    def __init__(self, encode: Callable[[list[bytes]], list], dtype, limit: int):
        self.encode, self.limit, self.dtype = encode, limit, dtype
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.store = np.zeros(1 << 16, self.dtype)
        #: ends[k]: place in the store where the array of chunk number k - 1 ends
        self.ends = np.zeros(1 << 12, np.int64)

    def _add(self, chunks: list[bytes]) -> None:
        arrays = [np.asarray(a, self.dtype) for a in self.encode(chunks)]
        known = len(self.numbers)
        used = self.ends[known]
        ends = used + np.cumsum([len(a) for a in arrays])
        self.ends = _grown(self.ends, known + 1 + len(chunks))
        self.store = _grown(self.store, ends[-1])
        self.ends[known + 1 : known + 1 + len(chunks)] = ends
        self.store[used : ends[-1]] = np.concatenate(arrays)
        self.numbers.update(zip(chunks, range(known, known + len(chunks))))

    def joined(self, data: np.ndarray, cuts: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encoded chunks on end, and the bounds of each text in them; `bounds` are the texts' bounds in chunks."""
        values, numbers = distinct(data, cuts)
        if len(self.numbers) + len(values) > self.limit:
            self.clear()
        new = [v for v in values if v not in self.numbers]
        if new:
            self._add(new)
        at = np.array([self.numbers[v] for v in values], np.int64)[numbers]
        starts, ends = self.ends[at], self.ends[at + 1]
        total = np.concatenate(([0], np.cumsum(ends - starts)))
        return self.store[ranges(starts, ends - starts)], total[bounds]


class HashedChunkTable:
    """Arrays of one dtype by chunk, found by 64-bit hashes of whole slices at once.

    `encode` turns a list of chunks into (values on end, number of values of each). Known
    chunks are kept in two generations of at most `limit` / 2 chunks: a chunk that is met in the older one
    moves to the newer, and when that is full the older one goes, so memory is bounded
    and what is in use stays. The bytes of each chunk are kept too and compared at
    every use; a chunk whose hash belongs to other bytes is encoded by itself.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], dtype, limit: int):
        self.encode, self.limit, self.dtype = encode, limit, dtype
        self.newer, self.older = _Generation(dtype), _Generation(dtype)

    def _encoded(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        whole = data.tobytes()
        return self.encode([whole[a:b] for a, b in zip(starts.tolist(), (starts + sizes).tolist())])

    def _learn(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Put chunks into the newer generation, from the older one where it has them."""
        missing = np.flatnonzero(~self.newer.has(hashes))
        if len(self.newer.hashes) + len(missing) > self.limit // 2:
            self.older, self.newer = self.newer, _Generation(self.dtype)
            missing = np.arange(len(hashes))
        at, known = self.older.find(hashes[missing])
        self.newer.add(hashes[missing[known]], *self.older.taken(at[known]))
        new = missing[~known]
        if len(new):
            values, counts = self._encoded(data, starts[new], sizes[new])
            self.newer.add(hashes[new], values, counts, data[ranges(starts[new], sizes[new])], sizes[new])

    def joined(self, data: np.ndarray, cuts: np.ndarray, bounds: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encoded chunks on end, and the bounds of each text in them; `bounds` are the texts' bounds in chunks."""
        starts, sizes = cuts[:-1], np.diff(cuts)
        distinct, first, number = np.unique(hashes, return_index=True, return_inverse=True)
        self._learn(distinct, data, starts[first], sizes[first])
        at = self.newer.find(distinct)[0][number]
        begins, counts = self.newer.begins[at], self.newer.counts[at]
        same = self.newer.sizes[at] == sizes
        text = self.newer.text[ranges(self.newer.places[at], np.where(same, sizes, 0))]
        if not same.all() or not np.array_equal(text, data):
            return self._one_by_one(data, starts, sizes, bounds)
        total = np.concatenate(([0], np.cumsum(counts)))
        return self.newer.values[ranges(begins, counts)], total[bounds]

    def _one_by_one(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for a slice in which two chunks share a hash."""
        values, counts = self._encoded(data, starts, sizes)
        return values, np.concatenate(([0], np.cumsum(counts)))[bounds]


class _Generation:
    """Chunks in the order of their hashes, with their values and bytes."""

    def __init__(self, dtype):
        self.hashes = np.zeros(0, np.uint64)
        self.values, self.text = np.zeros(0, dtype), np.zeros(0, np.uint8)
        self.begins = self.counts = self.places = self.sizes = np.zeros(0, np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each hash, and whether it is there."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes

    def has(self, hashes: np.ndarray) -> np.ndarray:
        return self.find(hashes)[1]

    def taken(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Values, their counts, bytes and their sizes of the chunks at these places."""
        counts, sizes = self.counts[at], self.sizes[at]
        return self.values[ranges(self.begins[at], counts)], counts, self.text[ranges(self.places[at], sizes)], sizes

    def add(self, hashes: np.ndarray, values: np.ndarray, counts: np.ndarray, text: np.ndarray, sizes: np.ndarray) -> None:
        if not len(hashes):
            return
        both = np.concatenate((self.hashes, hashes))
        order = np.argsort(both, kind="stable")
        begins = len(self.values) + np.cumsum(counts) - counts
        places = len(self.text) + np.cumsum(sizes) - sizes
        self.hashes = both[order]
        for name, more in (("begins", begins), ("counts", counts), ("places", places), ("sizes", sizes)):
            setattr(self, name, np.concatenate((getattr(self, name), more))[order])
        self.values = np.concatenate((self.values, values))
        self.text = np.concatenate((self.text, text))


def _grown(array: np.ndarray, size: int) -> np.ndarray:
    """The array, with room for `size` values."""
    if size <= len(array):
        return array
    return np.concatenate([array, np.zeros(max(size, size + size // 2) - len(array), array.dtype)])
