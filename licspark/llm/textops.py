"""Whole Arrow batches of texts as numpy arrays: words, hashes of words and of word runs.

The functions look at the UTF-8 bytes of many texts at once. They hold about 30
bytes for each byte of text, so `slices` hands out groups of texts of a few MB;
a longer text comes alone and whole.
"""

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of uint64 values (the splitmix64 finisher)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


BYTE_CODES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
LOWER_CODES = BYTE_CODES.copy()
LOWER_CODES[65:91] = BYTE_CODES[97:123]


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker.

    Functions travel to the tasks by value, and the globals of their module with
    them, so what a module keeps itself is lost with each task.
    """
    state = sys.modules.setdefault("licspark worker", types.ModuleType("licspark worker"))
    return state.__dict__.setdefault(name, {})


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the hash base and of its inverse."""
    cache = worker_cache("powers")
    if len(cache.get("up", ())) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            cache[name] = np.multiply.accumulate(factors)
    return cache["up"][:n], cache["down"]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts on end, and the offset of each; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of groups of whole texts with at most `limit` bytes, or of one longer text."""
    data, offsets = text_bytes(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and per-text bounds of the maximal runs where `member` holds; no run leaves its text."""
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first, last = member.copy(), member.copy()
    first[1:] &= ~member[:-1]
    last[:-1] &= ~member[1:]
    first[heads] = member[heads]
    last[heads[1:] - 1] = member[heads[1:] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+`: starts, ends, and per-text bounds in the list of words."""
    return runs(~SPACE[data], offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray = BYTE_CODES) -> np.ndarray:
    """64-bit hash of the bytes of each span; `codes` may fold bytes, as LOWER_CODES folds A-Z."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes[data] * up[:-1], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])


def run_hashes(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `n` words inside each text, and per-text bounds. A text with fewer words is one run."""
    counts = np.diff(bounds)
    full = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n if len(full) else 0):
        full = full * np.uint64(0xD6E8FEB86659FD93) + hashes[k : len(hashes) - n + 1 + k]
    sizes = np.where(counts >= n, counts - n + 1, (counts > 0).astype(counts.dtype))
    out_bounds = np.concatenate(([0], np.cumsum(sizes)))
    source = np.arange(out_bounds[-1]) + np.repeat(bounds[:-1] - out_bounds[:-1], sizes)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(full):
        out = full[np.minimum(source, len(full) - 1)] + np.uint64(n)
    else:
        out = np.zeros(len(source), np.uint64)
    for i in short:
        value = 0
        for h in hashes[bounds[i] : bounds[i + 1]]:
            value = (value * 0xD6E8FEB86659FD93 + int(h)) & _MASK
        out[out_bounds[i]] = (value + int(counts[i])) & _MASK
    return mixed(out), out_bounds


def sorted_sets(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's values sorted and made distinct, and the new bounds."""
    values = values.copy()
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if high - low > 1:
            values[low:high].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    keep[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    return values[keep], np.concatenate(([0], np.cumsum(keep)))[bounds]


def sums_by(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each text's values; uint64 sums wrap."""
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
