"""Counts by hash in a table of fixed size, added up over all rows of a DataFrame."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

_CHUNKS = 16


def bucket_counts(texts: DataFrame, buckets: Callable[[pa.RecordBatch], Iterator[np.ndarray]], size: int) -> np.ndarray:
    """How often each of `size` buckets occurs in what `buckets` yields for the batches of `texts`.

    Each task sends its table in compressed ranges; ranges are added per group of
    tasks, then over all. `size` numbers come to the driver, however many rows there are.
    """
    width = size // _CHUNKS

    def count(batches):
        total = np.zeros(size, np.uint64)
        for batch in batches:
            for found in buckets(batch):
                total += np.bincount(found, minlength=size).astype(np.uint64)
        if total.any():
            pack = zstandard.ZstdCompressor(level=1)
            parts = [pack.compress(total[k * width : (k + 1) * width].tobytes()) for k in range(_CHUNKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(_CHUNKS), pa.int32()), pa.array(parts, pa.binary())], names=["chunk", "counts"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.uint64)
        for batch in batches:
            for part in batch.column("counts"):
                total += np.frombuffer(zstandard.ZstdDecompressor().decompress(part.as_py()), np.uint64)
        packed = zstandard.ZstdCompressor(level=1).compress(total.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([packed], pa.binary())], names=["chunk", "counts"])

    salted = texts.mapInArrow(count, "chunk int, counts binary").withColumn("part", F.pmod(F.shiftright(F.monotonically_increasing_id(), 33), F.lit(32)))
    once = salted.groupBy("chunk", "part").applyInArrow(add, "chunk int, counts binary")
    table = np.zeros(size, np.uint64)
    for row in once.groupBy("chunk").applyInArrow(add, "chunk int, counts binary").collect():
        table[row.chunk * width : (row.chunk + 1) * width] = np.frombuffer(zstandard.ZstdDecompressor().decompress(row.counts), np.uint64)
    return table
