"""Converted findings as a stored table that new findings are merged into bucket by bucket.

Rows are dealt to buckets by a hash of (kind, path), and the number of buckets follows the
stored bytes by linear hashing: a table with n buckets grows by splitting one bucket at a
time, the others stay as they are. A batch reads and rewrites, whole, the buckets that its
findings or a split touch. It writes them as Hive partitions below a folder of its own, named by the batch and
the number of buckets, which counts from the moment Spark has marked it as finished; so a
batch that runs again overwrites itself, and reads what was there before it. Versions
older than the one before the newest are removed by the next batch.
"""

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from licspark.operators.convert import typed_findings, upsert_findings

#: A bucket's bytes, on average, at which the table grows.
BUCKET_BYTES = 128 << 20
#: Bytes that one writing task gets of a bucket.
TASK_BYTES = 32 << 20
#: New findings that one writing task gets of a bucket.
TASK_ROWS = 1 << 20
SCHEMA = "kind string, path string, licenses array<string>, remove boolean, indirect boolean, text string, seq long"
_FOLDER = re.compile(r"/batch=(\d+),buckets=(\d+)/bucket=(\d+)/[^/]+$")


class Merge(NamedTuple):
    """What a batch did: buckets before and after, buckets rewritten, bytes of their old and new versions."""

    batch: int
    buckets_before: int
    buckets: int
    touched: int
    bytes_read: int
    bytes_written: int


class _Stored:
    """The versions of a table, from the names and sizes of its files."""

    def __init__(self, spark: SparkSession, path: str, before: int | None = None):
        context = spark.sparkContext
        self.root = context._jvm.org.apache.hadoop.fs.Path(path)
        self.files = self.root.getFileSystem(context._jsc.hadoopConfiguration())
        make = context._jvm.org.apache.hadoop.fs.Path
        done = {}
        for status in self.files.globStatus(make(self.root, "batch=*/_SUCCESS")) or []:
            name = status.getPath().getParent().getName()
            batch, buckets = map(int, re.findall(r"\d+", name))
            if before is None or batch < before:
                done[batch] = (name, buckets)
        #: number of buckets after the newest batch; 0 without any
        self.buckets = done[max(done)][1] if done else 0
        #: bucket -> {batch: bytes}
        self.versions: dict[int, dict[int, int]] = {}
        self.names = {batch: name for batch, (name, _) in done.items()}
        for status in self.files.globStatus(make(self.root, "batch=*/bucket=*/*.parquet")) or []:
            batch, _, bucket = map(int, _FOLDER.search(status.getPath().toString()).groups())
            if batch in done:
                of_bucket = self.versions.setdefault(bucket, {})
                of_bucket[batch] = of_bucket.get(batch, 0) + status.getLen()

    def folder(self, bucket: int, batch: int) -> str:
        return f"{self.root.toString()}/{self.names[batch]}/bucket={bucket}"

    def newest(self, buckets=None) -> dict[int, int]:
        """Newest batch of each bucket, or of the given ones."""
        return {b: max(v) for b, v in self.versions.items() if buckets is None or b in buckets}

    def size(self, buckets=None) -> int:
        return sum(self.versions[b][n] for b, n in self.newest(buckets).items())

    def remove_old(self) -> None:
        """Delete all but the newest two versions of each bucket."""
        for bucket, versions in self.versions.items():
            for batch in sorted(versions)[:-2]:
                self.files.delete(self.root.suffix(f"/{self.names[batch]}/bucket={bucket}"), True)


def bucket_of(buckets: int) -> Column:
    """Bucket of (kind, path) in a table of this many buckets."""
    value = F.shiftrightunsigned(F.xxhash64("kind", "path"), 1)
    level = 1 << (buckets.bit_length() - 1)
    wide = value % F.lit(2 * level)
    return F.when(wide < buckets, wide).otherwise(value % F.lit(level)).cast("int")


def split_sources(before: int, after: int) -> set[int]:
    """Buckets whose rows may move when a table grows from `before` to `after` buckets."""
    found = set()
    for bucket in range(before, after):
        while bucket >= before:
            bucket -= 1 << (bucket.bit_length() - 1)
        found.add(bucket)
    return found


def current_findings(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """Files of the newest version of each bucket, or of the newest before a batch; no other folder is read."""
    return _read(spark, _Stored(spark, path, before))


def _read(spark: SparkSession, stored: _Stored, buckets=None) -> DataFrame:
    folders = [stored.folder(b, n) for b, n in sorted(stored.newest(buckets).items())]
    return spark.read.schema(SCHEMA).parquet(*folders) if folders else spark.createDataFrame([], SCHEMA)


def merge_into(path: str, raw: DataFrame, batch: int, registry: DataFrame | None = None, bucket_bytes: int = BUCKET_BYTES) -> Merge:
    """Merge raw findings into the table as batch number ``batch``; only touched buckets are read and written.

    The table at most doubles its buckets in a batch, towards ``bucket_bytes`` each. An
    empty batch touches nothing unless a bucket is to be split.
    """
    spark = raw.sparkSession
    stored = _Stored(spark, path, batch)
    stored.remove_old()
    before = max(1, stored.buckets)
    after = max(before, min(2 * before, -(-stored.size() // bucket_bytes)))
    new = typed_findings(raw, registry).where("kind is not null and path is not null")
    arrived = {r["bucket"]: r["count"] for r in new.groupBy(bucket_of(before).alias("bucket")).count().collect()}
    touched = set(arrived) | split_sources(before, after)
    merged = upsert_findings(_read(spark, stored, touched), raw, registry).withColumn("bucket", bucket_of(after))
    # a bucket is written by as many tasks as its old bytes and new rows ask for, a few buckets by all cores
    many, cores = max(1, len(touched)), spark.sparkContext.defaultParallelism
    asked = -(-stored.size(touched) // (many * TASK_BYTES)) + -(-sum(arrived.values()) // (many * TASK_ROWS))
    share = max(asked, -(-cores // many))
    tasks = max(cores, many * share)
    # dealt by number, since hashes of a few numbers leave tasks without rows and give others twice as many
    task = F.pmod(F.col("bucket") * int(share) + F.pmod(F.xxhash64("path", F.lit(1)), F.lit(int(share))), F.lit(int(tasks)))
    target = f"{path}/batch={batch},buckets={after}"
    dealt = merged.repartitionById(int(tasks), task.cast("int"))
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(target)
    written = stored.files.getContentSummary(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)).getLength()
    return Merge(batch, stored.buckets, after, len(touched), stored.size(touched), written)
