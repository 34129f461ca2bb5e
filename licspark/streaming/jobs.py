"""Continuous versions of the jobs."""

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from licspark.plans.model import LicenseModel
from licspark.plans.predict import predict_contents
from licspark.sources.findings_table import BUCKET_BYTES, merge_into


#: Stop when all data that is there has been read; pass ``{"processingTime": "1 minute"}`` to run on.
UNTIL_DONE = {"availableNow": True}


def _started(writer, checkpoint: str, trigger: dict | None, **sink) -> StreamingQuery:
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or UNTIL_DONE)).start(**sink)


def stream_predictions(
    contents: DataFrame, model: LicenseModel, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Score arriving (path, content) rows and append predictions.

    Segments, words and scoring work inside each row, so no state is kept.
    """
    scored = predict_contents(contents, model)
    return _started(scored.writeStream.outputMode("append").format("parquet"), checkpoint, trigger, path=path)


def _append_changes(path: str):
    """Write the changed rows of a batch to its own folder; a repeated batch overwrites itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def stream_findings(
    raw: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, bucket_bytes: int = BUCKET_BYTES
) -> StreamingQuery:
    """Convert arriving findings and merge them into the stored table at ``path``.

    The table is the only state: a batch reads and rewrites the buckets it touches
    (``sources.findings_table.current_findings`` reads the result).
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        merge_into(path, batch, batch_id, bucket_bytes=bucket_bytes)

    return _started(raw.writeStream.foreachBatch(merge), checkpoint, trigger)


def stream_counts(
    rows: DataFrame, keys: list[str], path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Running counts per key; every batch appends only the counts it changed."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return _started(
        counts.writeStream.outputMode("update").foreachBatch(_append_changes(path)), checkpoint, trigger
    )


def latest(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Current rows of a change log: the newest batch wins per key."""
    values = [c for c in changes.columns if c not in (*keys, "batch")]
    newest = F.max_by(F.struct(*values), "batch").alias("row")
    return changes.groupBy(*keys).agg(newest).select(*keys, "row.*")
