"""Incremental scans: new files by micro-batches, results after a cursor, and upkeep when stale."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larch.operators.ranking import since

RESULTS = "ts double, batch bigint, content string"


def scan_files(spark: SparkSession, folder: str, schema: str, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, file_format: str = "parquet", every: str | None = None) -> StreamingQuery:
    """Runs `work` on every batch of new files and appends its rows to `out`; without `every` until all is read.

    Each batch goes to its own folder, overwritten if the batch runs again, so a restart leaves no row twice.
    """

    def one(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).format(file_format).load(folder)
    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def latest(results: DataFrame, cursor: float) -> DataFrame:
    """What a poller has not seen: results after its cursor that have content, the newest first."""
    return since(results, "ts", cursor).orderBy(F.desc("ts"))


def upkeep(now: float, last: float | None, ttl: float, job: Callable[[], None]) -> bool:
    """Runs the job if the last run is ttl or more ago; tells whether it ran."""
    due = last is None or now - last >= ttl
    if due:
        job()
    return due


def windowed_counts(events: DataFrame, ts: str, key: str, window: str, late: str) -> DataFrame:
    """Counts by event-time window and key of a stream, late rows accepted for so long."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window), key).agg(F.count(F.lit(1)).alias("n"))
