"""Writing stores: atomic versions, read-through caches with a time to live, rings and the gate's status."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larch.operators import identity
from larch.sources import schemas
from larch.sources.snapshots import TEMPLATE_VERSION, exists


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def replace(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Writes beside the target, then renames: readers see the old table or the new one, never half of one."""
    spark = df.sparkSession
    fs, target = _fs(spark, path)
    _, fresh = _fs(spark, f"{path}.fresh")
    fs.delete(fresh, True)
    df.write.partitionBy(*partition_by).parquet(f"{path}.fresh")
    fs.delete(target, True)
    if not fs.rename(fresh, target):
        raise OSError(f"{path} could not be replaced")


def save_templates(templates: DataFrame, path: str, version: int = TEMPLATE_VERSION) -> None:
    """Partitioned by footprint, so that a scan of one size reads its partition only."""
    replace(templates.repartition("w", "h"), f"{path}/version={version}", ("w", "h"))


def save_status(exact: DataFrame, visual: DataFrame, n_index: int, provider: str, now: float, path: str) -> DataFrame:
    """The gate's verdict, rounded to four digits, as a one-row table; returns it."""
    row = identity.gate(exact, visual, n_index).select(F.lit(provider).alias("provider"), "enabled", F.bround("agreement", 4).alias("agreement"), "overlap", F.bround("coverage", 4).alias("coverage"), F.lit(now).alias("checked_at"))
    replace(row.coalesce(1), path)
    return row


def status(spark: SparkSession, path: str) -> DataFrame:
    """The saved verdict; no row if there is none."""
    return spark.read.schema(schemas.GATE).parquet(path) if exists(spark, path) else spark.createDataFrame([], schemas.GATE)


def read_through(spark: SparkSession, path: str, now: float, ttl: float, fetch: Callable[[], DataFrame], allow_fetch: bool = True, stale_if_error: bool = False) -> DataFrame | None:
    """The table at path while younger than ttl (by its column snapshot_ts), else fetched and saved anew.

    allow_fetch false: whatever is there, or None.  stale_if_error: an old table is better than an error.
    """
    old = spark.read.parquet(path) if exists(spark, path) else None
    if old is not None:
        ts = old.agg(F.max("snapshot_ts")).first()[0]
        if not allow_fetch or (ts is not None and now - ts < ttl):
            return old
    if not allow_fetch:
        return None
    try:
        replace(fetch().withColumn("snapshot_ts", F.lit(float(now))), path)
    except Exception:
        if stale_if_error and old is not None:
            return old
        raise
    return spark.read.parquet(path)


def emit_truth(found: DataFrame, path: str) -> None:
    """Detections as an editable truth table; an existing one is never overwritten."""
    found.select("col", "row", "w", "h", "item_id", "rotated").write.mode("errorifexists").json(path)


def ring(spark: SparkSession, folder: str, keep: int = 3) -> list[str]:
    """Keeps the last bundles of a folder by name, deletes the others and returns their names."""
    fs, p = _fs(spark, folder)
    names = sorted((s.getPath().getName() for s in fs.listStatus(p)), reverse=True) if fs.exists(p) else []
    for name in names[keep:]:
        fs.delete(_fs(spark, f"{folder}/{name}")[1], True)
    return names[keep:]
