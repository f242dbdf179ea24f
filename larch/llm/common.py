"""Session helpers of the training-data operators: durable cuts of the lineage and plain names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the cluster names it in spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary one of its machine; on a cluster that would lose files, so it is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="larch-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


#: Folders that cut() has written and that are still there.
_WRITTEN: set[str] = set()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: later stages survive lost executors and never recompute it.

    Operators that are read lazily leave some of these tables behind; clear() deletes them
    once results are out.
    """
    at = f"{shared_dir(df.sparkSession)}/larch-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out._larch_path = at
    _WRITTEN.add(at)
    return out


def drop(df: DataFrame) -> None:
    """Delete a table made by cut(), once nothing reads it any more."""
    at = getattr(df, "_larch_path", None)
    if at:
        _delete(df.sparkSession, at)


def written() -> frozenset[str]:
    """The tables of cut() that are there."""
    return frozenset(_WRITTEN)


def clear(spark: SparkSession, before: frozenset[str], *keep: DataFrame) -> None:
    """Delete the tables that cut() has written since `before`, but those to keep; nothing may read the others any more."""
    for at in _WRITTEN - before - {getattr(df, "_larch_path", None) for df in keep}:
        _delete(spark, at)


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _WRITTEN.discard(at)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, key: str, order: list, buckets: int, out: str) -> DataFrame:
    """Gapless numbers from 0 within each key, without gathering a key in one task.

    Rows of a key go to `buckets` hash buckets; a small table of bucket counts (keys x buckets
    rows at most) gives each bucket its offset, and rows are numbered within their bucket only.
    `order` must identify rows up to equal ones, so that a rerun numbers them alike.
    """
    from pyspark.sql import Window

    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = df.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    heads = counts.select(F.col(key).alias("_key"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_head"))
    inner = Window.partitionBy(key, "_bucket").orderBy(*order)
    return (
        df.withColumn("_row", F.row_number().over(inner) - 1)
        .join(heads, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_bucket") == F.col("_b")))
        .withColumn(out, (F.col("_head") + F.col("_row")).cast("long"))
        .drop("_bucket", "_row", "_key", "_b", "_head")
    )
