"""Reading snapshots and stores: JSON documents by given schemas, icon folders, versioned template tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larch.sources import schemas

#: Version of the template tables; others are not read.
TEMPLATE_VERSION = 6


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_json(spark: SparkSession, path: str, ddl: str, default: list | None = None) -> DataFrame:
    """One JSON document as a row of the given schema; the default rows if the file is missing.

    What can't be read becomes null, field by field (PERMISSIVE).
    """
    schema = StructType.fromDDL(ddl)
    if not exists(spark, path):
        return spark.createDataFrame(default or [], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def items(spark: SparkSession, path: str) -> DataFrame:
    """Item rows of a price snapshot {timestamp, items}, with their position and the snapshot's time."""
    doc = read_json(spark, path, f"timestamp double, items array<{schemas.struct(schemas.ITEM)}>")
    rows = doc.select(F.col("timestamp").alias("snapshot_ts"), F.posexplode(F.coalesce("items", F.array())).alias("pos", "i"))
    return rows.select("i.*", F.col("pos").cast("long").alias("pos"), "snapshot_ts")


def catalogue(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(tasks, stations) of a catalogue {timestamp, errors, tasks, hideoutStations}; errors in it are raised, null lists are empty."""
    doc = read_json(spark, path, f"timestamp double, errors array<struct<message:string>>, tasks array<{schemas.struct(schemas.TASK)}>, hideoutStations array<{schemas.struct(schemas.STATION)}>")
    bad = F.size(F.coalesce("errors", F.array().cast("array<struct<message:string>>"))) > 0
    doc = doc.withColumn("tasks", F.when(bad, F.raise_error(F.concat(F.lit("catalogue: "), F.get("errors", F.lit(0))["message"])).cast("array<" + schemas.struct(schemas.TASK) + ">")).otherwise(F.col("tasks")))
    rows = lambda c: doc.select(F.posexplode(c).alias("pos", "x")).select("x.*", F.col("pos").cast("long").alias("pos"))
    return rows("tasks"), rows("hideoutStations")


def progress(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, schemas.PROGRESS, [([], [], {})])


def completed(progress_row: DataFrame, column: str) -> DataFrame:
    return progress_row.select(F.explode(column).alias("id"))


def have(progress_row: DataFrame) -> DataFrame:
    return progress_row.select(F.explode("have").alias("item_id", "have"))


def keep_entries(spark: SparkSession, path: str) -> DataFrame:
    """The kept list as a flat table; pos counts within a category."""
    doc = read_json(spark, path, schemas.KEEP_LIST)
    cats = doc.select(F.explode("categories").alias("c")).select(F.col("c.id").alias("category_id"), F.col("c.label").alias("category_label"), F.posexplode("c.items").alias("pos", "e"))
    return cats.select("category_id", "category_label", F.col("pos").cast("long").alias("pos"), "e.*")


def associations(spark: SparkSession, path: str) -> DataFrame:
    """Icon associations {filename: {...}} as rows; a missing or broken file gives none."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"filename string, a {schemas.ASSOCIATION}").select("filename", "a.*")
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{schemas.ASSOCIATION}>").alias("m"))
    return doc.select(F.explode("m").alias("filename", "a")).select("filename", "a.*")


def icon_index(spark: SparkSession, path: str) -> DataFrame:
    """hash, file_number of an index {hash: number}."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,bigint>").alias("m"))
    return doc.select(F.explode("m").alias("h", "file_number")).select(F.col("h").try_cast("bigint").alias("hash"), "file_number")


def icon_files(spark: SparkSession, folder: str, pattern: str = "*.png") -> DataFrame:
    """filename, mtime (seconds), length and content of the icons in a folder."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.unix_micros("modificationTime").cast("double").alias("us"), "length", "content").select("filename", (F.col("us") / 1e6).alias("mtime"), "length", "content")


def first_folder(spark: SparkSession, *candidates: str | None) -> str | None:
    """The first candidate folder that has an icon index."""
    return next((c for c in candidates if c and exists(spark, f"{c}/index.json")), None)


def templates(spark: SparkSession, path: str, version: int = TEMPLATE_VERSION) -> DataFrame | None:
    """Template table of the current version, partitioned by footprint; None if there is none."""
    at = f"{path}/version={version}"
    return spark.read.parquet(at) if exists(spark, f"{at}/_SUCCESS") else None


def release(spark: SparkSession, path: str, asset: str) -> DataFrame:
    """tag, page and the first asset of the given name of a release document."""
    doc = read_json(spark, path, schemas.RELEASE)
    found = F.get(F.filter("assets", lambda a: a["name"] == asset), F.lit(0))
    return doc.select("tag_name", "html_url", found["browser_download_url"].alias("asset_url"))
