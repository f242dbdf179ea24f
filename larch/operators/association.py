"""Icons of a folder to catalogue items: incremental, by descriptors, and on to templates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larch.operators import identity, images, ranking, vectors

ROW = "filename string, item_id string, name string, score double, mtime double, preset boolean, unknown boolean, W int, H int, exact boolean"


def associate(files: DataFrame, references: DataFrame, known: DataFrame, exact: DataFrame | None = None) -> DataFrame:
    """The association table (ROW) after this run.

    files: filename, mtime, image; references: id, item_id, name, image; known: the table before;
    exact: filename -> item_id by validated hash, which needs no matching.  Files unchanged since the last
    run keep their rows, files that are gone lose theirs, the others are matched: shortlist by pooled
    descriptor within the footprint, rerank by masked correlation, then strong, preset or unknown.
    """
    fresh = ranking.changed_files(files.select("filename", "mtime", "image"), known.select("filename", "mtime"), "filename", "mtime")
    fresh = fresh.withColumn("id", F.xxhash64("filename"))
    looks = images.describe(fresh.select("id", F.lit("").alias("item_id"), F.col("filename").alias("name"), "image"))
    refs = images.describe(references)
    size = lambda df: df.withColumn("bucket", F.col("w") * 1000 + F.col("h")).select("id", "bucket", "vec", "mask", "pool")
    hits = vectors.shortlist_rerank(size(looks), size(refs), "bucket").withColumnRenamed("id", "icon")
    named = refs.select(F.col("id").alias("match_id"), "item_id", F.col("name").alias("item_name"))
    rows = looks.select(F.col("id").alias("icon"), F.col("name").alias("filename"), "w", "h").join(hits, "icon").join(named, "match_id", "left")
    rows = rows.join(fresh.select("filename", "mtime"), "filename")
    if exact is None:
        rows = rows.withColumn("_e", F.lit(None).cast("string"))
    else:
        rows = rows.join(exact.select("filename", F.col("item_id").alias("_e")), "filename", "left")
    kind = identity.association(F.col("score"))
    sure, lost = F.col("_e").isNotNull(), F.col("match_id").isNull() | (kind == "unknown")
    made = rows.select(
        "filename", F.coalesce("_e", F.when(~lost, F.col("item_id"))).alias("item_id"), F.when(sure | ~lost, F.col("item_name")).alias("name"), F.bround("score", 4).alias("score"), "mtime",
        (~sure & (kind == "preset")).alias("preset"), (~sure & lost).alias("unknown"), F.col("w").cast("int").alias("W"), F.col("h").cast("int").alias("H"), sure.alias("exact"),
    )
    columns = [c.split()[0] for c in ROW.split(", ")]
    return ranking.upsert(known.select(*columns), files, made.select(*columns), "filename")


def counters(table: DataFrame) -> DataFrame:
    """Rows by kind: exact, strong, preset, unknown."""
    kind = F.when(F.col("exact"), "exact").when(F.col("unknown"), "unknown").when(F.col("preset"), "preset").otherwise("strong")
    return table.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def icon_templates(table: DataFrame, files: DataFrame, items: DataFrame, slot: int = images.SLOT) -> DataFrame:
    """Templates from known icons of catalogue items; presets are marked as builds, exact ones by their source."""
    rows = table.filter("not unknown").select("filename", "item_id", "preset", "exact", "W", "H").join(items.select(F.col("id").alias("item_id"), F.col("name").alias("item_name"), "colour"), "item_id")
    rows = rows.join(files.select("filename", "image"), "filename")
    rows = rows.select("item_id", F.concat("item_name", F.when(F.col("preset"), " (build)").otherwise("")).alias("name"), F.col("W").alias("width"), F.col("H").alias("height"), "colour", "image", "exact")
    return images.build_templates(rows.filter("exact"), "cache-exact", slot).unionByName(images.build_templates(rows.filter("not exact"), "cache", slot))


def summary(templates: DataFrame) -> DataFrame:
    """Footprints and templates of an index."""
    return templates.agg(F.count_distinct("w", "h").alias("buckets"), F.count(F.lit(1)).alias("templates"))


def score_summary(found: DataFrame) -> DataFrame:
    return found.agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"), F.max("score").alias("most"), F.avg("score").alias("mean"))


def next_level(levels: DataFrame, current: int) -> DataFrame:
    return levels.filter(F.col("level") == current + 1).limit(1)


def sections_done(stations: DataFrame, completed: DataFrame) -> DataFrame:
    """Levels done and in all, by station."""
    rows = stations.select("name", F.explode("levels").alias("l")).join(completed.select(F.col("id").alias("_c")).distinct(), F.col("l.id") == F.col("_c"), "left")
    return rows.groupBy("name").agg(F.count("_c").alias("done"), F.count(F.lit(1)).alias("total"))
