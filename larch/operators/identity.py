"""Identity by hash, its validation gate, and the scorer of detections against truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least score of a strong association, of a preset; and what the gate asks for.
STRONG, PRESET = 0.86, 0.55
AGREEMENT, OVERLAP, COVERAGE = 0.95, 50, 0.05


def exact_map(items: DataFrame, index: DataFrame) -> DataFrame:
    """file_number -> item_id for items (item_id, hash, pos) and index (hash, file_number).

    A hash of several items is dropped.  A file that several hashes reach is dropped at the second, back
    at the third, and so on: an odd number of hits keeps the last by position, an even one none.
    """
    single = items.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("pos", "item_id")).alias("m")).filter("n = 1").select("hash", "m.pos", "m.item_id")
    hits = single.join(index, "hash").groupBy("file_number").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("pos", "item_id")).alias("m"))
    return hits.filter("n % 2 = 1").select("file_number", F.col("m.item_id").alias("item_id"))


def association(score: Column) -> Column:
    return F.when(score >= STRONG, "strong").when(score >= PRESET, "preset").otherwise("unknown")


def gate(exact: DataFrame, visual: DataFrame, n_index: int | Column) -> DataFrame:
    """One row: agreement, overlap, coverage, enabled.

    exact: key, item_id; visual: key, item_id, score, preset, unknown; only strong visual ids count.
    """
    weak = F.coalesce("unknown", F.lit(False)) | F.coalesce("preset", F.lit(False)) | (F.coalesce("score", F.lit(0.0)) < STRONG)
    other = visual.filter(~weak).select("key", F.col("item_id").alias("seen"))
    rows = exact.join(other, "key", "left")
    n_index = F.lit(n_index) if isinstance(n_index, int) else n_index
    out = rows.agg(F.count("seen").alias("overlap"), F.count_if(F.col("seen") == F.col("item_id")).alias("agree"), F.count(F.lit(1)).alias("n"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = out.select(share(F.col("agree"), F.col("overlap")).alias("agreement"), "overlap", share(F.col("n"), n_index).alias("coverage"))
    return out.withColumn("enabled", (F.col("agreement") >= AGREEMENT) & (F.col("overlap") >= OVERLAP) & (F.col("coverage") >= COVERAGE))


def collisions(items: DataFrame) -> DataFrame:
    """How many hashes have how many items."""
    return items.groupBy("hash").agg(F.count(F.lit(1)).alias("items")).groupBy("items").agg(F.count(F.lit(1)).alias("hashes"))


def probe(items: DataFrame, index: DataFrame) -> DataFrame:
    """One row: hashes of the items, and how many the index has."""
    hashes = items.select("hash").distinct().join(index.select(F.col("hash").alias("_h")).distinct(), F.col("hash") == F.col("_h"), "left")
    return hashes.agg(F.count(F.lit(1)).alias("total"), F.count("_h").alias("hits"))


def score(truth: DataFrame, found: DataFrame, group: str = "image", keys: tuple[str, ...] = ("row", "col")) -> DataFrame:
    """Per group and overall (group null): n, tp, wrong, fn, fp, accuracy, precision, recall.

    Truth and detections meet by place in a full outer join; several at one place count as one, but
    every truth row counts in n.
    """
    k = [group, *keys]
    t = truth.groupBy(*k).agg(F.max("item_id").alias("t"), F.count(F.lit(1)).alias("n"))
    d = found.groupBy(*k).agg(F.max("item_id").alias("d"))
    both = t.join(d, k, "full")
    totals = both.rollup(group).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("t") == F.col("d")).alias("tp"), F.count_if(F.col("t") != F.col("d")).alias("wrong"),
        F.count_if(F.col("t").isNotNull() & F.col("d").isNull()).alias("fn"), F.count_if(F.col("t").isNull() & F.col("d").isNotNull()).alias("fp"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return totals.select("*", share(F.col("tp"), F.col("n")).alias("accuracy"), share(F.col("tp"), F.col("tp") + F.col("wrong") + F.col("fp")).alias("precision"), share(F.col("tp"), F.col("tp") + F.col("wrong") + F.col("fn")).alias("recall"))


def failures(truth: DataFrame, found: DataFrame, group: str = "image", keys: tuple[str, ...] = ("row", "col"), most: int = 40) -> DataFrame:
    """The report of what score() counts as wrong, missed or extra: the first `most` places of each group, by their keys."""
    k = [group, *keys]
    t, d = (x.groupBy(*k).agg(F.max("item_id").alias(name)) for x, name in ((truth, "want"), (found, "got")))
    kind = F.when(F.col("got").isNull(), "missed").when(F.col("want").isNull(), "extra").when(F.col("want") != F.col("got"), "wrong")
    rows = t.join(d, k, "full").withColumn("kind", kind).filter("kind is not null")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*keys))).filter(F.col("place") <= most)
