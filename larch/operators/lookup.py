"""Resolving names to catalogue items: the name index, the cascade of ever weaker matches, fuzzy lookups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larch.functions.similarity import weighted_ratio

#: Least length of an alias that may decide, and the fuzzy cutoff of the cascade and of labels.
ALIAS_LENGTH, FUZZY_CUTOFF, LABEL_CUTOFF = 4, 93.0, 78.0
#: Different labels, and different names, that a block of the comparison holds on average.
LABEL_BLOCK = 4_096


def last_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in the given order, which must be unique within it."""
    w = Window.partitionBy(*keys).orderBy(*[o.desc() for o in order])
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def name_index(items: DataFrame, item: str = "id", name: str = "name", short: str = "shortName", pos: str = "pos") -> DataFrame:
    """key -> item: lower-case names and short names; the later item, and the short name, win."""
    keys = F.array(F.struct(F.lower(name).alias("key"), F.lit(0).alias("k")), F.struct(F.lower(short).alias("key"), F.lit(1).alias("k")))
    exploded = items.select(F.col(item).alias("item_id"), F.col(pos).alias("pos"), F.explode(keys).alias("e"))
    rows = exploded.select("item_id", F.col("e.key").alias("key"), (F.col("pos") * 2 + F.col("e.k")).alias("ord")).filter("key is not null and key <> ''")
    # One aggregate: the latest position carries its item.
    return rows.groupBy("key").agg(F.max(F.struct("ord", "item_id")).alias("m")).select("key", F.col("m.item_id").alias("item_id"), F.col("m.ord").alias("ord"))


def _persisted(entries: DataFrame, index: DataFrame) -> DataFrame:
    return entries.join(index.select(F.col("item_id").alias("_known")).distinct(), F.col("tdev_id") == F.col("_known"), "left")


def resolve(entries: DataFrame, index: DataFrame, fuzzy: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """entries (id, name, aliases, tdev_id, pos) with item_id and the step `how` that found it; null if unmapped.

    Trust in this order: exact name or short name; persisted id if the catalogue has it; aliases of
    four characters or more that agree on one item; fuzzy(entries left, index) if given.
    """
    exact = index.select(F.col("key").alias("_key"), F.col("item_id").alias("_exact"))
    base = _persisted(entries.join(exact, F.lower("name") == F.col("_key"), "left"), index)
    alias = (
        entries.select("id", F.explode("aliases").alias("alias"))
        .filter(F.length("alias") >= ALIAS_LENGTH)
        .join(exact, F.lower("alias") == F.col("_key"))
        .groupBy(F.col("id").alias("_aid"))
        .agg(F.min("_exact").alias("_alias"), F.max("_exact").alias("_most"))
        .filter("_alias = _most")
        .drop("_most")
    )
    base = base.drop("_key").join(alias, F.col("id") == F.col("_aid"), "left").drop("_aid")
    found = F.coalesce("_exact", "_known", "_alias")
    how = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_known").isNotNull(), "id").when(F.col("_alias").isNotNull(), "alias")
    out = base.withColumn("item_id", found).withColumn("how", how).drop("_exact", "_known", "_alias")
    if fuzzy is None:
        return out
    near = fuzzy(out.filter("item_id is null").select("id", "name"), index).select(F.col("id").alias("_fid"), F.col("item_id").alias("_near"))
    out = out.join(near, F.col("id") == F.col("_fid"), "left").drop("_fid")
    return out.withColumn("how", F.coalesce("how", F.when(F.col("_near").isNotNull(), "fuzzy"))).withColumn("item_id", F.coalesce("item_id", "_near")).drop("_near")


def mapped(resolved: DataFrame) -> DataFrame:
    """One entry by item: the last one that maps to it."""
    return last_by(resolved.filter("item_id is not null"), ["item_id"], [F.col("pos")])


def unmapped(resolved: DataFrame) -> DataFrame:
    """Entries that no step found, in entry order."""
    return resolved.filter("item_id is null").select("pos", "id", "name").orderBy("pos")


def note(rows: DataFrame, most: int = 3) -> DataFrame:
    """One row, if there is any name: the first names by pos, and an ellipsis if there are more."""
    few = rows.orderBy("pos").limit(most + 1).agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("x")).filter("size(x) > 0")
    names = F.transform(F.slice("x", 1, most), lambda r: r["name"])
    return few.select(F.concat(F.array_join(names, ", "), F.when(F.size("x") > most, "…").otherwise("")).alias("note"))


def fuzzy_lookup(queries: DataFrame, index: DataFrame, cutoff: float = FUZZY_CUTOFF, similarity: Callable[[Column, Column], Column] = weighted_ratio, length_band: float | None = None) -> DataFrame:
    """id, item_id, score: the key most similar to each query's name, first by key order on ties, cutoff or better.

    Every query is compared with every key that shares a character pair (and, with a length_band, whose
    length is that close); pairs are made by a join on the pair, never by a cross join.
    """
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - 1)), lambda i: F.substring(c, i, F.lit(2))))
    q = queries.select(F.col("id").alias("qid"), F.lower("name").alias("q"))
    k = index.select("key", "item_id", "ord")
    pairs = q.withColumn("g", F.explode(grams(F.col("q")))).join(k.withColumn("g", F.explode(grams(F.col("key")))), "g")
    if length_band is not None:
        pairs = pairs.filter(F.least(F.length("q"), F.length("key")) >= length_band * F.greatest(F.length("q"), F.length("key")))
    pairs = pairs.select("qid", "q", "key", "item_id", "ord").distinct().withColumn("score", similarity(F.col("q"), F.col("key"))).filter(F.col("score") >= cutoff)
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "ord")
    return pairs.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(F.col("qid").alias("id"), "item_id", "key", "score")


def match_labels(labels: DataFrame, items: DataFrame, cutoff: float = LABEL_CUTOFF, similarity: Callable[[Column, Column], Column] = weighted_ratio) -> DataFrame:
    """labels (id, text, fw, fh) to items (item_id, name, shortName, width, height, pos) of that footprint, either way round.

    The footprint is an equi-join key, so only items of the same size are compared; the native
    orientation comes first on ties, then pos, the short name and the smaller item_id.  Copies share their result: each
    different label of a footprint meets each different name of that footprint once, in a grid of blocks.  The similarity
    must depend on the two texts alone.
    """
    rows = labels.select("id", F.lower("text").alias("q"), "fw", "fh").filter("q is not null")
    kinds = rows.select("q", "fw", "fh").distinct()
    names = F.array_distinct(F.filter(F.array(F.lower("shortName"), F.lower("name")), lambda x: x.isNotNull() & (x != "")))
    keys = items.select("item_id", "pos", F.col("width").alias("w"), F.col("height").alias("h"), F.posexplode(names).alias("k", "key"))
    keys = keys.groupBy("w", "h", "key").agg(F.min(F.struct("pos", "k", "item_id")).alias("m")).select("w", "h", "key", "m.*")
    salts, blocks = max(1, -(-kinds.count() // LABEL_BLOCK)), max(1, -(-keys.count() // LABEL_BLOCK))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sides = F.array_distinct(F.array(F.struct(F.col("fw").alias("w"), F.col("fh").alias("h"), F.lit(0).alias("side")), F.struct(F.col("fh").alias("w"), F.col("fw").alias("h"), F.when(F.col("fw") == F.col("fh"), 0).otherwise(1).alias("side"))))
    left = kinds.withColumn("s", F.explode(sides)).select("q", "fw", "fh", "s.*").withColumn("salt", deal("q", salts)).withColumn("block", each(blocks))
    right = keys.withColumn("block", deal("key", blocks)).withColumn("salt", each(salts))
    # A fixed number of tasks: Spark would merge them by bytes, but the work is in the pairs.
    cell, tasks = ["w", "h", "salt", "block"], int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = left.repartition(tasks, *cell).join(right.repartition(tasks, *cell), cell)
    pairs = pairs.withColumn("score", similarity(F.col("q"), F.col("key"))).filter(F.col("score") >= cutoff)
    first = lambda df, by: df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "side", "pos", "k", "item_id"))).filter("_n = 1")
    best = first(pairs, ["q", "fw", "fh"]).select("q", "fw", "fh", "item_id", "key", "score", "side", "pos", "k")
    # A repeated id keeps the best of its labels.
    return first(rows.join(best, ["q", "fw", "fh"]), ["id"]).select("id", "item_id", "key", "score")


def first_alias_hit(entries: DataFrame, index: DataFrame) -> DataFrame:
    """id, item_id by name or else by the first alias that hits, without rules on length or ambiguity."""
    names = F.posexplode(F.concat(F.array(F.col("name")), F.coalesce("aliases", F.array().cast("array<string>")))).alias("k", "n")
    hits = entries.select("id", names).join(index, F.lower("n") == F.col("key"))
    return hits.groupBy("id").agg(F.min(F.struct("k", "item_id")).alias("m")).select("id", F.col("m.item_id").alias("item_id"))
