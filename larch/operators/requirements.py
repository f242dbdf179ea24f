"""Outstanding requirements: two unnested sources in one aggregate, with what is there already."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larch.functions.basics import or_else

#: Currencies, in lower case, that are not required items.
CURRENCIES = ("roubles", "dollars", "euros")
NEED = "item_id string, name string, shortName string, type string, source_id string, source string, count long, fir boolean, active boolean, ord long"


def _wanted(item_id: Column, name: Column, count: Column) -> Column:
    return item_id.isNotNull() & (item_id != "") & (F.coalesce(count, F.lit(0)) > 0) & ~F.lower(F.coalesce(name, F.lit(""))).isin(*CURRENCIES)


def task_needs(tasks: DataFrame, completed: DataFrame, required_only: bool) -> DataFrame:
    """One row per qualifying hand-in objective of every task; active unless completed or filtered out."""
    o = F.col("o")
    rows = tasks.select("pos", "id", "name", F.col("trader.name").alias("trader"), F.coalesce("kappaRequired", F.lit(False)).alias("required"), F.posexplode("objectives").alias("k", "o"))
    rows = rows.filter((o["type"] == "giveItem") & _wanted(o["item"]["id"], o["item"]["name"], o["count"]))
    rows = rows.join(completed.select(F.col("id").alias("_done")).distinct(), F.col("id") == F.col("_done"), "left")
    active = F.col("_done").isNull() & (F.lit(not required_only) | F.col("required"))
    return rows.select(
        o["item"]["id"].alias("item_id"), or_else(o["item"]["name"], F.lit("?")).alias("name"), or_else(o["item"]["shortName"], F.lit("")).alias("shortName"),
        F.lit("task").alias("type"), F.col("id").alias("source_id"), F.concat_ws(" — ", or_else("trader", F.lit("?")), or_else("name", F.lit("?"))).alias("source"),
        o["count"].cast("long").alias("count"), F.coalesce(o["foundInRaid"], F.lit(False)).alias("fir"), active.alias("active"), (F.col("pos") * 1000 + F.col("k")).cast("long").alias("ord"),
    )


def station_needs(stations: DataFrame, completed: DataFrame) -> DataFrame:
    """One row per qualifying requirement of every station level; never found-in-raid only."""
    levels = stations.select("pos", F.col("name").alias("station"), F.posexplode("levels").alias("k", "l"))
    rows = levels.select("pos", "station", "k", F.col("l.id").alias("level_id"), F.col("l.level").alias("level"), F.posexplode("l.itemRequirements").alias("j", "r"))
    r = F.col("r")
    rows = rows.filter(_wanted(r["item"]["id"], r["item"]["name"], r["count"])).join(completed.select(F.col("id").alias("_done")).distinct(), F.col("level_id") == F.col("_done"), "left")
    return rows.select(
        r["item"]["id"].alias("item_id"), or_else(r["item"]["name"], F.lit("?")).alias("name"), or_else(r["item"]["shortName"], F.lit("")).alias("shortName"),
        F.lit("hideout").alias("type"), F.col("level_id").alias("source_id"), F.concat(F.col("station"), F.lit(" L"), F.col("level").cast("string")).alias("source"),
        r["count"].cast("long").alias("count"), F.lit(False).alias("fir"), F.col("_done").isNull().alias("active"), (F.lit(1_000_000_000_000) + F.col("pos") * 1_000_000 + F.col("k") * 1000 + F.col("j")).cast("long").alias("ord"),
    )


def outstanding(needs: DataFrame, have: DataFrame | None = None) -> DataFrame:
    """Per item: total_needed, fir_needed, sources in arrival order, have, remaining; items no one needs are left out.

    needs: rows as of NEED.  Name and short name are those seen first, even when inactive.  One hash
    aggregate with partial sums; have (item_id, have) is a left join.
    """
    active = F.col("active")
    source = F.struct("ord", "type", F.col("source").alias("name"), "count", "fir")
    agg = needs.groupBy("item_id").agg(
        F.min(F.struct("ord", "name", "shortName")).alias("first"),
        F.sum(F.when(active, F.col("count")).otherwise(0)).cast("long").alias("total_needed"),
        F.sum(F.when(active & F.col("fir"), F.col("count")).otherwise(0)).cast("long").alias("fir_needed"),
        F.array_sort(F.collect_list(F.when(active, source))).alias("sources"),
    )
    agg = agg.filter("total_needed > 0").select("item_id", F.col("first.name").alias("name"), F.col("first.shortName").alias("shortName"), "total_needed", "fir_needed", "sources", F.col("first.ord").alias("first_ord"))
    if have is None:
        agg = agg.withColumn("have", F.lit(0).cast("long"))
    else:
        agg = agg.join(have.select(F.col("item_id").alias("_i"), F.col("have").cast("long").alias("have")), F.col("item_id") == F.col("_i"), "left").drop("_i").withColumn("have", F.coalesce("have", F.lit(0).cast("long")))
    return agg.withColumn("remaining", F.greatest(F.lit(0).cast("long"), F.col("total_needed") - F.col("have")))


def by_remaining(aggregate: DataFrame) -> DataFrame:
    return aggregate.orderBy(F.desc("remaining"), "first_ord")


def short(aggregate: DataFrame) -> DataFrame:
    return aggregate.filter("have < total_needed")


def search(aggregate: DataFrame, text: str, hide_done: bool = False) -> DataFrame:
    """Case-insensitive substring of name or short name; done items hidden if asked."""
    q = text.lower()
    out = aggregate.filter(F.contains(F.lower("name"), F.lit(q)) | F.contains(F.lower("shortName"), F.lit(q)))
    return out.filter("not (have >= total_needed)") if hide_done else out


def nested(needs: DataFrame, key: str = "source_id") -> DataFrame:
    """Rows of needs back under their task or level: one row per source with its items in order."""
    item = F.struct("ord", "item_id", "name", "count", "fir")
    return needs.groupBy(key, "type", "source").agg(F.min("ord").alias("first_ord"), F.array_sort(F.collect_list(item)).alias("items"), F.bool_or("active").alias("active")).orderBy("first_ord")


def tasks_by_trader(tasks: DataFrame, text: str = "", completed: DataFrame | None = None) -> DataFrame:
    """Traders in order with their tasks by least level, and how many are done; text filters name or trader."""
    rows = tasks.select("id", "name", "minPlayerLevel", F.col("trader.name").alias("trader"), "pos")
    q = text.lower()
    rows = rows.filter(F.contains(F.lower("name"), F.lit(q)) | F.contains(F.lower("trader"), F.lit(q))) if q else rows
    done = completed.select(F.col("id").alias("_done")).distinct() if completed is not None else None
    rows = rows.withColumn("done", F.lit(False)) if done is None else rows.join(done, F.col("id") == F.col("_done"), "left").withColumn("done", F.col("_done").isNotNull())
    task = F.struct("minPlayerLevel", "pos", "id", "name", "done")
    return rows.groupBy("trader").agg(F.array_sort(F.collect_list(task)).alias("tasks"), F.count_if("done").alias("n_done"), F.count(F.lit(1)).alias("n")).orderBy("trader")


def open_levels(stations: DataFrame, text: str, completed: list[str]) -> DataFrame:
    """Stations whose name holds text, with their levels not completed; stations without any go."""
    left = F.filter("levels", lambda lv: ~lv["id"].isin(*completed) if completed else F.lit(True))
    return stations.filter(F.contains(F.lower("name"), F.lit(text.lower()))).withColumn("levels", left).filter(F.size("levels") > 0)
