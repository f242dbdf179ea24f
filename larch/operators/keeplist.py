"""The kept list as a flat table: merge with a fresh list of names, and the small edits.

Columns: category_id, pos, id, name, aliases, acquired, source, tdev_id (more may follow).
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larch.functions.similarity import plain, token_set
from larch.operators.protection import COLLECTOR

LISTED, CUSTOM = "wiki", "custom"
RENAME_CUTOFF = 95.0
MERGED = "category_id string, pos long, id string, name string, aliases array<string>, acquired boolean, source string, tdev_id string, status string"


def new_id(name: str) -> str:
    """Eight characters that depend on the name only, so that a rerun merges alike."""
    return hashlib.sha256(name.encode()).hexdigest()[:8]


def merge_exact(entries: DataFrame, names: DataFrame, category: str = COLLECTOR) -> DataFrame:
    """The merge without renames, as one full outer join on the case-folded name; for lists of any size.

    names: pos, name.  status: kept, added or removed; removed rows stay in the result for the report.
    """
    mine = entries.filter(F.col("category_id") == category).select("category_id", "pos", "id", "name", "aliases", "acquired", "source", "tdev_id").withColumn("key", F.lower("name"))
    fresh = names.groupBy(F.lower("name").alias("nkey")).agg(F.min(F.struct("pos", "name")).alias("n"))
    both = mine.join(fresh, F.col("key") == F.col("nkey"), "full")
    listed, own = F.col("nkey").isNotNull(), F.col("key").isNotNull()
    status = F.when(~own, "added").when(listed | F.coalesce(F.col("source") == CUSTOM, F.lit(False)), "kept").otherwise("removed")
    return both.select(
        F.coalesce("category_id", F.lit(category)).alias("category_id"), F.coalesce("pos", F.lit(1_000_000).cast("long") + F.col("n.pos")).alias("pos"),
        F.coalesce("id", F.substring(F.sha2(F.col("n.name"), 256), 1, 8)).alias("id"), F.coalesce("name", "n.name").alias("name"),
        F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.coalesce("acquired", F.lit(False)).alias("acquired"),
        F.when(listed, LISTED).otherwise(F.col("source")).alias("source"), "tdev_id", status.alias("status"),
    )


def _renamed(loose: pd.DataFrame) -> pd.DataFrame:
    """Added names, in order, take over the removed entry that is most like them, if it is nearly the same."""
    order = loose.sort_values("pos", kind="stable")
    gone = order[order["status"] == "removed"].reset_index(drop=True)
    words = [plain(x) for x in gone["name"]]
    free = list(range(len(gone)))
    out = []
    for fresh in order[order["status"] == "added"].to_dict("records"):
        likeness = [token_set(plain(fresh["name"]), words[i]) for i in free]
        if likeness and max(likeness) >= RENAME_CUTOFF:
            old = gone.iloc[free.pop(likeness.index(max(likeness)))].to_dict()
            aliases = list(old["aliases"])
            fresh = old | {"name": fresh["name"], "aliases": aliases + [old["name"]] * (old["name"] not in aliases), "source": LISTED, "status": "kept"}
        out.append(fresh)
    return pd.DataFrame([*out, *gone.iloc[free].to_dict("records")], columns=[c.split()[0] for c in MERGED.split(", ")])


def merge_names(entries: DataFrame, names: list[str], category: str = COLLECTOR) -> DataFrame:
    """merge_exact(), and then renames among what it adds and removes.

    A name that is there keeps its entry; one that is nearly there (token-set ratio 95 or more, of entries
    that no name has and that are not custom) renames it and keeps the old name as an alias; others are added.  Entries
    that no name claims are removed unless custom.  Which entry a name takes depends on the names before it, so
    this step is one group; it holds only the names and entries of one list that have no exact counterpart.
    """
    listed = entries.sparkSession.createDataFrame(list(enumerate(names)), "pos long, name string")
    merged = merge_exact(entries, listed, category)
    loose = merged.filter("status <> 'kept'").groupBy("category_id").applyInPandas(_renamed, MERGED)
    return merged.filter("status = 'kept'").unionByName(loose)


def summary(merged: DataFrame) -> DataFrame:
    """One row: names added and removed in order, and how many entries stay."""
    pick = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("status") == s, F.struct("pos", "name")))), lambda x: x["name"])
    return merged.agg(pick("added").alias("added"), pick("removed").alias("removed"), F.count_if(F.col("status") != "removed").alias("total"))


def backfill_ids(entries: DataFrame, index: DataFrame) -> DataFrame:
    """tdev_id from the exact name where it is missing."""
    key = index.select(F.col("key").alias("_k"), F.col("item_id").alias("_i"))
    return entries.join(key, F.lower("name") == F.col("_k"), "left").withColumn("tdev_id", F.coalesce(F.when(F.col("tdev_id") != "", F.col("tdev_id")), "_i")).drop("_k", "_i")


def toggle(entries: DataFrame, entry_id: str) -> DataFrame:
    return entries.withColumn("acquired", F.when(F.col("id") == entry_id, ~F.coalesce("acquired", F.lit(False))).otherwise(F.col("acquired")))


def acquire(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """acquired for the ids given; `updated` tells the rows that change."""
    hit = ids.select(F.col("id").alias("_i")).distinct()
    rows = entries.join(hit, F.col("id") == F.col("_i"), "left")
    rows = rows.withColumn("updated", F.col("_i").isNotNull() & ~F.coalesce("acquired", F.lit(False)))
    return rows.withColumn("acquired", F.col("updated") | F.coalesce("acquired", F.lit(False))).drop("_i")


def add_custom(entries: DataFrame, category: str, name: str, aliases: list[str] | None = None, task: str | None = None, count: int | None = None) -> DataFrame:
    """entries with a custom one at the category's end; task and count become columns if either is given."""
    last = entries.filter(F.col("category_id") == category).agg((F.coalesce(F.max("pos"), F.lit(-1)) + 1).alias("pos"))
    row = last.select(
        F.lit(category).alias("category_id"), F.col("pos").cast("long").alias("pos"), F.lit(new_id(name)).alias("id"), F.lit(name).alias("name"),
        F.array(*[F.lit(a) for a in aliases or []]).cast("array<string>").alias("aliases"), F.lit(False).alias("acquired"), F.lit(CUSTOM).alias("source"), F.lit(None).cast("string").alias("tdev_id"),
        *([] if task is None and count is None else [F.lit(task).cast("string").alias("task"), F.lit(count).cast("int").alias("count")]),
    )
    return entries.unionByName(row, allowMissingColumns=True)


def remove(entries: DataFrame, entry_id: str) -> DataFrame:
    return entries.filter(F.col("id") != entry_id)


def restart(entries: DataFrame) -> DataFrame:
    """Everything not acquired again."""
    return entries.withColumn("acquired", F.lit(False))


def advance(progress: DataFrame, most: int = 6) -> DataFrame:
    """The next level of prestige, with all progress back to nothing; restart() does the same for the list."""
    none = F.array().cast("array<string>")
    return progress.withColumns(
        {"prestige": F.least(F.lit(most), F.coalesce("prestige", F.lit(0)) + 1), "completed_tasks": none, "completed_hideout": none, "have": F.from_json(F.lit("{}"), "map<string,int>")}
    )


def set_completed(progress: DataFrame, column: str, item: str, done: bool) -> DataFrame:
    """Adds to or takes from a sorted distinct array; doing so twice changes nothing."""
    one = F.array(F.lit(item))
    changed = F.array_union(F.coalesce(column, F.array().cast("array<string>")), one) if done else F.array_except(column, one)
    return progress.withColumn(column, F.array_sort(F.array_distinct(changed)))
