"""Ordered operators: top rows with margins, rings, numbering, running balances and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each key, numbered; a limit per key, which Spark applies before the shuffle too."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def best_with_margin(scores: DataFrame, key: str, item: str = "item_id", value: str = "score") -> DataFrame:
    """Per key the best item, its score, and the margin to the best score of any other item (0 if none).

    Two aggregates: the best by item first, which combines before the shuffle, and then over items.
    """
    by_item = scores.groupBy(key, item).agg(F.max(value).alias("_s"))
    # Best score first, the smaller item on ties.
    ranked = by_item.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("_s")).alias("m"), F.col(item).alias("i")))).alias("r"))
    rival = F.coalesce(-F.get("r", F.lit(1))["m"], F.lit(0.0))
    best = -F.col("r")[0]["m"]
    return ranked.select(key, F.col("r")[0]["i"].alias(item), best.alias(value), (best - rival).alias("margin"))


def keep_last(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """A ring: the last n rows of each key."""
    return top_n(df, keys, order, n)


def reading_order(rows: DataFrame, keep: str = "keep", order: tuple[str, ...] = ("panel", "row", "col")) -> DataFrame:
    """Numbers 1, 2, ... for rows not kept in reading order; kept rows are marked K and come last.

    Rows are numbered within their line (all of `order` but the last), and lines start where those before end, so only
    one count a line is gathered, and no window spans the table.
    """
    line = [keep, *order[:-1]]
    heads = rows.groupBy(*line).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(keep).orderBy(*order[:-1]).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(*[F.col(c).alias(f"_{c}") for c in line], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_head"))
    match = F.lit(True)
    for c in line:
        match = match & F.col(c).eqNullSafe(F.col(f"_{c}"))
    n = (F.col("_head") + F.row_number().over(Window.partitionBy(*line).orderBy(order[-1]))).cast("long")
    out = rows.join(heads, match).withColumn("place", n)
    return out.withColumn("number", F.when(F.col(keep), "K").otherwise(F.col("place").cast("string"))).drop("_head", *[f"_{c}" for c in line])


def clamped_balance(edits: DataFrame, key: str, order: list[Column], delta: str, start: Column | None = None) -> DataFrame:
    """Balance after each edit when every step is max(0, balance + delta).

    Closed form: running sum less the smallest one so far (or 0), so it needs no state but two windows.
    """
    start = F.lit(0) if start is None else start
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = edits.withColumn("_s", start + F.sum(delta).over(w))
    return rows.withColumn("balance", F.col("_s") - F.least(F.lit(0), F.min("_s").over(w))).drop("_s")


def running_share(cells: DataFrame, key: str, order: list[str], flag: str) -> DataFrame:
    """Occupied cells so far in reading order, and of all."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    one = F.col(flag).cast("int")
    return cells.withColumn("done", F.sum(one).over(w)).withColumn("total", F.sum(one).over(Window.partitionBy(key)))


def since(rows: DataFrame, ts: str, cursor: float) -> DataFrame:
    """What came after the cursor and has content."""
    return rows.filter((F.col(ts) > cursor) & F.col("content").isNotNull())


def freshness(rows: DataFrame, ts: Column, now: Column, ttl: float) -> DataFrame:
    """fresh if younger than ttl (strictly), and the age in minutes to one place; now is a literal."""
    age = now - ts
    return rows.withColumn("fresh", age < ttl).withColumn("age_min", F.bround(age / 60.0, 1))


def changed_files(files: DataFrame, known: DataFrame, key: str, mtime: str, slack: float = 1.0) -> DataFrame:
    """Files that are new, or whose time differs by slack or more."""
    old = known.select(F.col(key).alias("_k"), F.col(mtime).alias("_m"))
    return files.join(old, F.col(key) == F.col("_k"), "left").filter(F.col("_m").isNull() | (F.abs(F.col("_m") - F.col(mtime)) >= slack)).drop("_k", "_m")


def upsert(known: DataFrame, files: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Known rows of files that are still there, with fresh rows in place of changed ones."""
    stay = known.join(fresh.select(key), key, "left_anti").unionByName(fresh)
    return stay.join(files.select(key).distinct(), key, "left_semi")
