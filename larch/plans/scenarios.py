"""Whole requests as plans over the operators: keep scan, sell scan, tasks view, list sync."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larch.functions import pricing
from larch.operators import keeplist, lookup, protection, ranking, requirements


def tasks_view(tasks: DataFrame, stations: DataFrame, done_tasks: DataFrame, done_levels: DataFrame, have: DataFrame, required_only: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outstanding items by remaining need, tasks with their items, levels with theirs)."""
    a, b = requirements.task_needs(tasks, done_tasks, required_only), requirements.station_needs(stations, done_levels)
    return requirements.by_remaining(requirements.outstanding(a.unionByName(b), have)), requirements.nested(a), requirements.nested(b)


def protected_items(entries: DataFrame, index: DataFrame, aggregate: DataFrame, fuzzy=lookup.fuzzy_lookup) -> DataFrame:
    kept = lookup.mapped(lookup.resolve(entries, index, fuzzy)).select("item_id", "category_id", "acquired")
    return protection.protected(kept, aggregate)


def sell_scan(detections: DataFrame, items: DataFrame, protected: DataFrame) -> DataFrame:
    """Detections of known items in reading order: numbered with a recommendation, kept ones last and marked K.

    items: id, basePrice, low24hPrice, avg24hPrice, sellFor.
    """
    best = pricing.best_offer("sellFor")
    priced = items.select(F.col("id").alias("item_id"), F.col("name").alias("item_name"), pricing.recommendation("basePrice", "low24hPrice", "avg24hPrice", best["name"], best["price"]).alias("r"))
    rows = protection.verdicts(detections, priced, protected)
    return ranking.reading_order(rows).orderBy("keep", "place").select("number", "frame_id", "panel", "row", "col", "w", "h", "item_id", "item_name", "keep", "keep_reason", "r.*")


def keep_scan(detections: DataFrame, entries: DataFrame, index: DataFrame, fuzzy=lookup.fuzzy_lookup) -> tuple[DataFrame, DataFrame]:
    """(detections with their entry, entries seen and not acquired yet, once each)."""
    resolved = lookup.mapped(lookup.resolve(entries, index, fuzzy)).select("item_id", F.col("id").alias("entry_id"), F.col("name").alias("entry_name"), "acquired")
    seen = detections.join(resolved, "item_id")
    return seen, seen.filter("not acquired").dropDuplicates(["entry_id"]).select("entry_id", "entry_name")


def sync(entries: DataFrame, names: list[str], index: DataFrame | None = None, least: int = 20) -> tuple[DataFrame, DataFrame]:
    """(merged list, summary); a list shorter than `least` is refused before anything changes."""
    if len(names) < least:
        raise ValueError(f"only {len(names)} names")
    merged = keeplist.merge_names(entries, names)
    kept = merged.filter("status <> 'removed'")
    return (kept if index is None else keeplist.backfill_ids(kept, index)), keeplist.summary(merged)


def reset(defaults: DataFrame, fetch: Callable[[], list[str]], index: DataFrame | None = None, least: int = 20) -> DataFrame:
    """The default list, synced with fresh names if they can be had; a failing fetch leaves the defaults."""
    try:
        return sync(defaults, fetch(), index, least)[0]
    except (OSError, ValueError):
        return defaults
