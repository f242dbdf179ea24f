"""What must not be sold: kept entries first, then items still short of their requirement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larch.functions.text import needed_reason

COLLECTOR = "collector"


def protected(kept: DataFrame, aggregate: DataFrame, collector: str = COLLECTOR) -> DataFrame:
    """item_id, reason, fir_only.

    kept: item_id, category_id, acquired (one row by item); aggregate: as of requirements.outstanding().
    An unacquired entry of the list decides before any requirement.  fir_only: a copy that was not found
    in raid may go; so for entries of the collector category, and where all that is needed is such.
    """
    a = kept.filter(~F.coalesce("acquired", F.lit(False))).select("item_id", F.lit("On keep list").alias("ra"), F.coalesce(F.col("category_id") == collector, F.lit(False)).alias("fa"))
    first = F.get("sources", F.lit(0))["name"]
    only = (F.col("fir_needed") >= F.col("total_needed")) & (F.col("total_needed") > 0)
    b = aggregate.filter("have < total_needed").select("item_id", needed_reason(first, "total_needed", F.size("sources")).alias("rb"), only.alias("fb"))
    return a.join(b, "item_id", "full").select("item_id", F.coalesce("ra", "rb").alias("reason"), F.when(F.col("ra").isNotNull(), F.col("fa")).otherwise(F.col("fb")).alias("fir_only"))


def verdicts(detections: DataFrame, items: DataFrame, protected_items: DataFrame) -> DataFrame:
    """Detections of known items with keep (boolean) and reason.

    Only a copy that surely was not found in raid (fir is false, not null) loses a fir_only protection.
    """
    rows = detections.join(items, "item_id")
    rows = rows.join(protected_items.select(F.col("item_id").alias("_p"), F.col("reason").alias("keep_reason"), "fir_only"), F.col("item_id") == F.col("_p"), "left")
    free = F.col("fir_only") & F.col("fir").eqNullSafe(F.lit(False))
    return rows.withColumn("keep", F.col("_p").isNotNull() & ~F.coalesce(free, F.lit(False))).drop("_p", "fir_only")
