"""Offers in long form: the best one by item in one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def best_offers(offers: DataFrame, item: str, vendor: str, price: str, order: list[str], excluded: Column | None = None) -> DataFrame:
    """item, trader_name, trader_price: the highest price above 0, the first in `order` on ties.

    A maximum of a struct, so partial aggregates shrink the rows before the shuffle and a hot item is no matter.
    """
    rows = offers.filter(F.col(price) > 0)
    rows = rows if excluded is None else rows.filter(~excluded)
    best = F.max(F.struct(F.col(price).alias("p"), *[(-F.col(o)).alias(f"o{i}") for i, o in enumerate(order)], F.col(vendor).alias("v")))
    return rows.groupBy(item).agg(best.alias("m")).select(item, F.col("m.v").alias("trader_name"), F.col("m.p").cast("long").alias("trader_price"))
