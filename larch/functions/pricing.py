"""Market pricing: listing fee, list price, best offer and recommendation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larch.functions.basics import col, or_else

#: Fee rate and base of the market's formula, the price ending, and the least profit.
FEE_RATE, FEE_BASE = 0.03, 4.0
ENDING, THOUSAND = 420, 1000
MIN_PROFIT = 10_000
EXCLUDED_VENDOR = "flea market"


def listing_fee(base: Column | str, price: Column | str) -> Column:
    """round(r b 4^log10(b / p) + r p 4^log10(p / b)), half to even; 0 if either is 0 or null."""
    b, p = col(base).cast("double"), col(price).cast("double")
    none = b.isNull() | p.isNull() | (b == 0) | (p == 0)
    # Guarded denominators: the branch not taken must not divide by zero.
    b1, p1 = F.when(none, 1.0).otherwise(b), F.when(none, 1.0).otherwise(p)
    power = lambda x, y: F.pow(F.lit(FEE_BASE), F.log10(x / y))
    return F.when(none, F.lit(0)).otherwise(F.bround(b1 * FEE_RATE * power(b1, p1) + p1 * FEE_RATE * power(p1, b1))).cast("long")


def list_price(target: Column | str) -> Column:
    """The largest price up to target that ends in 420; below that one less than target, 1 at least."""
    t = col(target).cast("long")
    return F.when(t <= ENDING, F.greatest(F.lit(1), t - 1)).otherwise(t - F.pmod(t - ENDING, F.lit(THOUSAND))).cast("long")


def best_offer(offers: Column | str) -> Column:
    """struct(name, price): the highest offer (array of struct<vendor:struct<name>, priceRUB>), first on ties.

    The excluded market doesn't count, nor do offers of 0; without any, (null, 0).
    """
    none = F.struct(F.lit(None).cast("string").alias("name"), F.lit(0).cast("long").alias("price"))

    def better(best: Column, offer: Column) -> Column:
        price = F.coalesce(offer["priceRUB"].cast("long"), F.lit(0).cast("long"))
        name = F.coalesce(offer["vendor"]["name"], F.lit(""))
        wins = (F.lower(name) != EXCLUDED_VENDOR) & (price > best["price"])
        return F.when(wins, F.struct(name.alias("name"), price.alias("price"))).otherwise(best)

    return F.aggregate(F.coalesce(col(offers), F.array().cast("array<struct<vendor:struct<name:string>,priceRUB:bigint>>")), none, better)


def recommendation(base: Column | str, low: Column | str, average: Column | str, name: Column | str, price: Column | str) -> Column:
    """struct(trader_name, trader_price, flea_list, flea_net, recommend, reason)."""
    market = or_else(low, or_else(average, F.lit(0))).cast("long")
    price = F.coalesce(col(price).cast("long"), F.lit(0).cast("long"))
    listed = list_price(market)
    net = listed - listing_fee(base, listed)
    known, gain = (market != 0) & (price != 0), net - price
    go = known & (gain >= MIN_PROFIT)
    comma = lambda c: F.format_number(c, 0)
    reason = (
        F.when(market == 0, "No flea data")
        .when(price == 0, "No trader data")
        .when(go, F.concat(F.lit("+"), comma(gain), F.lit(" over trader after fees")))
        .otherwise(F.concat(F.lit("Flea net "), comma(net), F.lit(f" not {MIN_PROFIT // 1000}k+ above trader")))
    )
    return F.struct(
        col(name).alias("trader_name"), price.alias("trader_price"), F.when(known, listed).alias("flea_list"), F.when(known, net).alias("flea_net"),
        F.when(go, "flea").otherwise("trader").alias("recommend"), reason.alias("reason"),
    )
