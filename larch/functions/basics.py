"""Small column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def or_else(c: Column | str, default: Column) -> Column:
    """The value, or the default where it is null, zero or empty: these three count as missing alike."""
    c = col(c)
    return F.when(c.isNull() | c.cast("string").isin("", "0", "0.0"), default).otherwise(c)


def or_empty(c: Column | str, kind: str) -> Column:
    """An array, or the empty array of the given element type for null."""
    return F.coalesce(col(c), F.array().cast(f"array<{kind}>"))


def round_even(c: Column, digits: int = 0) -> Column:
    """Half to even; to digits decimal places on the decimal value."""
    return F.bround(c, digits)


def round_half_up(c: Column) -> Column:
    """Halves go up, towards positive infinity."""
    return F.floor(c + 0.5)


def clamp(c: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, c))
