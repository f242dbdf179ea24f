"""Dotted version numbers as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larch.functions.basics import col


def version(text: Column | str) -> Column:
    """array<bigint> of the leading dotted numbers after an optional v; null if there are none."""
    found = F.regexp_extract(F.trim(col(text)), r"^[vV]?(\d+(?:\.\d+)*)", 1)
    return F.when(found != "", F.transform(F.split(found, r"\."), lambda x: x.cast("bigint")))


def is_newer(latest: Column | str, current: Column | str) -> Column:
    """Compares number by number, missing ones as 0; false if either can't be read."""
    a, b = version(latest), version(current)
    length = F.greatest(F.size(a), F.size(b))
    pad = lambda v: F.concat(v, F.array_repeat(F.lit(0).cast("bigint"), F.greatest(F.lit(0), length - F.size(v))))
    return F.coalesce(F.when(a.isNotNull() & b.isNotNull(), pad(a) > pad(b)), F.lit(False))
