"""String similarities from 0 to 100 by published definitions, vectorised over Arrow batches.

indel(a, b) = 100 (1 - d / (|a| + |b|)) with d the insertions and deletions between a and b, that is
200 LCS / (|a| + |b|).  weighted_ratio weighs the plain ratio against token and partial ratios; the
weights follow the published description, and callers may pass another similarity instead.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return (full ^ row).bit_count()


def indel(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 200.0 * lcs(a, b) / total if total else 100.0


def plain(text: str) -> str:
    """Lower case, everything but letters and digits to spaces, trimmed."""
    return re.sub(r"[\W_]", " ", text).lower().strip()


def token_sort(a: str, b: str) -> float:
    return indel(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    """100 if one token set holds the other; else the best ratio of the common tokens with either rest."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = (" ".join(filter(None, (both, " ".join(sorted(rest))))) for rest in (x - y, y - x))
    if both and (not x - y or not y - x):
        return 100.0
    return max([indel(left, right), *([indel(both, left), indel(both, right)] if both else [])])


def partial(a: str, b: str) -> float:
    """Best ratio of the shorter with any stretch of the longer of that length (or less, at its ends)."""
    short, long_ = sorted((a, b), key=len)
    if not short:
        return 0.0
    n = len(short)
    return max(indel(short, long_[max(0, i) : i + n]) for i in range(1 - n, len(long_)))


def weighted(a: str, b: str) -> float:
    """The largest of the ratio, 0.95 of the token ratios, and for unequal lengths 0.9 (0.6) of partial ones."""
    if not a or not b:
        return 0.0
    scale = max(len(a), len(b)) / min(len(a), len(b))
    tokens = max(token_sort(a, b), token_set(a, b)) * 0.95
    if scale < 1.5:
        return max(indel(a, b), tokens)
    weight = 0.9 if scale <= 8 else 0.6
    inner = max(partial(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), 100.0 if set(a.split()) & set(b.split()) else 0.0)
    return max(indel(a, b), partial(a, b) * weight, inner * 0.95 * weight)


def _column(rule):
    @pandas_udf("double")
    def udf(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else rule(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return udf


def indel_ratio(a: Column, b: Column) -> Column:
    return _column(indel)(a, b)


def weighted_ratio(a: Column, b: Column) -> Column:
    return _column(weighted)(a, b)


def token_set_ratio(a: Column, b: Column) -> Column:
    return _column(lambda x, y: token_set(plain(x), plain(y)))(a, b)
