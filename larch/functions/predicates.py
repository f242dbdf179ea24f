"""Row predicates and small lookups of the catalogue."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larch.functions.basics import col, or_else, or_empty

#: Types that are never matched, cell tints (BGR) by colour, badge colours (RGB) by trader.
EXCLUDED_TYPES = ("ammo", "ammoBox", "gun", "preset", "container")
TINTS = {"black": (20, 19, 19), "grey": (30, 29, 28), "default": (54, 54, 53), "blue": (45, 39, 29), "violet": (41, 29, 38), "yellow": (33, 48, 47), "green": (24, 34, 27), "orange": (24, 30, 37), "red": (29, 32, 49)}
DEFAULT_BADGE = (180, 120, 20)


def is_target(types: Column | str, excluded: tuple[str, ...] = EXCLUDED_TYPES) -> Column:
    """No type is excluded; an item without types is a target."""
    return ~F.arrays_overlap(or_empty(types, "string"), F.array(*[F.lit(t) for t in excluded]))


def _colours(colours: dict[str, tuple[int, int, int]]) -> Column:
    return F.create_map(*[x for k, v in colours.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in v]))])


def tint_of(colour: Column | str) -> Column:
    """The cell tint of a background colour; unknown, empty and null ones count as the default."""
    known = _colours(TINTS)
    return F.coalesce(F.try_element_at(known, or_else(colour, F.lit("default"))), F.array(*[F.lit(c) for c in TINTS["default"]]))


def badge_of(trader: Column | str, colours: dict[str, tuple[int, int, int]], default: tuple[int, int, int] = DEFAULT_BADGE) -> Column:
    return F.coalesce(F.try_element_at(_colours(colours), col(trader)), F.array(*[F.lit(c) for c in default]))


def is_active(completed: Column | str, required: Column | str, required_only: bool) -> Column:
    return ~F.coalesce(col(completed), F.lit(False)) & (F.lit(not required_only) | F.coalesce(col(required), F.lit(False)))


def footprints(w: Column | str, h: Column | str) -> Column:
    """Both ways a footprint can lie, one for squares."""
    side = lambda a, b: F.struct(col(a).alias("w"), col(b).alias("h"))
    return F.array_distinct(F.array(side(w, h), side(h, w)))


def names_of(short: Column | str, name: Column | str) -> Column:
    """The distinct names an item goes by, without empty ones."""
    return F.filter(F.array_distinct(F.array(col(short), col(name))), lambda x: x.isNotNull() & (x != ""))
