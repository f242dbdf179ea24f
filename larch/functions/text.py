"""Text clean-up, tokens and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larch.functions.basics import col, round_half_up


def tokens(text: Column | str) -> Column:
    return F.filter(F.split(F.lower(col(text)), "[^A-Za-z0-9]+"), lambda t: t != "")


def tokens_contained(read: Column | str, reference: Column | str) -> Column:
    """Every token read (of two characters or more, and there is one) begins some token of the reference."""
    have = tokens(reference)
    long_ones = F.filter(tokens(read), lambda t: F.length(t) >= 2)
    return F.coalesce((F.size(long_ones) > 0) & F.forall(long_ones, lambda t: F.exists(have, lambda r: F.startswith(r, t))), F.lit(False))


def clean_label(text: Column | str) -> Column:
    """One line, trimmed, from the first letter, digit or # on."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(col(text), r"^\s+|\s+$", "")), "\n", " "), r"^[^\p{L}\p{N}#]+", "")


def one_space(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(text), r"\s+", " "))


def first_integer(text: Column | str) -> Column:
    return F.regexp_extract(col(text), r"(\d+)", 1).try_cast("bigint")


def field_like(fields: Column | str, key: str) -> Column:
    """The first value of a map whose key contains `key`, by entry order; null if none."""
    return F.get(F.filter(F.map_entries(col(fields)), lambda e: F.contains(F.lower(e["key"]), F.lit(key.lower()))), F.lit(0))["value"]


def needed_reason(first: Column | str, total: Column | str, sources: Column | str) -> Column:
    """Needed: first (×total), and how many more sources."""
    more = F.greatest(F.lit(0), col(sources).cast("int") - 1)
    return F.concat(F.lit("Needed: "), F.coalesce(col(first), F.lit("tasks")), F.lit(" (×"), col(total).cast("string"), F.lit(")"), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"), F.lit(" more"))).otherwise(""))


def percent_done(have: Column | str, need: Column | str) -> Column:
    """min(100, have of need in percent), halves up; 0 if nothing is needed."""
    need = col(need)
    return F.when(need == 0, 0).otherwise(F.least(F.lit(100), round_half_up(col(have) * 100.0 / F.when(need == 0, 1).otherwise(need)))).cast("long")


def age_label(minutes: Column | str) -> Column:
    m = col(minutes)
    return F.when(m < 60, F.concat(round_half_up(m).cast("long").cast("string"), F.lit("m"))).otherwise(F.concat(round_half_up(m / 60.0).cast("long").cast("string"), F.lit("h")))


def item_list(items: Column | str) -> Column:
    """count× name (FIR), joined by a middle dot, for array<struct<count,name,fir>>."""
    return F.array_join(F.transform(col(items), lambda i: F.concat(i["count"].cast("string"), F.lit("× "), i["name"], F.when(i["fir"], " (FIR)").otherwise(""))), " · ")


def is_on(value: Column | str) -> Column:
    """A query parameter counts as on unless it is 0, false or False."""
    return ~col(value).isin("0", "false", "False")
