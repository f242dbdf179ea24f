"""The 32-bit string hash that names icon files, in 64-bit columns with masks, and its salts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from larch.functions.basics import col

#: Start, multiplier of the second half, and the salt of plain items.
START, SECOND, PLAIN_SALT = 5381, 1566083941, 0
OUTER = 17
_MASK = (1 << 32) - 1


def int32(c: Column | str) -> Column:
    """The low 32 bits as a signed number."""
    low = col(c).cast("long").bitwiseAND(F.lit(_MASK))
    return F.when(low >= 2**31, low - 2**32).otherwise(low)


def string_hash(text: Column | str) -> Column:
    """Two hashes h -> 33 h xor c, over even and odd places, joined as a + SECOND b; wrapped to int32.

    Characters are taken as UTF-16 units outside surrogates, that is by code point.
    """
    text = col(text)
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    state = F.struct(F.lit(START).cast("long").alias("a"), F.lit(START).cast("long").alias("b"), F.lit(0).alias("i"))

    def step(s: Column, c: Column) -> Column:
        turn = lambda h: (h * 33).bitwiseAND(F.lit(_MASK)).bitwiseXOR(F.ascii(c).cast("long"))
        even = s["i"] % 2 == 0
        return F.struct(F.when(even, turn(s["a"])).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise(turn(s["b"])).alias("b"), (s["i"] + 1).alias("i"))

    # a + b SECOND stays under 2^63, as both halves are 32 bits and SECOND is under 2^31.
    join = lambda s: int32(s["a"] + s["b"] * SECOND)
    return F.aggregate(chars, state, step, join)


def item_hash(item_id: Column | str, salt: int | Column = PLAIN_SALT) -> Column:
    salt = F.lit(salt) if isinstance(salt, int) else salt
    return int32(string_hash(item_id).bitwiseXOR(salt.cast("long")).bitwiseXOR(F.lit(OUTER).cast("long")))


def magazine_salt(rounds: Column | str) -> Column:
    return F.shiftleft(F.lit(23) + col(rounds).cast("int"), 2)


#: Hash providers by name: item id -> hash.
PROVIDERS: dict[str, Callable[[Column | str], Column]] = {"item": item_hash, "string": string_hash}
