"""Names, codes and bit fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOD_PATTERN = r"^[0-9]{10}\.[0-9]{10}\.ar.$"


def basename(path: Column) -> Column:
    """Last part of a path without a final ``.zip``."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.zip$", "")


def is_tod_id(name: Column) -> Column:
    return name.rlike(TOD_PATTERN)


def array_of(name: Column) -> Column:
    """Array code of a name: its third dotted part, ``ar1`` if there is none."""
    part = F.try_element_at(F.split(name, r"\."), F.lit(3))
    return F.coalesce(F.when(part != "", part), F.lit("ar1"))


def frequency_of(text: Column) -> Column:
    """``fNNN`` code in a text, null if there is none."""
    m = F.regexp_extract(text, r"f(\d{3})", 0)
    return F.when(m != "", m)


def bit_field(word: Column, start: int, count: int, signed: bool = True, scale: float = 1.0) -> Column:
    """``count`` bits of a 32-bit word from bit ``start`` on, times ``scale``."""
    up = F.shiftleft(word.cast("int"), 32 - start - count)
    value = F.shiftright(up, 32 - count) if signed else F.shiftrightunsigned(up, 32 - count)
    return value * F.lit(scale) if scale != 1.0 else value


def mode10_signal(word: Column) -> Column:
    """Signal of a data mode 10 word: 25 bits from bit 7, times 8."""
    return F.shiftright(word.cast("int"), 7) * 8


def explode_bits(bits: Column, n_bytes: int) -> Column:
    """Array of bytes with the given bits set; bit i is bit i % 8 of byte i div 8."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(n_bytes - 1)),
        lambda k: F.aggregate(F.filter(bits, lambda b: F.floor(b / 8) == k), F.lit(0), lambda acc, b: acc.bitwiseOR(F.expr("1") * F.pow(F.lit(2), b % 8).cast("int"))),
    )
