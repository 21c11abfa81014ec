"""Bits of flags as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import REASON_CHANGED, REASON_FORCED, REASON_MISSING


def has_flags(c: Column, bits: int) -> Column:
    """All of the bits."""
    return c.bitwiseAND(F.lit(bits)) == bits


def add_flags(c: Column, bits: int) -> Column:
    return c.bitwiseOR(F.lit(bits))


def remove_flags(c: Column, bits: int) -> Column:
    return c.bitwiseAND(F.bitwise_not(F.lit(bits)))


def set_flags(c: Column, bits: int, on: bool) -> Column:
    return add_flags(c, bits) if on else remove_flags(c, bits)


def reason_string(c: Column) -> Column:
    """Three characters, F, M and C or blanks."""
    return F.concat(*[F.when(has_flags(c, b), x).otherwise(" ") for b, x in ((REASON_FORCED, "F"), (REASON_MISSING, "M"), (REASON_CHANGED, "C"))])
