"""Bit functions on BIGINT columns that hold values from 0 to 2**62."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def msb(x: Column) -> Column:
    """Place of the highest bit set; -1 for 0."""
    return F.when(x == 0, F.lit(-1)).otherwise(F.length(F.bin(x)) - 1)


def lowbit(x: Column) -> Column:
    """The lowest bit set, as a number."""
    return x.bitwiseAND(-x)


def shl(x: Column, by: Column) -> Column:
    return F.call_function("shiftleft", x, by.cast("int"))


def shr(x: Column, by: Column) -> Column:
    return F.call_function("shiftright", x, by.cast("int"))


def clear_below(x: Column, bit: Column) -> Column:
    """x with the bits below place `bit` cleared."""
    return shl(shr(x, bit), bit)
