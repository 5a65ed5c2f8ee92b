"""Numbers with one missing marker: null. NaN and infinities become null wherever a result leaves an operator."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

INFINITY = float("inf")


def is_finite(x: Column) -> Column:
    """False for null too."""
    return F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < INFINITY), F.lit(False))


def finite(x: Column) -> Column:
    """``x`` where it is finite, else null."""
    return F.when(is_finite(x), x)


def ratio(numerator: Column, denominator: Column, minimum: float = 0.0) -> Column:
    """Quotient where both are finite and |denominator| > minimum, else null."""
    good = is_finite(numerator) & is_finite(denominator) & (F.abs(denominator) > minimum)
    return F.when(good, F.try_divide(numerator, denominator))


def half_up(x: Column) -> Column:
    """The nearest integer, halves upwards (cells and bins)."""
    return F.floor(x + 0.5)


def flag_bits(*conditions: tuple[int, Column]) -> Column:
    """Bitwise or of the bits whose condition holds; a null condition doesn't."""
    bits = F.lit(0)
    for bit, condition in conditions:
        bits = bits.bitwiseOR(F.when(condition, bit).otherwise(0))
    return bits
