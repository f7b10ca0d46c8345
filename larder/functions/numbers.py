"""Number parsing and guarded arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, NULL where the divisor is zero (ANSI mode would raise)."""
    return part / F.nullif(whole, F.lit(0))


def parse_decimal(text: Column, precision: int, scale: int) -> Column:
    """Text with a decimal comma or point as a decimal; NULL if it is no number."""
    return F.translate(text, ",", ".").try_cast(f"decimal({precision},{scale})")


def at_least_zero(value: Column) -> Column:
    return F.greatest(value, F.lit(0))
