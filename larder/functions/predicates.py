"""Filters used by several operators."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Moment = datetime | str | None


def moment(as_of: Moment) -> Column:
    """The reference time of a report; the start of the query when not given."""
    if as_of is None:
        return F.localtimestamp()
    return F.lit(str(as_of)).cast("timestamp_ntz")


def trailing_window(ts: Column, days: int, as_of: Moment) -> Column:
    """The last ``days`` days up to ``as_of``, open towards later times.

    Both operands of the bound fold to one literal, so the comparison reaches the scan.
    """
    return ts >= moment(as_of) - F.make_dt_interval(F.lit(days))


def within_dates(ts: Column, start: date | str, end: date | str) -> Column:
    """Calendar days ``start`` to ``end`` inclusive, as a half-open range for pushdown."""
    first, last = date.fromisoformat(str(start)), date.fromisoformat(str(end))
    if first > last:
        raise ValueError(f"start date {first} is after end date {last}")
    return (ts >= moment(f"{first} 00:00:00")) & (
        ts < moment(f"{last + timedelta(days=1)} 00:00:00")
    )


def contains_text(text: Column, pattern: str | None) -> Column:
    """Case-insensitive regular-expression search; an empty pattern keeps every row."""
    if not pattern:
        return F.lit(True)
    return F.coalesce(text.rlike(f"(?iu){pattern}"), F.lit(False))


def number_starts_with(number: Column, prefix: str | None) -> Column:
    """Prefix test on the digits of a number; NULL and 0 have none."""
    prefix = (prefix or "").strip()
    if not prefix:
        return F.lit(True)
    digits = F.when(number != 0, number.cast("string"))
    return F.coalesce(digits.startswith(prefix), F.lit(False))


def without_excluded(df: DataFrame, key: str, exclude: DataFrame) -> DataFrame:
    """Drops rows of products marked as excluded, and rows without a product."""
    banned = exclude.select(F.col("product_id").alias(key))
    return df.where(F.col(key).isNotNull()).join(banned, key, "left_anti")
