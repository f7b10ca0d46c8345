"""Sort keys with the relational default: NULL counts as the largest value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def asc(name: str) -> Column:
    return F.col(name).asc_nulls_last()


def desc(name: str) -> Column:
    return F.col(name).desc_nulls_first()
