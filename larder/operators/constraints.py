"""Checks for what files do not enforce: unique keys, required values, references."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _result(found: DataFrame, table: str, rule: str, count: Column) -> DataFrame:
    return found.agg(F.coalesce(count, F.lit(0)).cast("bigint").alias("violations")).select(
        F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), "violations"
    )


def unique_violations(df: DataFrame, table: str, keys: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each key; rows with a NULL in the key do not count."""
    groups = df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("n"))
    return _result(groups, table, f"unique {','.join(keys)}", F.sum(F.col("n") - 1))


def required_violations(df: DataFrame, table: str, column: str) -> DataFrame:
    """Rows without a value."""
    return _result(df, table, f"required {column}", F.count_if(F.col(column).isNull()))


def reference_violations(
    df: DataFrame, table: str, column: str, parent: DataFrame, parent_column: str = "id"
) -> DataFrame:
    """Rows whose value is missing in the parent table, counted per value before the join."""
    used = df.groupBy(column).agg(F.count("*").alias("n")).where(F.col(column).isNotNull())
    parents = parent.select(F.col(parent_column).alias(column))
    orphans = used.join(parents, column, "left_anti")
    return _result(orphans, table, f"reference {column}", F.sum("n"))
