"""What changed between two states of a table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.sources.versions import RANGE, VersionedTables

INSERTED, CHANGED, DELETED = "inserted", "changed", "deleted"


def changed_rows(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, change, fields, before, after) of rows that differ between two states.

    Keys identify a row; null keys are equal. ``fields`` names the columns that differ, null
    counting as a value; ``before`` and ``after`` are the other columns as structs, null for a
    row that is not there. Equal rows are left out by their hash before anything is compared.
    Both sides are shuffled by key once; a key that repeats is compared with all its rows.
    """
    names = [name for name in after.columns if name not in keys]
    kinds = {name: after.schema[name].dataType for name in after.columns}
    if sorted(before.columns) != sorted(after.columns):
        raise ValueError("the two states have different columns")

    def side(df: DataFrame, name: str) -> DataFrame:
        columns = [F.col(c).cast(kinds[c]).alias(c) for c in names]
        packed = F.struct(*columns)
        return df.select(*[F.col(k).cast(kinds[k]).alias(k) for k in keys], packed.alias("row"), F.xxhash64(packed).alias("hash")).alias(name)

    b, a = side(before, "b"), side(after, "a")
    same = reduce(lambda x, y: x & y, [F.col(f"b.{k}").eqNullSafe(F.col(f"a.{k}")) for k in keys])
    joined = b.join(a, same, "full_outer")
    differs = ~F.col("b.hash").eqNullSafe(F.col("a.hash"))
    change = F.when(F.col("b.hash").isNull(), INSERTED).when(F.col("a.hash").isNull(), DELETED).otherwise(CHANGED)
    fields = F.filter(
        F.array(
            *[
                F.when(~F.col(f"b.row.{name}").eqNullSafe(F.col(f"a.row.{name}")), F.lit(name))
                for name in names
            ]
        ),
        lambda name: name.isNotNull(),
    )
    return joined.where(differs).select(
        *[F.coalesce(f"b.{k}", f"a.{k}").alias(k) for k in keys],
        change.alias("change"),
        fields.alias("fields"),
        F.col("b.row").alias("before"),
        F.col("a.row").alias("after"),
    )


def field_changes(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per changed field: (keys, change, field, old, new), values as text."""
    names = changes.schema["before"].dataType.fieldNames()

    def text(side: str, name: str) -> Column:
        return F.col(f"{side}.{name}").cast("string")

    each = F.array(
        *[
            F.struct(F.lit(name).alias("field"), text("before", name).alias("old"), text("after", name).alias("new"))
            for name in names
        ]
    )
    wanted = F.filter(each, lambda e: F.array_contains("fields", e["field"]))
    return changes.select(*keys, "change", F.inline(wanted))


def changes_between(
    tables: VersionedTables, name: str, older: int, newer: int, keys: Sequence[str]
) -> DataFrame:
    """``changed_rows`` of two versions of a stored table; opens only ranges written in between.

    A row keeps its range as long as the range follows from the keys.
    """
    touched = tables.ranges_written(name, older, newer)
    states = [tables.read(name, touched, version).drop(RANGE) for version in (older, newer)]
    return changed_rows(*states, keys)
