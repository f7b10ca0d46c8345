"""Set-based merges: each takes a table and a batch of changes and returns the new state.

A merge never shuffles the stored table for a small batch: stored rows are
left-joined with the changes, and new rows are the changes whose key is not stored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

INSERTED, UPDATED, SKIPPED, UNCHANGED = "inserted", "updated", "skipped", "unchanged"

ID_BUCKETS = 1009


def known_keys(target: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The changed keys that are already stored; the result is at most the batch."""
    return target.select(*keys).join(changes.select(*keys), list(keys), "left_semi")


def unknown_rows(target: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The changes whose key is not stored yet."""
    return changes.join(known_keys(target, changes, keys), list(keys), "left_anti")


def merge_by_key(
    target: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    update: Mapping[str, Column],
    new_rows: DataFrame | None = None,
) -> DataFrame:
    """Stored rows with a change take ``update``; ``new_rows`` are added.

    ``changes`` has one row per key (see ``last_per_key``). In ``update`` the stored row
    is ``t`` and the change is ``c``. A column that ``new_rows`` lacks becomes NULL. The result has
    the target's columns and ``action``.
    """
    marked = changes.withColumn("_changed", F.lit(True)).alias("c")
    same_key = [F.col(f"t.{key}") == F.col(f"c.{key}") for key in keys]
    changed = F.col("c._changed").isNotNull()

    def after(name: str) -> Column:
        stored = F.col(f"t.{name}")
        if name not in update:
            return stored.alias(name)
        kind = target.schema[name].dataType
        return F.when(changed, update[name].cast(kind)).otherwise(stored).alias(name)

    state = target.alias("t").join(marked, same_key, "left").select(
        *[after(name) for name in target.columns],
        F.when(changed, UPDATED).otherwise(UNCHANGED).alias("action"),
    )
    if new_rows is None:
        return state
    return state.unionByName(as_inserted(new_rows, target))


def as_inserted(new_rows: DataFrame, target: DataFrame) -> DataFrame:
    """New rows in the target's columns and types, with ``action``."""
    return new_rows.select(
        *[
            (F.col(field.name) if field.name in new_rows.columns else F.lit(None))
            .cast(field.dataType)
            .alias(field.name)
            for field in target.schema.fields
        ],
        F.lit(INSERTED).alias("action"),
    )


def highest_id(table: DataFrame) -> Column:
    """The largest id of a table as a scalar subquery, 0 for an empty table."""
    return table.select(F.coalesce(F.max("id"), F.lit(0)).cast("bigint").alias("id")).scalar()


def assign_ids(
    rows: DataFrame, after: Column, *keys: Column, bucket: Column | None = None
) -> DataFrame:
    """Numbers rows ``after + 1, after + 2, ...`` without gaps and without a global sort.

    Rows are numbered inside ``ID_BUCKETS`` buckets of their unique key and the
    buckets are laid end to end: only the bucket sizes, never the rows, meet in one
    task. The same rows get the same ids whenever the plan runs again.
    """
    if bucket is None:
        bucket = F.pmod(keys[0], F.lit(ID_BUCKETS))
    placed = rows.withColumn("_bucket", bucket)
    sizes = placed.groupBy("_bucket").agg(F.count("*").alias("_size"))
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(
        "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start")
    )
    within = F.row_number().over(W.partitionBy("_bucket").orderBy(*keys))
    numbered = placed.withColumn("_place", within).join(starts, "_bucket")
    return numbered.withColumn(
        "id", (after + F.col("_start") + F.col("_place")).cast("bigint")
    ).drop("_bucket", "_place", "_start")


def last_per_key(
    changes: DataFrame, keys: Sequence[str], arrival: str | None = None
) -> DataFrame:
    """One change per key, the one that arrived last; combines before the shuffle.

    Without ``arrival``, and among changes that arrived together, the largest values win.
    """
    others = F.struct(*[name for name in changes.columns if name not in keys])
    order = F.struct(F.col(arrival), others) if arrival else others
    return changes.groupBy(*keys).agg(F.max_by(others, order).alias("_row")).select(
        *keys, "_row.*"
    )
