"""Jobs that write: purchase orders and small edited tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder import schemas
from larder.functions.predicates import Moment
from larder.operators.mapping import mapping_sync
from larder.operators.merging import assign_ids
from larder.operators.purchasing import order_status_apply
from larder.operators.replenishment import purchase_order_build
from larder.operators.totals import add_totals, mapped_delta
from larder.session import staged
from larder.sources.tables import conform
from larder.sources.versions import RANGE, VersionedTables
from larder.streaming.order_ingest import ITEMS, ORDERS, TOTALS, item_range, item_ranges

HEADER, LINES = "purchase_order", "purchase_order_item"

# The column that deals a table's rows to ranges; other tables are kept as one range.
RANGE_KEYS = {HEADER: "id", LINES: "order_id", ORDERS: "platform_order_id"}


def save_purchase_order(
    tables: VersionedTables,
    worklist: DataFrame,
    period_days: int,
    notes: str,
    created_by: str,
    batch: int,
    as_of: Moment = None,
) -> int | None:
    """Stores a confirmed worklist as a draft order, header and lines together.

    Returns the order id, or None where there is nothing to save or a line is below
    its target. A batch that is stored already is not stored again; its order id is
    returned. Only the range of orders that the new one falls into is rewritten.
    """
    if tables.has_batch(batch):
        return tables.highest_in(HEADER, batch)
    order_id = tables.highest_id(HEADER) + 1
    built = staged(
        purchase_order_build(
            worklist, F.lit(order_id - 1), period_days, notes, created_by, as_of
        ),
        "purchase_order",
    )
    if built.isEmpty():
        return None
    key_range = order_id // tables.range_width % tables.range_count
    header = built.withColumn("id", F.col("order_id")).select(
        *[name for name in schemas.TABLES[HEADER].fieldNames()]
    ).distinct()
    content = [F.col(name) for name in built.columns]
    lines = assign_ids(
        built, F.lit(tables.highest_id(LINES)), *content,
        bucket=F.pmod(F.xxhash64(*content), F.lit(16)),
    ).drop("notes")
    states = {}
    for name, new in ((HEADER, header), (LINES, lines)):
        added = conform(new, name).withColumn(RANGE, F.lit(key_range).cast("bigint"))
        states[name] = tables.read(name, [key_range]).unionByName(added)
    tables.publish(states, batch)
    return order_id


def edit_table(
    tables: VersionedTables, name: str, change: Callable[[DataFrame], DataFrame], batch: int
) -> None:
    """Replaces a table by ``change`` of it, for example one of the merges.

    Rows stay in the ranges of their keys, and ranges left without rows are emptied.
    """
    if tables.has_batch(batch):
        return
    changed = conform(change(tables.read(name).drop(RANGE)), name)
    if name in RANGE_KEYS:
        changed = changed.withColumn(RANGE, tables.range_of(F.col(RANGE_KEYS[name])))
    tables.publish({name: changed}, batch, whole=[name])


def apply_order_status(tables: VersionedTables, requests: DataFrame, batch: int) -> None:
    """Stores status changes of purchase orders; rewrites only the ranges asked for."""
    if tables.has_batch(batch):
        return
    key_range = tables.range_of(F.col("order_id"))
    ranges = [row[0] for row in requests.select(key_range).distinct().collect()]
    stored = tables.read(HEADER, ranges)
    changed = conform(order_status_apply(stored.drop(RANGE), requests), HEADER)
    tables.publish({HEADER: changed.withColumn(RANGE, tables.range_of(F.col("id")))}, batch)


def sync_mapping(tables: VersionedTables, mapping: DataFrame, batch: int) -> int:
    """Fills missing local ids of stored items from the mapping; returns how many.

    Items without a local id are filed in ranges of their own, and only those are searched.
    Filled items move to the range of the others, and the totals of their orders follow, in
    the same commit; ranges in which nothing is filled are not opened again.
    """
    if tables.has_batch(batch):
        return 0
    missing = [number for number in tables.ranges(ITEMS) if number % 2]
    synced = mapping_sync(tables.read(ITEMS, missing), mapping)
    filled = {row[RANGE]: row["count"] for row in synced.where("filled").groupBy(RANGE).count().collect()}
    if not filled:
        return 0
    ranges = [number // 2 for number in filled]
    moved = staged(mapping_sync(tables.read(ITEMS, list(filled)), mapping), "synced")
    placed = moved.withColumn(RANGE, item_range(F.floor(F.col(RANGE) / 2), F.col("local_product_id")))
    stored = tables.read(ITEMS, item_ranges(ranges, missing=False))
    frames = {ITEMS: placed.drop("filled")}
    if TOTALS in tables.schemas:
        delta = mapped_delta(placed.where("filled").withColumn(RANGE, F.floor(F.col(RANGE) / 2)), RANGE)
        frames[TOTALS] = add_totals(tables.read(TOTALS, ranges), delta, RANGE)
    tables.publish(frames, batch, opened={ITEMS: item_ranges(ranges)}, kept={ITEMS: stored})
    return sum(filled.values())
