"""Stored purchase orders: overview, items and status changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions import asc

# The purchase-order states and the steps allowed between them.
DRAFT, CONFIRMED, SENT, RECEIVED = "RASCUNHO", "CONFIRMADO", "ENVIADO", "RECEBIDO"
STATES = (DRAFT, CONFIRMED, SENT, RECEIVED)
TRANSITIONS = (
    (DRAFT, CONFIRMED),
    (CONFIRMED, SENT),
    (CONFIRMED, DRAFT),
    (SENT, RECEIVED),
    (SENT, CONFIRMED),
)


def purchase_orders_summary(
    orders: DataFrame, items: DataFrame, status: str | None = None
) -> DataFrame:
    """Orders with their item count and confirmed quantity, optionally of one status."""
    if status:
        orders = orders.where(F.col("status") == status)
    per_order = items.groupBy(F.col("order_id").alias("id")).agg(
        F.count("id").alias("total_items"), F.sum("confirmed_qty").alias("total_qty")
    )
    none = F.lit(0).cast("bigint")
    return orders.join(per_order, "id", "left").select(
        "id", "order_date", "status", "period_days", "notes", "created_by",
        F.coalesce("total_items", none).alias("total_items"),
        F.coalesce("total_qty", none).alias("total_qty"),
    )


def purchase_order_metrics(summary: DataFrame) -> DataFrame:
    """Orders, items and confirmed units in all."""
    return summary.agg(
        F.count("*").alias("orders"),
        F.coalesce(F.sum("total_items"), F.lit(0)).alias("items"),
        F.coalesce(F.sum("total_qty"), F.lit(0)).alias("units"),
    )


def purchase_order_items(
    items: DataFrame, product: DataFrame, order_id: int | None = None
) -> DataFrame:
    """Items with their product name, of all orders, or sorted of one."""
    if order_id is not None:
        items = items.where(F.col("order_id") == order_id)
    names = product.select(
        F.col("id").alias("product"), F.col("description").alias("product_desc"), "product_type"
    )
    rows = items.join(names, "product").select(
        "order_id", "product_desc", "product_type", "current_stock", "min_qty", "target_qty",
        "avg_daily_consumption", "suggested_qty", "confirmed_qty", "supplier_available",
        "supplier_price", "notes",
    )
    if order_id is None:
        return rows
    return rows.orderBy(F.col("confirmed_qty").desc_nulls_last(), asc("product_desc"))


def _allowed_from(new_status: str) -> list[str]:
    return [before for before, after in TRANSITIONS if after == new_status]


def order_status_apply(
    orders: DataFrame, requests: DataFrame, arrival: str | None = None
) -> DataFrame:
    """The orders after a batch of status requests, with ``status_changed``.

    Each request is judged against the stored status, as the person asking saw it.
    Where several are allowed for one order the last by ``arrival`` stands. Requests
    are reduced to one row per order, with the last arrival per status asked for, so
    the orders are joined once.
    """
    order = F.col(arrival) if arrival else F.lit(0)
    asked = requests.groupBy(F.col("order_id").alias("id")).agg(
        *[F.max(F.when(F.col("new_status") == s, order)).alias(f"ask_{s}") for s in STATES]
    )
    granted = F.array_max(
        F.array(
            *[
                F.when(
                    F.col(f"ask_{s}").isNotNull() & F.col("status").isin(_allowed_from(s)),
                    F.struct(F.col(f"ask_{s}").alias("at"), F.lit(s).alias("status")),
                )
                for s in STATES
            ]
        )
    )["status"]
    judged = orders.join(asked, "id", "left").withColumn("_granted", granted)
    return judged.select(
        *[
            F.coalesce("_granted", "status").alias("status") if name == "status" else F.col(name)
            for name in orders.columns
        ],
        F.col("_granted").isNotNull().alias("status_changed"),
    )


def order_status_rejected(orders: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests that ask for a step not allowed from the stored status."""
    current = orders.select(F.col("id").alias("order_id"), F.col("status").alias("from_status"))
    step = F.struct("from_status", "new_status")
    legal = step.isin([F.struct(F.lit(a), F.lit(b)) for a, b in TRANSITIONS])
    return (
        requests.join(current, "order_id", "left")
        .where(~F.coalesce(legal, F.lit(False)))
        .select("order_id", "from_status", "new_status")
    )
