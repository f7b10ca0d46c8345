"""Reorder suggestions and the order worklist made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions import at_least_zero, moment, ratio, trailing_window, without_excluded
from larder.functions.predicates import Moment
from larder.operators.consumption import consumed_per_product
from larder.operators.merging import last_per_key
from larder.operators.products import ACTIVE
from larder.operators.stock import stock_per_product

# Fixed value: the platform average always looks at this many days.
PLATFORM_DAYS = 30


def platform_average(
    supplier_items: DataFrame, mapping: DataFrame, as_of: Moment
) -> DataFrame:
    """Mean quantity per order that contains the product, by mapped local product.

    The distinct count of orders runs as a two-step aggregate over product and order,
    so no product meets in one task.
    """
    recent = supplier_items.where(
        trailing_window(F.col("created_at"), PLATFORM_DAYS, as_of)
    ).select("external_product_id", "order_id", "quantity")
    local = mapping.where(F.col("local_product_id").isNotNull()).select(
        "external_product_id", "local_product_id"
    )
    orders = F.count_distinct("order_id").cast("decimal(20,0)")
    return (
        recent.join(local, "external_product_id")
        .groupBy("local_product_id")
        .agg(F.round(ratio(F.sum("quantity"), orders), 2).alias("avg_platform_30d"))
    )


def order_suggestions(
    product: DataFrame,
    positions: DataFrame,
    status: DataFrame,
    history: DataFrame,
    exclude: DataFrame,
    stock_minimum: DataFrame,
    mapping: DataFrame,
    supplier_items: DataFrame,
    days: int = 30,
    include_no_position: bool = False,
    as_of: Moment = None,
    platform_as_of: Moment = None,
) -> DataFrame:
    """What to reorder: one row per product and external name mapped to it.

    Only closed boxes count as stock. A product is ordered when they are at or below
    the minimum, or below the consumption projected for ``days``; the quantity then
    reaches the target and the projection. The projection multiplies the *rounded*
    daily average, in decimal, and is rounded up.
    """
    candidates = without_excluded(
        product.where(F.col("status") == ACTIVE).select("id", "description", "product_type"),
        "id",
        exclude,
    )
    stock = stock_per_product(positions, status).withColumnRenamed("product", "id")
    if not include_no_position:
        candidates = candidates.join(stock, "id")
    else:
        candidates = candidates.join(stock, "id", "left")
    used = consumed_per_product(history, exclude, days, as_of).withColumnRenamed("product", "id")
    minimum = stock_minimum.select(F.col("product").alias("id"), "min_qty", "target_qty")
    names = mapping.where(F.col("local_product_id").isNotNull()).select(
        F.col("local_product_id").alias("id"), "external_name"
    )
    average = platform_average(
        supplier_items, mapping, as_of if platform_as_of is None else platform_as_of
    ).withColumnRenamed("local_product_id", "id")

    def known(name: str, kind: str):
        return F.coalesce(F.col(name), F.lit(0).cast(kind)).alias(name)

    facts = (
        candidates.join(used, "id", "left")
        .join(minimum, "id", "left")
        .join(average, "id", "left")
        .join(names, "id", "left")
        .select(
            "id",
            F.coalesce("external_name", "description").alias("product_desc"),
            F.col("description").alias("local_desc"),
            "product_type",
            known("total_positions", "bigint"),
            known("open_qty", "bigint"),
            known("closed_qty", "bigint"),
            known("min_qty", "int"),
            known("target_qty", "int"),
            known("total_consumed", "bigint"),
            known("avg_daily_consumption", "decimal(24,4)"),
            known("avg_platform_30d", "decimal(24,2)"),
        )
    )
    projected = F.ceil(F.col("avg_daily_consumption") * F.lit(days)).cast("bigint")
    closed = F.col("closed_qty")
    short = (closed <= F.col("min_qty")) | (closed < projected)
    wanted = F.greatest(F.col("target_qty") - closed, projected - closed, F.lit(0))
    return facts.withColumn("suggested_qty", F.when(short, wanted).otherwise(0).cast("bigint"))


def order_worklist(suggestions: DataFrame, show_all: bool = False) -> DataFrame:
    """Suggestions with the quantity missing to the target as the default to confirm."""
    missing = at_least_zero(F.col("target_qty") - F.col("closed_qty"))
    lines = suggestions if show_all else suggestions.where(F.col("suggested_qty") > 0)
    return lines.withColumn("min_para_alvo", missing).withColumn(
        "confirmed_qty", F.col("min_para_alvo")
    )


def suggestion_metrics(suggestions: DataFrame) -> DataFrame:
    """Lines analysed, lines that need an order, closed boxes."""
    return suggestions.agg(
        F.count("*").alias("analysed"),
        F.count_if(F.col("suggested_qty") > 0).alias("needs_order"),
        F.coalesce(F.sum("closed_qty"), F.lit(0)).alias("closed_qty"),
    )


def _feed_answers(feed: DataFrame, asked: DataFrame) -> DataFrame:
    """The feed's rows; none of them if it tells nothing of the products asked for."""
    answers = feed.select(
        F.col("product_id").alias("id"),
        F.col("available").alias("supplier_available"),
        F.col("price").alias("supplier_price"),
    )
    heard = answers.join(asked.select("id"), "id", "left_semi")
    told = heard.select(F.bool_or(F.col("supplier_available").isNotNull()).alias("told")).scalar()
    return answers.where(told)


def supplier_availability_join(worklist: DataFrame, feed: DataFrame | None) -> DataFrame:
    """Availability and price of each line; NULL without a feed or an answer."""
    if feed is None:
        return worklist.select(
            "*",
            F.lit(None).cast("boolean").alias("supplier_available"),
            F.lit(None).cast("double").alias("supplier_price"),
        )
    return worklist.join(_feed_answers(feed, worklist), "id", "left").select(
        *worklist.columns, "supplier_available", "supplier_price"
    )


def supplier_availability_counts(offered: DataFrame) -> DataFrame:
    """Available products and checked lines of a worklist joined with the feed."""
    return offered.agg(
        F.count_distinct(F.when(F.col("supplier_available"), F.col("id"))).alias("available"),
        F.count("*").alias("checked"),
    )


def edit_worklist(
    worklist: DataFrame, edits: DataFrame, arrival: str | None = None
) -> DataFrame:
    """The worklist with quantities confirmed by hand; the other lines keep the default.

    Of several edits of a product the last by ``arrival`` stands.
    """
    by_hand = last_per_key(edits, ["product_id"], arrival).select(F.col("product_id").alias("id"), F.col("confirmed_qty").alias("edited"))
    return worklist.join(by_hand, "id", "left").select(
        *[
            F.coalesce("edited", "confirmed_qty").alias(name)
            if name == "confirmed_qty"
            else F.col(name)
            for name in worklist.columns
        ]
    )


def order_below_target(worklist: DataFrame) -> DataFrame:
    """Confirmed lines that would not reach the target; any such line blocks a save."""
    return worklist.where(
        (F.col("confirmed_qty") > 0) & (F.col("confirmed_qty") < F.col("min_para_alvo"))
    )


def purchase_order_header(
    orders_highest_id, period_days: int, notes: str, created_by: str, as_of: Moment
) -> dict:
    """Column expressions of a new draft order."""
    if not created_by.strip():
        raise ValueError("a purchase order needs the person responsible")
    return {
        "order_id": orders_highest_id + F.lit(1),
        "order_date": moment(as_of),
        "status": F.lit("RASCUNHO"),
        "period_days": F.lit(period_days),
        "notes": F.lit(notes.strip()),
        "created_by": F.lit(created_by.strip()),
    }


def purchase_order_build(
    worklist: DataFrame,
    orders_highest_id,
    period_days: int,
    notes: str,
    created_by: str,
    as_of: Moment = None,
) -> DataFrame:
    """Item rows of a new order, each with the order's header columns.

    Empty if no line is confirmed or if any line is below its target. The first
    group of columns is the header (take one row), the others are the items.
    """
    header = purchase_order_header(orders_highest_id, period_days, notes, created_by, as_of)
    present = set(worklist.columns)

    def given(name: str, default):
        return F.col(name) if name in present else default

    zero = F.lit(0)
    confirmed = given("confirmed_qty", given("suggested_qty", zero))
    lines = worklist.withColumn("confirmed_qty", confirmed).where(F.col("confirmed_qty") > 0)
    if "min_para_alvo" in present:
        blocked = lines.select(
            F.count_if(F.col("confirmed_qty") < F.col("min_para_alvo")).alias("n")
        ).scalar()
        lines = lines.where(blocked == 0)
    return lines.select(
        *[value.alias(name) for name, value in header.items()],
        F.col("id").alias("product"),
        given("closed_qty", zero).alias("current_stock"),
        given("min_qty", zero).alias("min_qty"),
        given("target_qty", zero).alias("target_qty"),
        given("avg_daily_consumption", zero).alias("avg_daily_consumption"),
        given("suggested_qty", zero).alias("suggested_qty"),
        "confirmed_qty",
        given("supplier_available", F.lit(None).cast("boolean")).alias("supplier_available"),
        given("supplier_price", F.lit(None).cast("double")).alias("supplier_price"),
    )
