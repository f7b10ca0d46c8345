"""Boxes in freezer positions and stock settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import contains_text, without_excluded

# Position status codes and the product type that marks a free position.
OPEN, CLOSED, EMPTY_TYPE = "OPEN", "CLOSED", "Vazio"

NO_SETTINGS = {"min_qty": 0, "target_qty": 0, "period_days": 30}


def _with_status(positions: DataFrame, status: DataFrame) -> DataFrame:
    return positions.join(status.select(F.col("id").alias("status"), "status_code"), "status")


def _counted(code: str, n: Column) -> Column:
    return F.sum(F.when(F.col("status_code") == code, n).otherwise(0))


def _per_product_and_status(positions: DataFrame) -> DataFrame:
    """A few rows per product, so that no status and no product is a hot join key."""
    return positions.groupBy("product", "status").agg(F.count("*").alias("n"))


def empty_positions_count(
    positions: DataFrame, product: DataFrame, status: DataFrame
) -> DataFrame:
    """Closed positions that hold the free-position marker: one number."""
    closed = status.where(F.col("status_code") == CLOSED)
    markers = product.where(F.col("product_type") == EMPTY_TYPE)
    return (
        _with_status(_per_product_and_status(positions), closed)
        .join(markers.select(F.col("id").alias("product")), "product", "left_semi")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("empty_positions"))
    )


def current_stock(
    positions: DataFrame,
    product: DataFrame,
    freezer: DataFrame,
    status: DataFrame,
    exclude: DataFrame,
) -> DataFrame:
    """Positions, open and closed boxes and last change per product and freezer."""
    n = F.col("n")
    per_status = positions.groupBy("product", "freezer", "status").agg(
        F.count("*").alias("n"), F.max("update_date").alias("last_update")
    )
    counted = (
        _with_status(per_status, status)
        .groupBy("product", "freezer")
        .agg(
            F.sum(n).alias("total_positions"),
            _counted(OPEN, n).alias("open_qty"),
            _counted(CLOSED, n).alias("closed_qty"),
            F.max("last_update").alias("last_update"),
        )
    )
    names = product.select(
        F.col("id").alias("product"), F.col("description").alias("product_desc"), "product_type"
    )
    places = freezer.select(F.col("id").alias("freezer"), "freezer_name")
    return (
        without_excluded(counted, "product", exclude)
        .join(names, "product")
        .join(places, "freezer")
        .select(
            F.col("product").alias("id"),
            "product_desc",
            "product_type",
            F.col("freezer").alias("freezer_id"),
            "freezer_name",
            "total_positions",
            "open_qty",
            "closed_qty",
            "last_update",
        )
    )


def stock_per_product(positions: DataFrame, status: DataFrame) -> DataFrame:
    """Positions, open and closed boxes per product over all freezers."""
    n = F.col("n")
    return (
        _with_status(_per_product_and_status(positions), status)
        .groupBy("product")
        .agg(
            F.sum(n).alias("total_positions"),
            _counted(OPEN, n).alias("open_qty"),
            _counted(CLOSED, n).alias("closed_qty"),
        )
    )


def stock_metrics(stock: DataFrame, search: str | None = None) -> DataFrame:
    """Distinct products, open and closed boxes over the rows a search keeps."""
    return stock.where(contains_text(F.col("product_desc"), search)).agg(
        F.count_distinct("id").alias("products"),
        F.coalesce(F.sum("open_qty"), F.lit(0)).alias("open_qty"),
        F.coalesce(F.sum("closed_qty"), F.lit(0)).alias("closed_qty"),
    )


def stock_minimum_config(
    product: DataFrame, positions: DataFrame, stock_minimum: DataFrame
) -> DataFrame:
    """Settings of every product that has a position, with defaults where none are set."""
    stored = stock_minimum.select(
        F.col("product").alias("id"), "min_qty", "target_qty", "period_days", "updated_at"
    )
    return (
        product.join(positions.select(F.col("product").alias("id")).distinct(), "id", "left_semi")
        .join(stored, "id", "left")
        .select(
            F.col("id").alias("product_id"),
            F.col("description").alias("product_desc"),
            "product_type",
            *[
                F.coalesce(F.col(name), F.lit(default)).alias(name)
                for name, default in NO_SETTINGS.items()
            ],
            "updated_at",
        )
    )
