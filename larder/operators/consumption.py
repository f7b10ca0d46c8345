"""Units consumed, counted from the position history (one row is one unit)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import trailing_window, without_excluded
from larder.functions.predicates import Moment


def daily_average(units: Column, days: int) -> Column:
    """Units per day in decimal, rounded half up to four digits."""
    return F.round(units.cast("decimal(20,0)") / F.lit(days).cast("decimal(10,0)"), 4)


def consumed_per_product(
    history: DataFrame, exclude: DataFrame, days: int, as_of: Moment
) -> DataFrame:
    """Units and daily average per product id; the history is reduced before any join."""
    counted = (
        history.where(trailing_window(F.col("change_date"), days, as_of))
        .groupBy("product")
        .agg(F.count("*").alias("total_consumed"))
    )
    return without_excluded(counted, "product", exclude).withColumn(
        "avg_daily_consumption", daily_average(F.col("total_consumed"), days)
    )


def consumption_summary(
    history: DataFrame,
    product: DataFrame,
    exclude: DataFrame,
    days: int = 30,
    as_of: Moment = None,
) -> DataFrame:
    """Units and daily average per product in the last ``days`` days."""
    names = product.select(
        "id", F.col("description").alias("product_desc"), "product_type"
    )
    used = consumed_per_product(history, exclude, days, as_of).withColumnRenamed("product", "id")
    return used.join(names, "id").select(
        "id", "product_desc", "product_type", "total_consumed", "avg_daily_consumption"
    )


def week_start(ts: Column) -> Column:
    """The Monday of the ISO week."""
    return F.trunc(F.to_date(ts), "week")


def name_weekly_counts(
    counts: DataFrame, product: DataFrame, exclude: DataFrame
) -> DataFrame:
    """Counts per week and product id, summed per product name (names may repeat)."""
    names = product.select(
        F.col("id").alias("product"), F.col("description").alias("product_desc"), "product_type"
    )
    return (
        without_excluded(counts, "product", exclude)
        .join(names, "product")
        .groupBy("week", "product_desc", "product_type")
        .agg(F.sum("consumed").alias("consumed"))
    )


def consumption_weekly(
    history: DataFrame,
    product: DataFrame,
    exclude: DataFrame,
    days: int = 30,
    as_of: Moment = None,
) -> DataFrame:
    """Units per ISO week and product name in the last ``days`` days."""
    counts = (
        history.where(trailing_window(F.col("change_date"), days, as_of))
        .groupBy(week_start(F.col("change_date")).alias("week"), "product")
        .agg(F.count("*").alias("consumed"))
    )
    return name_weekly_counts(counts, product, exclude)


def consumption_total(summary: DataFrame) -> DataFrame:
    """Units consumed over all products: one number."""
    return summary.agg(F.coalesce(F.sum("total_consumed"), F.lit(0)).alias("total_consumed"))


def top_consumed(summary: DataFrame, k: int = 15) -> DataFrame:
    """The k products with the highest consumption; equal counts go by id."""
    return summary.orderBy(F.desc("total_consumed"), "id").limit(k)


def top_products_weekly(weekly: DataFrame, summary: DataFrame, k: int = 8) -> DataFrame:
    """The weekly series of the k most consumed products, matched by name."""
    names = top_consumed(summary, k).select("product_desc")
    return weekly.join(names, "product_desc", "left_semi").select(*weekly.columns)
