"""Weekly consumption kept up to date from a stream of position changes.

Each micro-batch files its units per product and day under its own number, so no change
is too late and no stored counter is read or written again; a repeated batch overwrites
its own. A report applies its window when it adds them up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larder.functions import trailing_window
from larder.functions.predicates import Moment
from larder.operators.consumption import name_weekly_counts, week_start

COUNTERS = "day date, product bigint, consumed bigint"


def daily_counts(history: DataFrame) -> DataFrame:
    """Units per day and product id."""
    return history.groupBy(F.to_date("change_date").alias("day"), "product").agg(
        F.count("*").alias("consumed")
    )


def add_batch(root: str, changes: DataFrame, batch: int) -> None:
    """Files the counters of a micro-batch."""
    daily_counts(changes).write.mode("overwrite").parquet(f"{root}/counts/batch={batch}")


def start_weekly_consumption(history: DataFrame, root: str) -> StreamingQuery:
    """Counts every change that has landed since the last run, then stops."""

    def write(changes: DataFrame, batch: int) -> None:
        add_batch(root, changes, batch)

    return (
        history.select("product", "change_date")
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def read_weekly_consumption(
    spark: SparkSession,
    root: str,
    product: DataFrame,
    exclude: DataFrame,
    days: int = 30,
    as_of: Moment = None,
) -> DataFrame:
    """Units per ISO week and product name in the last ``days`` days, by whole days.

    Equal to the batch report where ``as_of`` is a midnight.
    """
    spark.createDataFrame([], COUNTERS).write.mode("ignore").parquet(f"{root}/counts/batch=-1")
    counters = spark.read.schema(COUNTERS).parquet(f"{root}/counts")
    counts = (
        counters.where(trailing_window(F.col("day").cast("timestamp_ntz"), days, as_of))
        .groupBy(week_start(F.col("day")).alias("week"), "product")
        .agg(F.sum("consumed").alias("consumed"))
    )
    return name_weekly_counts(counts, product, exclude)
