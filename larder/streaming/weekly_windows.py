"""Weekly consumption in event time: a week is written once, when it is closed.

Units are counted by product in tumbling windows that start on Mondays. The watermark
follows the latest change by ``lateness``; a week is closed when the watermark has passed
its end. Closed weeks are appended to a table filed by week and leave the state store,
so the state holds the open weeks only, however long the stream runs. Changes that
arrive after their week was closed are left out and counted: what arrived, less what is
in closed weeks and in the open weeks of the state store.

Restarts, retries and lost executors change nothing: the state is checkpointed, and the
files of a repeated micro-batch replace each other in the table's own log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larder.operators.consumption import name_weekly_counts

LATENESS = "7 days"
WEEK = ("7 days", "7 days", "4 days")  # the first Monday is four days after the epoch
CLOSED = "product bigint, consumed bigint, week date"
ARRIVED = "arrived bigint, batch bigint"


def _instant(local: Column) -> Column:
    """A local time as if it were UTC, in any session zone: watermarks need an instant."""
    since = local - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    part = lambda name: F.extract(F.lit(name), since)
    minutes = (part("DAY").cast("bigint") * 24 + part("HOUR")) * 60 + part("MINUTE")
    return F.timestamp_micros(minutes * 60_000_000 + (part("SECOND") * 1_000_000).cast("bigint"))


def _day(instant: Column) -> Column:
    return F.date_from_unix_date(F.floor(F.unix_micros(instant) / 86_400_000_000).cast("int"))


def weekly_counts(history: DataFrame, lateness: str) -> DataFrame:
    """Units per week and product of a stream of changes."""
    timed = history.select("product", _instant(F.col("change_date")).alias("at"))
    counts = timed.withWatermark("at", lateness).groupBy(F.window("at", *WEEK), "product").agg(
        F.count("*").alias("consumed")
    )
    return counts.select("product", "consumed", _day(F.col("window.start")).alias("week"))


def start_weekly_windows(history: DataFrame, root: str, lateness: str = LATENESS) -> StreamingQuery:
    """Appends the weeks that close with what has landed since the last run, then stops."""
    return (
        weekly_counts(history.select("product", "change_date"), lateness)
        .writeStream.format("parquet")
        .outputMode("append")
        .partitionBy("week")
        .option("path", f"{root}/closed")
        .option("checkpointLocation", f"{root}/checkpoint-windows")
        .trigger(availableNow=True)
        .start()
    )


def start_arrivals(history: DataFrame, root: str) -> StreamingQuery:
    """Counts the changes of each micro-batch; a repeated one overwrites its own number.

    Only changes with a date belong to a week; others are not late.
    """

    def write(changes: DataFrame, batch: int) -> None:
        counted = changes.agg(F.count("change_date").alias("arrived"))
        counted.write.mode("overwrite").parquet(f"{root}/arrived/batch={batch}")

    return (
        history.select("change_date")
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{root}/checkpoint-arrivals")
        .trigger(availableNow=True)
        .start()
    )


def run_weekly_windows(history: DataFrame, root: str, lateness: str = LATENESS) -> None:
    """Both streams to the end of their input."""
    for query in (start_weekly_windows(history, root, lateness), start_arrivals(history, root)):
        query.awaitTermination()


def read_closed_weeks(
    spark: SparkSession, root: str, product: DataFrame, exclude: DataFrame, since: str | None = None
) -> DataFrame:
    """Units per closed week and product name, from a first Monday on."""
    closed = spark.read.schema(CLOSED).parquet(f"{root}/closed")
    if since is not None:
        closed = closed.where(F.col("week") >= F.lit(since).cast("date"))
    return name_weekly_counts(closed.select("week", "product", "consumed"), product, exclude)


def read_open_weeks(spark: SparkSession, root: str) -> DataFrame:
    """(week, product, consumed) of the weeks still open, from the state store."""
    state = spark.read.format("statestore").load(f"{root}/checkpoint-windows")
    return state.select(
        _day(F.col("key.window.start")).alias("week"),
        F.col("key.product").alias("product"),
        F.col("value.count").alias("consumed"),
    )


def late_changes(spark: SparkSession, root: str) -> DataFrame:
    """(arrived, closed, open, late): how many changes came, and where they are."""
    zero = F.lit(0).cast("bigint")
    arrived = spark.read.schema(ARRIVED).parquet(f"{root}/arrived")
    closed = spark.read.schema(CLOSED).parquet(f"{root}/closed")
    total = F.coalesce(F.sum("n"), zero)
    parts = [
        arrived.select(F.lit("arrived").alias("part"), F.col("arrived").alias("n")),
        closed.select(F.lit("closed").alias("part"), F.col("consumed").alias("n")),
        read_open_weeks(spark, root).select(F.lit("open").alias("part"), F.col("consumed").alias("n")),
    ]
    stacked = parts[0].unionByName(parts[1]).unionByName(parts[2])
    summed = stacked.agg(
        *[
            F.coalesce(F.sum(F.when(F.col("part") == name, F.col("n"))), zero).alias(name)
            for name in ("arrived", "closed", "open")
        ]
    )
    return summed.withColumn("late", F.col("arrived") - F.col("closed") - F.col("open"))
