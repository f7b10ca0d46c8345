"""Reading the stored tables: Parquet folders or a JDBC database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder import schemas
from larder.functions import moment
from larder.functions.predicates import Moment

MONTH = "change_month"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stored table with its full schema; columns an older file lacks are NULL."""
    return spark.read.schema(schemas.TABLES[name]).parquet(f"{folder}/{name}")


def read_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: read_table(spark, folder, name) for name in schemas.TABLES}


def read_jdbc_table(
    spark: SparkSession, name: str, url: str, split_on: str | None = None,
    lower: int = 0, upper: int = 0, splits: int = 1, **options: str,
) -> DataFrame:
    """A table of a relational database, in the same column types.

    ``split_on`` with its bounds makes Spark read ``splits`` ranges in parallel.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if split_on:
        reader = reader.options(
            partitionColumn=split_on, lowerBound=lower, upperBound=upper, numPartitions=splits
        )
    return conform(reader.load(), name)


def conform(df: DataFrame, name: str) -> DataFrame:
    """Columns of a table schema, cast; columns the data lacks become NULL."""
    present = {column.lower(): column for column in df.columns}
    return df.select(
        *[
            (F.col(present[field.name]) if field.name in present else F.lit(None))
            .cast(field.dataType)
            .alias(field.name)
            for field in schemas.TABLES[name].fields
        ]
    )


def append_table(df: DataFrame, folder: str, name: str) -> None:
    """Adds rows to a stored table."""
    conform(df, name).write.mode("append").parquet(f"{folder}/{name}")


def append_history(df: DataFrame, folder: str) -> None:
    """Adds position changes, filed by month so that a report opens recent months only."""
    rows = conform(df, "freezer_position_history")
    rows.withColumn(MONTH, F.trunc(F.to_date("change_date"), "month")).write.mode(
        "append"
    ).partitionBy(MONTH).parquet(f"{folder}/freezer_position_history")


def read_recent_history(
    spark: SparkSession, folder: str, days: int, as_of: Moment = None
) -> DataFrame:
    """Position changes of the months that the last ``days`` days reach into."""
    schema = schemas.TABLES["freezer_position_history"]
    first = F.trunc(F.to_date(moment(as_of) - F.make_dt_interval(F.lit(days))), "month")
    rows = spark.read.schema(f"{_ddl(schema)}, {MONTH} date").parquet(
        f"{folder}/freezer_position_history"
    )
    return rows.where(F.col(MONTH) >= first).select(*schema.fieldNames())


ITEM_MONTH = "item_month"


def append_items(df: DataFrame, folder: str) -> None:
    """Adds order items, filed by the month of their date; undated ones have a folder too."""
    rows = conform(df, "supplier_order_item")
    rows.withColumn(ITEM_MONTH, F.trunc(F.to_date("created_at"), "month")).hint(
        "rebalance", F.col(ITEM_MONTH)
    ).write.mode("append").partitionBy(ITEM_MONTH).parquet(f"{folder}/supplier_order_item")


def read_items(
    spark: SparkSession, folder: str, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Order items, or those of the months that a range of days reaches into."""
    schema = schemas.TABLES["supplier_order_item"]
    rows = spark.read.schema(f"{_ddl(schema)}, {ITEM_MONTH} date").parquet(f"{folder}/supplier_order_item")
    if start is not None and end is not None:
        first = F.trunc(F.lit(str(start)).cast("date"), "month")
        rows = rows.where(F.col(ITEM_MONTH).between(first, F.lit(str(end)).cast("date")))
    return rows.select(*schema.fieldNames())


def _ddl(schema) -> str:
    return ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in schema.fields)


def read_availability_feed(spark: SparkSession, path: str | None) -> DataFrame | None:
    """The supplier's answers as JSON lines; None where no feed is set up."""
    if not path:
        return None
    return spark.read.schema(schemas.TABLES["supplier_availability"]).json(path)
