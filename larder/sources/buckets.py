"""Tables filed in buckets of a key, so that joins and sums on it need no shuffle.

Two tables with the same number of buckets of the same key are joined bucket by bucket, and
a bucketed table is grouped by its key where it lies. A bucket is read by one task: choose
as many as keep a bucket small, and another layout where one key holds a large share.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def store_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> DataFrame:
    """Stores a frame in buckets of ``key``, one sorted file each, and opens it."""
    name = f"larder_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key)
    writer.option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def open_bucketed(spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int) -> DataFrame:
    """A table stored that way, in another session."""
    name = f"larder_{uuid.uuid4().hex}"
    columns = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in schema.fields)
    place = path.replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet "
        f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {int(buckets)} BUCKETS LOCATION '{place}'"
    )
    return spark.table(name)
