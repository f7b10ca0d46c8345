"""Helpers that several of these operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.session import discard, shared_folder, write

#: Words of all contracts here: runs of anything but these blanks.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_share(ids: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; -1 for a null id."""
    return F.coalesce(F.crc32(ids.cast("string").cast("binary")) % modulus, F.lit(-1))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that do not clash, ignoring case, with those of ``df``."""
    taken = {name.lower() for name in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def stage(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes a frame to the shared folder and reads it back.

    Cuts the lineage with a table that outlives executors.
    """
    path = f"{shared_folder(df.sparkSession)}/larder-llm/{name}-{uuid.uuid4().hex}"
    return write(df, path, compression=compression)


def training_labels(
    labels: DataFrame, column: str, modulus: int, kept_out: int, most_rows: int
) -> DataFrame:
    """(doc_id, label) of at most about ``most_rows`` labelled documents.

    Rows whose id share is ``kept_out`` are never used; labels other than 0 and 1 and
    null ids are no labels; a document marked both ways counts as 1. Beyond the bound the
    documents with the smallest id hashes are taken, a fixed share of them all.
    """
    known = (
        labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull())
        .where(id_share(F.col("doc_id"), modulus) != kept_out)
        .groupBy("doc_id")
        .agg(F.max(F.col(column)).cast("int").alias("label"))
    )
    return hashed_sample(known, F.col("doc_id"), most_rows)


def hashed_sample(df: DataFrame, key: Column, most_rows: int) -> DataFrame:
    """All rows, or the share with the smallest key hashes that makes about ``most_rows``."""
    rows = df.count()
    if rows <= most_rows:
        return df
    steps = 1 << 30
    return df.where(F.pmod(F.xxhash64(key), F.lit(steps)) < int(steps * most_rows / rows))


def with_columns(
    df: DataFrame,
    column: str,
    fields: list[T.StructField],
    compute: Callable[[pa.Array], list[pa.Array]],
) -> DataFrame:
    """Appends columns that ``compute`` derives from one column, batch by batch."""
    place = df.columns.index(column)
    schema = T.StructType([*df.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [*batch.columns, *compute(batch.column(place))]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return df.mapInArrow(run, schema)


def tree_reduce(
    parts: DataFrame, dtype: type, plus: Callable[[np.ndarray, np.ndarray], np.ndarray], column: str = "part"
) -> np.ndarray | None:
    """Arrays held as bytes, one a row, put together in rounds and not all in one task.

    None without rows. Every array has the same, bounded length.
    """
    rows = parts.select(column).rdd.map(lambda row: np.frombuffer(row[0], dtype=dtype))

    def either(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return right if not len(left) else left if not len(right) else plus(left, right)

    total = rows.treeAggregate(np.zeros(0, dtype=dtype), either, either, depth=2)
    return total if len(total) else None


def tree_sum(parts: DataFrame) -> np.ndarray | None:
    """The sum of float64 arrays held as bytes, one a row."""
    return tree_reduce(parts, np.float64, np.add)


def components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(node, root) for each node of the edges (a, b): the smallest node it is connected to.

    Alternates the large-star and small-star steps over tables in the shared folder until
    nothing changes; rounds grow with the logarithm of a path's length, and an unfinished
    result is an error. Minima are aggregated map-side, so a node of many neighbours is a row
    per task.
    """
    pairs = edges.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).where("a <> b")
    current = stage(pairs.distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        both = current.select("a", "b").unionAll(current.select(F.col("b"), F.col("a")).toDF("a", "b"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        large = large.unionAll(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionAll(low.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct()
        )
        before, current = current, stage(small, "edges")
        discard(before)
        now = current.agg(
            F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))
        ).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components still change after {most_rounds} rounds")
    roots = current.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    tops = roots.select("root").distinct()
    return roots.unionByName(tops.select(F.col("root").alias("node"), "root"))


def prefix_sums(df: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """Running sums before each row of a small table of totals, by ``order`` within ``keys``."""
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(value).over(window), F.lit(0)))

