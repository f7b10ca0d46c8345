"""Test tables in which one key holds a third of the rows, against SQL."""

import compare
import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from larder.plans import reports
from larder.sources.testdata import TestTables

SOURCE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def hot_dir(tmp_path_factory):
    folder = tmp_path_factory.mktemp("hot")
    connection = duckdb.connect()
    hot = {
        "lineitem": "* REPLACE (CASE WHEN rowid % 3 = 0 THEN 8 ELSE l_partkey END AS l_partkey, "
        "CASE WHEN rowid % 3 = 0 THEN 12 ELSE l_orderkey END AS l_orderkey)",
        "events": "* REPLACE (CASE WHEN rowid % 3 = 0 THEN 8 ELSE user_id END AS user_id)",
    }
    for name in compare.TABLES:
        connection.execute(f"CREATE TABLE t AS SELECT * FROM '{SOURCE}/{name}.parquet'")
        connection.execute(f"COPY (SELECT {hot.get(name, '*')} FROM t) TO '{folder}/{name}.parquet'")
        connection.execute("DROP TABLE t")
    return str(folder)


@pytest.mark.parametrize("name", sorted(reports.REPORTS))
def test_hot_keys(spark, hot_dir, name):
    frame = entry_points.queries()[name](spark, hot_dir)
    sql = entry_points.oracle_sql()[name]
    assert compare.differences(frame, compare.connect(hot_dir), sql) == []


def test_an_order_keeps_its_header_apart_from_its_items(spark, hot_dir):
    t = TestTables(spark, hot_dir)
    rows = t.documents.where("arrival = 12").select(F.size("orderItems").alias("n"), "part", "invoices").collect()
    heads = [row for row in rows if row.part == 0]
    assert len(heads) == 1 and heads[0].invoices and len(rows) > 1
    assert sum(row.n for row in rows if row.part) == t.lineitem.where("l_orderkey = 12").count()


def test_skewed_joins_split_without_broadcast(spark, hot_dir):
    """The same results when no side may be broadcast and AQE splits skewed partitions."""
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
    }
    before = {name: spark.conf.get(name, None) for name in changed}
    for name, value in changed.items():
        spark.conf.set(name, value)
    try:
        for name in ("order_suggestions", "price_items", "item_frequency", "purchase_order_items",
                     "merge_order_items_insert_only"):
            frame = entry_points.queries()[name](spark, hot_dir)
            sql = entry_points.oracle_sql()[name]
            assert compare.differences(frame, compare.connect(hot_dir), sql) == []
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
