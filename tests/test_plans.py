"""Properties of the plans: what reaches the scan, and what never occurs."""

import re

import pytest

import __spark_entry__ as entry_points
from larder.plans import reports

SF_DIR = "/root/testdata/sf0.001"
STREAMS = {name for name in reports.REPORTS if name.startswith("stream_")}


def plan(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    frame = entry_points.queries()[name](spark, SF_DIR)
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(reports.REPORTS) - STREAMS))
def test_no_cross_join_and_no_python(spark, name):
    text = plan(spark, name)
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert banned not in text


@pytest.mark.parametrize(
    "name, bound",
    [
        ("consumption_summary", "GreaterThanOrEqual(ts,2024-01-01T00:00)"),
        ("consumption_weekly", "GreaterThanOrEqual(ts,2024-01-01T00:00)"),
        ("order_suggestions", "GreaterThanOrEqual(l_shipdate,2001-05-31T00:00)"),
        ("price_items", "LessThan(l_shipdate,2001-01-01T00:00)"),
        ("item_frequency", "GreaterThanOrEqual(l_shipdate,2000-01-01T00:00)"),
    ],
)
def test_date_bounds_reach_the_scan(spark, name, bound):
    pushed = re.findall(r"PushedFilters: \[(.*?)\], ReadSchema", plan(spark, name))
    assert any(bound in filters for filters in pushed)


def test_scans_read_only_used_columns(spark):
    schemas = re.findall(r"ReadSchema: struct<(.*?)>", plan(spark, "consumption_summary"))
    assert "ts:timestamp_ntz,user_id:bigint" in schemas


def test_top_k_keeps_k_rows_per_task(spark):
    assert "TakeOrderedAndProject(limit=15" in plan(spark, "top_consumed")


def test_history_is_counted_before_it_is_joined(spark):
    text = plan(spark, "consumption_weekly")
    assert text.index("Join") < text.index("partial_count(1)")
