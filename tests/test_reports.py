"""Every report against its SQL twin, and the driver's entry points."""

import os

import compare
import pytest

import __spark_entry__ as entry_points
from larder.plans import oracle, reports

SF_DIR = os.environ.get("LARDER_TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF_DIR)


def test_every_report_has_a_twin():
    assert set(reports.REPORTS) == set(oracle.QUERIES)
    assert set(reports.REPORTS) <= set(entry_points.queries())
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(reports.REPORTS))
def test_report_equals_sql(spark, duck, name):
    frame = entry_points.queries()[name](spark, SF_DIR)
    assert compare.differences(frame, duck, entry_points.oracle_sql()[name]) == []


def test_entry_runs(spark):
    rows = entry_points.entry(spark).collect()
    assert rows and all(row.suggested_qty >= 0 for row in rows)


def test_other_session_time_zone(spark, duck):
    """Dates and weeks do not depend on the session's time zone."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        for name in ("consumption_weekly", "stream_weekly_consumption", "normalize_order_items"):
            frame = entry_points.queries()[name](spark, SF_DIR)
            assert compare.differences(frame, duck, entry_points.oracle_sql()[name]) == []
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
