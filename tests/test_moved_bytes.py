"""What the larger queries move between tasks and write."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.operators import order_merge, totals
from larder.plans import reports
from larder.sources.testdata import TestTables
from larder.sources.versions import RANGE, VersionedTables

SOURCE = "/root/testdata/sf0.001"


@pytest.fixture
def tables(spark):
    return TestTables(spark, SOURCE)


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def values(frame):
    return sorted(tuple(map(str, row)) for row in frame.collect())


def test_landed_documents_are_compressed(tables, tmp_path, monkeypatch):
    """They are not joined again for their number of parts, and the batch leaves no placed items."""
    monkeypatch.setattr(reports, "_folder", lambda t, name: str(tmp_path / name))
    assert reports.stream_order_ingest(tables).count() > 0
    landed = list((tmp_path / "order-ingest" / "landing").glob("part-*"))
    assert landed and all(path.name.endswith(".json.gz") for path in landed)
    placed = Path(tmp_path / "order-ingest" / "staging" / "batch=0" / "placed")
    assert placed.exists() and tables.spark.read.parquet(str(placed)).count() == 0


def test_numbered_documents_count_their_parts(tables):
    rows = reports._numbered_documents(tables).select("delivery", "part", "parts").collect()
    there = {}
    for row in rows:
        there.setdefault((row.delivery, row.parts), set()).add(row.part)
    assert rows and all(len(parts) == wanted for (_, wanted), parts in there.items())
    assert len({delivery for delivery, _ in there}) == len(there) == tables.raw_order_header.count()


def test_items_are_nested_where_they_meet_their_headers(tables):
    text = plan(tables.documents)
    assert re.search(r"hashpartitioning\(src_key#\d+L?, \d+\)", text)
    assert not re.search(r"hashpartitioning\(src_key#\d+L?, part", text)


@pytest.mark.parametrize("name", ["merge_order_items", "merge_order_items_insert_only"])
def test_items_are_joined_with_their_orders_once(tables, name):
    files = reports.REPORTS[name](tables).inputFiles()
    assert any("/placed/" in file for file in files)
    assert not any("/resolved/" in file for file in files)


@pytest.mark.parametrize("update", [False, True])
def test_placed_items_merge_as_plain_ones(spark, update):
    resolved = spark.createDataFrame(
        [(7, 1, False, 10), (8, 2, True, 20), (9, 3, True, None)],
        "platform_order_id bigint, id bigint, is_new boolean, first_arrival bigint",
    )
    lines = spark.createDataFrame(
        [(10, 0, 0, 7, 1, 5, 6), (20, 0, 0, 8, 1, None, None), (20, 0, 0, 8, 1, None, None), (21, 0, 0, 8, 1, 4, None),
         (22, 0, 0, None, 1, 4, 4), (30, 0, 0, 9, 1, 1, 1)],
        "arrival bigint, part int, pos int, platform_order_id bigint, platform_item_id bigint, "
        "nfe_bling_id bigint, sale_order_bling_id bigint",
    )
    target = spark.createDataFrame(
        [(1, 1, None, 2), (1, 1, None, 2), (1, None, 3, 3)],
        "order_id bigint, platform_item_id bigint, nfe_bling_id bigint, sale_order_bling_id bigint",
    )
    placed = order_merge.placed_items(resolved, lines, update)
    plain = order_merge.merge_order_items(target, resolved, lines, update)
    assert values(order_merge.merge_order_items(target, resolved, placed, update)) == values(plain)
    new = [order_merge.inserted_items(resolved, rows).select("order_id", "arrival") for rows in (placed, lines)]
    assert values(new[0]) == values(new[1]) == [("2", "20"), ("2", "20")]


def test_stored_items_are_read_from_the_tables_once(tables, monkeypatch):
    reads, numbered = [], reports._numbered_items
    monkeypatch.setattr(reports, "_numbered_items", lambda t: reads.append(1) or numbered(t))
    reports.supplier_orders_summary_stored(tables)
    assert len(reads) == 1


def test_kept_rows_stay_in_their_ranges(spark, tmp_path):
    """A batch shuffles its own rows, and no stored ones."""
    kind = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
    stored = VersionedTables(spark, str(tmp_path), {"t": kind})
    first = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], kind).withColumn(RANGE, F.col("id"))
    stored.publish({"t": first}, 0)
    second = spark.createDataFrame([(2, "b"), (5, "c")], kind).withColumn(RANGE, F.col("id"))
    stored.publish({"t": second}, 1, kept={"t": stored.read("t")})
    got = values(stored.read("t").select("id", "name", RANGE))
    assert got == [("1", "a", "1"), ("1", "a", "1"), ("2", "None", "2"), ("2", "b", "2"), ("5", "c", "5")]
    assert stored.ranges("t") == [1, 2, 5] and stored.highest_id("t") == 5


def test_bitmaps_are_made_after_the_shuffle(spark):
    items = spark.createDataFrame(
        [(1, "a", "2000-01-02"), (40_000, "a", "2000-01-02"), (1, "a", "2000-02-02"), (1, None, "2000-02-25")],
        "order_id bigint, external_category string, created_at string",
    ).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    orders = spark.createDataFrame([(1, 1), (40_000, None)], "id bigint, type_of_load int")
    bitmaps = totals.monthly_order_bitmaps(items, orders)
    counts = totals.category_order_counts(bitmaps, items, orders, "2000-01-01", "2000-02-20")
    for frame, made in ((bitmaps, "bitmap_construct_agg"), (counts, "bitmap_or_agg")):
        text = plan(frame)
        dealt = re.search(r"Exchange hashpartitioning\([^)]*bucket", text)
        assert made in text[: dealt.start()] and made not in text[dealt.end():]
    assert values(counts) == [("a", "1", "1"), ("a", "None", "1")]
