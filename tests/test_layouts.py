"""Tables stored for a purpose: buckets, months, totals by deltas, bitmaps, versions compared."""

import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from test_merges import order_set, random_delivery, state, write_lines

from larder import schemas
from larder.functions import moment_label
from larder.operators import changes, pricing, totals
from larder.plans import jobs
from larder.sources import buckets
from larder.sources import tables as sources
from larder.sources.documents import read_order_lines
from larder.sources.versions import RANGE, VersionedTables
from larder.streaming import order_ingest


def executed(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def some_items(spark, rows):
    """Items from (id, order_id, category, quantity, price, local id, date)."""
    kinds = (
        "id bigint, order_id bigint, external_category string, quantity decimal(10,3), "
        "price_unit decimal(10,2), local_product_id bigint, created_at timestamp_ntz"
    )
    return sources.conform(spark.createDataFrame(rows, kinds), "supplier_order_item")


def random_items(rng, count, orders):
    return [
        (
            i, rng.randrange(orders), rng.choice(["Sorvetes", "ACAI", "potes", None]),
            rng.choice([None, Decimal(rng.randrange(1, 9000)) / 1000]), rng.choice([None, Decimal(rng.randrange(1, 900)) / 100]),
            rng.choice([None, 5]), rng.choice([None, datetime.datetime(2024, 1 + rng.randrange(6), 1 + rng.randrange(28), 12)]),
        )
        for i in range(count)
    ]


def test_bucketed_joins_do_not_shuffle_items(spark, tmp_path):
    items = some_items(spark, random_items(random.Random(1), 300, 60))
    rows = [(i, 100 + i, i % 2, Decimal(i), Decimal(2 * i)) for i in range(70)]
    orders = sources.conform(
        spark.createDataFrame(rows, "id bigint, platform_order_id bigint, type_of_load int, product_invoice_value decimal(12,2), service_invoice_value decimal(12,2)"),
        "supplier_order",
    )
    product = spark.createDataFrame([(5, "five")], "id bigint, description string")
    filed_orders = buckets.store_bucketed(orders, str(tmp_path / "o"), "id", 4)
    filed_items = buckets.store_bucketed(items, str(tmp_path / "i"), "order_id", 4)
    again = buckets.open_bucketed(spark, str(tmp_path / "i"), filed_items.schema, "order_id", 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for source in (filed_items, again):
            summary = pricing.supplier_orders_summary(filed_orders, source)
            assert "Exchange" not in executed(summary) and "SortMergeJoin" in executed(summary)
            assert sorted(summary.collect(), key=str) == sorted(pricing.supplier_orders_summary(orders, items).collect(), key=str)
        named = pricing.supplier_order_items(filed_items, product)
        costs = pricing.supplier_order_item_costs(filed_items.withColumn("local_product_desc", F.lit("x")), summary)
        assert "Exchange" not in executed(costs) and named.count() == 300
        priced = pricing.price_items(filed_items, filed_orders, product, "2024-02-01", "2024-03-31")
        assert "hashpartitioning(order_id" not in executed(priced)
        want = pricing.price_items(items, orders, product, "2024-02-01", "2024-03-31")
        assert sorted(priced.collect(), key=str) == sorted(want.collect(), key=str) and want.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_items_by_month_open_the_months_asked_for(spark, tmp_path):
    items = some_items(spark, random_items(random.Random(2), 200, 40))
    for part in items.randomSplit([1.0, 1.0], seed=3):
        sources.append_items(part, str(tmp_path))
    assert sources.read_items(spark, str(tmp_path)).count() == 200
    found = sources.read_items(spark, str(tmp_path), "2024-02-10", "2024-03-01")
    assert {r.created_at.month for r in found.collect()} == {2, 3}
    assert "PartitionFilters: [isnotnull(item_month" in executed(found)
    orders = spark.range(40).select("id", F.lit(1).alias("type_of_load"))
    product = spark.createDataFrame([(5, "five")], "id bigint, description string")
    ask = lambda rows: sorted(pricing.item_frequency(rows, orders, product, "2024-02-10", "2024-03-01").collect(), key=str)
    assert ask(found) == ask(items)


@pytest.mark.parametrize("start, end", [("2024-01-10", "2024-05-20"), ("2024-02-01", "2024-03-31"), ("2024-02-05", "2024-02-09"), ("2024-01-15", "2024-02-10")])
def test_bitmaps_count_distinct_orders(spark, tmp_path, start, end):
    rows = [(i, 40_000 * (o % 3) + o, c, q, p, n, at) for i, o, c, q, p, n, at in random_items(random.Random(4), 400, 90)]
    items = some_items(spark, rows)
    orders = items.select(F.col("order_id").alias("id")).distinct().withColumn("type_of_load", (F.col("id") % 2).cast("int"))
    totals.monthly_order_bitmaps(items, orders).write.parquet(str(tmp_path / "bitmaps"))
    stored = spark.read.parquet(str(tmp_path / "bitmaps"))
    got = {(r[0], r[1]): r[2] for r in totals.category_order_counts(stored, items, orders, start, end).collect()}
    want = {}
    for _, order, category, _, _, _, at in rows:
        if at and start <= at.date().isoformat() <= end:
            want.setdefault((category, order % 2), set()).add(order)
    assert got == {key: len(found) for key, found in want.items()} and want


def test_totals_follow_random_batches(spark, tmp_path):
    """Insert and refresh batches and syncs: stored totals equal those of all stored items."""
    rng = random.Random(11)
    tables = order_ingest.order_tables(spark, str(tmp_path / "t"), range_width=5)
    for batch in range(4):
        lines = tmp_path / f"{batch}.json"
        write_lines(lines, [random_delivery(rng, 100 * batch + i, range(1, 20)) for i in range(12)])
        order_ingest.merge_batch(tables, read_order_lines(spark, str(lines)), 2 * batch, update_existing=batch % 2 == 1)
        mapping = spark.createDataFrame([(k, 70 + k) for k in range(2 * batch)], "external_product_id bigint, local_product_id bigint")
        jobs.sync_mapping(tables, mapping, 2 * batch + 1)
        items = tables.read(order_ingest.ITEMS)
        want = pricing.items_per_order(items)
        got = totals.shown_totals(tables.read(order_ingest.TOTALS).drop(RANGE))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
        filed = items.select((F.col(RANGE) % 2 == 1).alias("apart"), F.col("local_product_id").isNull().alias("missing"))
        assert filed.where("apart <> missing").count() == 0
    assert len(order_set(state(tables)[0])) > 10


def test_changes_equal_a_full_outer_join(spark):
    rng = random.Random(6)
    value = lambda: rng.choice([None, "a", "b"])
    for _ in range(3):
        before = {rng.choice([None, *range(12)]): (value(), rng.choice([None, 1, 2])) for _ in range(9)}
        after = {k: v if rng.random() < 0.4 else (value(), rng.choice([None, 1, 2])) for k, v in before.items() if rng.random() < 0.8}
        after |= {rng.randrange(12, 20): (value(), 1) for _ in range(3)}
        frames = [spark.createDataFrame([(k, *v) for k, v in rows.items()], "id bigint, x string, y int") for rows in (before, after)]
        found = changes.changed_rows(*frames, ["id"])
        got = {r.id: (r.change, tuple(r.before) if r.before else None, tuple(r.after) if r.after else None) for r in found.collect()}
        want = {
            k: ("inserted" if k not in before else "deleted" if k not in after else "changed", before.get(k), after.get(k))
            for k in before.keys() | after.keys()
            if before.get(k) != after.get(k) or (k in before) != (k in after)
        }
        assert got == want
        fields = {(r.id, r.field): (r.old, r.new) for r in changes.field_changes(found, ["id"]).collect()}
        for k, (_, old, new) in want.items():
            for i, name in enumerate(("x", "y")):
                a, b = (None if row is None or row[i] is None else str(row[i]) for row in (old, new))
                assert fields.get((k, name), (None, None)) == ((a, b) if a != b else (None, None))
    with pytest.raises(ValueError):
        changes.changed_rows(frames[0], frames[1].drop("y"), ["id"])


def test_versions_are_compared_by_the_ranges_written(spark, tmp_path):
    name = "purchase_order"
    tables = VersionedTables(spark, str(tmp_path / "t"), {name: schemas.TABLES[name]}, range_width=10)
    rows = sources.conform(spark.createDataFrame([(i, "RASCUNHO") for i in (1, 11, 21)], "id bigint, status string"), name)
    tables.publish({name: rows.withColumn(RANGE, tables.range_of(F.col("id")))}, 0)
    ask = spark.createDataFrame([(11, "CONFIRMADO")], "order_id bigint, new_status string")
    jobs.apply_order_status(tables, ask, 1)
    found = changes.changes_between(tables, name, 1, 2, ["id"])
    assert all(f"{RANGE}=1/" in path for path in found.inputFiles()) and found.inputFiles()
    row, = found.collect()
    assert (row.id, row.change, row.fields, row.before.status, row.after.status) == (11, "changed", ["status"], "RASCUNHO", "CONFIRMADO")
    jobs.edit_table(tables, name, lambda stored: stored.where("id <> 21"), 2)
    assert [(r.id, r.change) for r in changes.changes_between(tables, name, 2, 3, ["id"]).collect()] == [(21, "deleted")]
    assert tables.read(name, at=1).count() == 3 and tables.read(name).count() == 2


def test_shown_times_do_not_depend_on_the_session_zone(spark):
    times = [datetime.datetime(2024, 3, 10, 2, 30, 59), datetime.datetime(2024, 12, 1), None]
    frame = spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = [r[0] for r in frame.select(moment_label(F.col("ts"))).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == ["10/03/2024 02:30", "01/12/2024 00:00", "—"]
