"""Stored tables: sources, partition pruning, purchase orders and edits."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from larder import schemas, session
from larder.operators import mapping, pricing, products, purchasing
from larder.plans import jobs
from larder.sources import tables as sources
from larder.sources.versions import VersionedTables
from larder.streaming.order_ingest import item_range

AS_OF = "2024-01-31 00:00:00"


def test_older_files_get_the_missing_columns(spark, tmp_path):
    old = spark.createDataFrame([(1, 5)], "id bigint, platform_order_id bigint")
    old.write.parquet(str(tmp_path / "supplier_order"))
    row = sources.read_table(spark, str(tmp_path), "supplier_order").first()
    assert (row.id, row.platform_order_id, row.vhsys, row.service_note) == (1, 5, None, None)


def test_append_conforms_types(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x")], "ID int, Status_Code string")
    sources.append_table(rows, str(tmp_path), "status")
    sources.append_table(rows, str(tmp_path), "status")
    stored = sources.read_table(spark, str(tmp_path), "status")
    assert stored.count() == 2 and stored.schema == schemas.TABLES["status"]


def test_recent_history_opens_recent_months_only(spark, tmp_path):
    rows = [(i, 1, datetime.datetime(2023, month, 15)) for i, month in enumerate(range(1, 13))]
    history = spark.createDataFrame(rows, schemas.TABLES["freezer_position_history"])
    sources.append_history(history, str(tmp_path))
    recent = sources.read_recent_history(spark, str(tmp_path), 30, "2023-12-20 00:00:00")
    assert sorted(r.change_date.month for r in recent.collect()) == [11, 12]
    text = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(change_month" in text


def test_availability_feed(spark, tmp_path):
    assert sources.read_availability_feed(spark, None) is None
    path = tmp_path / "feed.json"
    path.write_text(json.dumps({"product_id": 3, "available": True, "price": 2.5, "more": 1}))
    assert tuple(sources.read_availability_feed(spark, str(path)).first()) == (3, True, 2.5)


def purchase_tables(spark, tmp_path):
    names = (jobs.HEADER, jobs.LINES)
    return VersionedTables(
        spark, str(tmp_path / "purchase"), {n: schemas.TABLES[n] for n in names}, range_width=100
    )


def test_purchase_orders_are_saved_whole(spark, tmp_path):
    tables = purchase_tables(spark, tmp_path)
    lines = spark.createDataFrame(
        [(1, 2, 5, 3, 3, 4), (1, 2, 5, 3, 3, 4), (2, 0, 1, 1, 1, 0)],
        "id bigint, closed_qty bigint, target_qty int, suggested_qty bigint, "
        "min_para_alvo bigint, confirmed_qty bigint",
    )
    assert jobs.save_purchase_order(tables, lines, 30, "a", "ana", 0, AS_OF) == 1
    assert jobs.save_purchase_order(tables, lines, 15, "b", "eva", 1, AS_OF) == 2
    below = lines.withColumn("confirmed_qty", F.lit(1).cast("bigint"))
    assert jobs.save_purchase_order(tables, below, 15, "", "eva", 2, AS_OF) is None
    summary = purchasing.purchase_orders_summary(tables.read(jobs.HEADER), tables.read(jobs.LINES))
    got = sorted((r.id, r.status, r.period_days, r.notes, r.total_items, r.total_qty) for r in summary.collect())
    assert got == [(1, "RASCUNHO", 30, "a", 2, 8), (2, "RASCUNHO", 15, "b", 2, 8)]
    items = tables.read(jobs.LINES).collect()
    assert sorted(r.id for r in items) == [1, 2, 3, 4] and {r.notes for r in items} == {None}


def test_small_tables_are_edited_in_versions(spark, tmp_path):
    name = "product_mapping"
    tables = VersionedTables(spark, str(tmp_path / "map"), {name: schemas.TABLES[name]})

    def edit(*rows):
        frame = spark.createDataFrame(
            list(rows), "external_product_id bigint, external_name string, local_product_id bigint"
        )
        return lambda stored: mapping.product_mapping_upsert(stored, frame, AS_OF)

    jobs.edit_table(tables, name, edit((1, "a", 5), (2, "b", None)), 0)
    jobs.edit_table(tables, name, edit((1, "c", None), (3, "d", 1)), 1)
    jobs.edit_table(tables, name, edit((9, "never", 9)), 1)
    got = sorted((r.external_product_id, r.external_name, r.local_product_id) for r in tables.read(name).collect())
    assert got == [(1, "c", None), (2, "b", None), (3, "d", 1)]


def test_items_of_one_order_are_sorted(spark):
    product = spark.createDataFrame(
        [(1, "b", "t"), (2, "a", "t"), (3, None, "t")], "id bigint, description string, product_type string"
    )
    rows = [(7, p, q) for p, q in ((1, None), (1, 2), (2, 2), (3, 2), (2, 9))] + [(8, 1, 1)]
    items = spark.createDataFrame(rows, "order_id bigint, product bigint, confirmed_qty int")
    for name, kind in (("current_stock", "int"), ("min_qty", "int"), ("target_qty", "int"),
                       ("avg_daily_consumption", "double"), ("suggested_qty", "int"),
                       ("supplier_available", "boolean"), ("supplier_price", "double"), ("notes", "string")):
        items = items.withColumn(name, F.lit(None).cast(kind))
    got = [(r.confirmed_qty, r.product_desc) for r in purchasing.purchase_order_items(items, product, 7).collect()]
    assert got == [(9, "a"), (2, "a"), (2, "b"), (2, None), (None, "b")]

    supplied = spark.createDataFrame(
        [(1, 7, "y"), (2, 7, None), (3, 7, "x"), (4, 8, "a")], "id bigint, order_id bigint, external_product_name string"
    )
    for name in ("external_product_id", "external_category", "quantity", "price_unit", "created_at"):
        supplied = supplied.withColumn(name, F.lit(None).cast("string"))
    supplied = supplied.withColumn("local_product_id", F.lit(1).cast("bigint"))
    got = pricing.supplier_order_items(supplied, product, 7).collect()
    assert [r.external_product_name for r in got] == ["x", "y", None]


def test_edits_of_a_ranged_table_keep_its_rows(spark, tmp_path):
    """Rows of several ranges stay once, moved and emptied ranges are retired."""
    name = jobs.HEADER
    tables = VersionedTables(spark, str(tmp_path / "t"), {name: schemas.TABLES[name]}, range_width=2)
    lines = spark.createDataFrame([(1, 5, 5)], "id bigint, suggested_qty int, confirmed_qty bigint")
    both = VersionedTables(
        spark, str(tmp_path / "t"), {n: schemas.TABLES[n] for n in (jobs.HEADER, jobs.LINES)}, range_width=2
    )
    for batch in range(3):
        assert jobs.save_purchase_order(both, lines, 30, "", "ana", batch, AS_OF) == batch + 1
    jobs.edit_table(tables, name, lambda stored: stored, 10)
    assert sorted(r.id for r in tables.read(name).collect()) == [1, 2, 3]
    jobs.edit_table(tables, name, lambda stored: stored.where("id <> 1"), 11)
    assert sorted(r.id for r in tables.read(name).collect()) == [2, 3]
    assert sorted(r.id for r in tables.read(name, [1]).collect()) == [2, 3]
    requests = spark.createDataFrame([(3, "CONFIRMADO"), (9, "ENVIADO")], "order_id bigint, new_status string")
    jobs.apply_order_status(tables, requests, 12)
    jobs.apply_order_status(tables, requests, 12)
    assert {r.id: r.status for r in tables.read(name).collect()} == {2: "RASCUNHO", 3: "CONFIRMADO"}


def test_a_repeated_purchase_order_is_saved_once(spark, tmp_path):
    tables = purchase_tables(spark, tmp_path)
    lines = spark.createDataFrame([(1, 5, 5)], "id bigint, suggested_qty int, confirmed_qty bigint")
    assert jobs.save_purchase_order(tables, lines, 30, "", "ana", 7, AS_OF) == 1
    assert jobs.save_purchase_order(tables, lines, 30, "", "ana", 7, AS_OF) == 1
    assert tables.read(jobs.HEADER).count() == tables.read(jobs.LINES).count() == 1


def test_mapping_sync_is_stored(spark, tmp_path):
    name = jobs.ITEMS
    tables = VersionedTables(spark, str(tmp_path / "t"), {name: schemas.TABLES[name]}, range_width=10)
    rows = spark.createDataFrame([(1, 5, None), (2, 15, None), (3, 25, 9)], "id bigint, external_product_id bigint, local_product_id bigint")
    of_order = tables.range_of(F.col("external_product_id"))
    stored = sources.conform(rows, name).withColumn("key_range", item_range(of_order, F.col("local_product_id")))
    tables.publish({name: stored}, 0)
    known = spark.createDataFrame([(15, 77), (25, 78)], "external_product_id bigint, local_product_id bigint")
    assert jobs.sync_mapping(tables, known, 1) == 1
    assert jobs.sync_mapping(tables, known, 1) == 0
    got = {r.id: r.local_product_id for r in tables.read(name).collect()}
    assert got == {1: None, 2: 77, 3: 9}
    assert tables.ranges(name) == [1, 2, 4]  # the filled item moved; its old range is empty
    assert {r.id for r in tables.read(name, [2]).collect()} == {2}
    opened = mapping.mapping_sync(tables.read(name, [1]), known).inputFiles()
    assert opened and all("key_range=1/" in path for path in opened)
    assert jobs.sync_mapping(tables, known, 2) == 0


def test_edits_of_one_key_are_folded(spark):
    stored = sources.conform(spark.createDataFrame([(1, "a", 5)], "external_product_id bigint, external_name string, local_product_id bigint"), "product_mapping")
    rows = [(1, "b", 6, 1), (1, "c", 7, 2), (2, "d", 1, 2), (2, "e", None, 3)]
    edits = spark.createDataFrame(rows, "external_product_id bigint, external_name string, local_product_id bigint, at int")
    got = mapping.product_mapping_upsert(stored, edits, AS_OF, "at").collect()
    assert sorted((r.external_product_id, r.external_name, r.local_product_id) for r in got) == [(1, "c", 7), (2, "e", None)]
    flags = spark.createDataFrame([(1, True, 1), (1, False, 2), (2, False, 2), (2, True, 3)], "id bigint, excluir_calculos boolean, at int")
    exclude = spark.createDataFrame([(1, "x")], schemas.TABLES["product_exclude"])
    left = products.product_exclude_apply(exclude, flags, arrival="at").collect()
    assert [r.product_id for r in left] == [2]


def test_a_cluster_has_to_name_its_shared_folder(spark):
    class Context:
        master, applicationId = "yarn", "a"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session._local_folder(Context)
    Context.master = "local[2]"
    assert session._local_folder(Context)
