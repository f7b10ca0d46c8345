"""Order merges against the replay, the ingest stream, and the id numbering."""

import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from replay import replay

from larder import schemas
from larder.operators import ingest, merging, order_merge
from larder.sources.documents import (
    concat_load_types,
    read_order_lines,
    read_order_pages,
)
from larder.sources.testdata import order_documents
from larder.sources.versions import RANGE
from larder.streaming import order_ingest

NAMES = {
    "vhsys": "vhsys", "type_of_load": "type_of_load", "piv": "product_invoice_value",
    "pid": "product_invoice_doc", "siv": "service_invoice_value", "sid": "service_invoice_doc",
    "platform_status": "platform_status", "total": "total", "store_id": "store_id",
    "franchise_tax": "franchise_tax", "platform_order_id": "platform_order_id",
}
AS_OF = "2024-01-01 00:00:00"


def maybe(rng, make):
    return None if rng.random() < 0.4 else make()


def random_delivery(rng, arrival, keys):
    money = lambda: Decimal(rng.randrange(1, 9999)) / 100
    return {
        "arrival": arrival, "platform_order_id": rng.choice(keys), "store_id": maybe(rng, lambda: rng.randrange(9)),
        "platform_status": maybe(rng, lambda: rng.randrange(8)), "total": maybe(rng, money),
        "franchise_tax": maybe(rng, money), "vhsys": maybe(rng, lambda: rng.randrange(99)),
        "type_of_load": maybe(rng, lambda: rng.randrange(2)), "piv": maybe(rng, money),
        "pid": maybe(rng, lambda: f"P{arrival}"), "siv": maybe(rng, money),
        "sid": maybe(rng, lambda: f"S{arrival}"),
        "items": [
            {
                "platform_item_id": maybe(rng, lambda: rng.randrange(3)),
                "external_product_id": rng.randrange(50),
                "nfe_bling_id": maybe(rng, lambda: rng.randrange(1000)),
                "sale_order_bling_id": maybe(rng, lambda: rng.randrange(1000)),
            }
            for _ in range(rng.choice([0, 1, 1, 2, 4]))
        ],
    }


HEADER = ("arrival bigint, platform_order_id bigint, store_id bigint, platform_status int, "
          "total decimal(12,2), franchise_tax decimal(12,2), vhsys bigint, type_of_load int, "
          "product_invoice_value decimal(12,2), product_invoice_doc string, "
          "service_invoice_value decimal(12,2), service_invoice_doc string")
ITEM = ("arrival bigint, part int, pos int, platform_order_id bigint, platform_item_id bigint, "
        "external_product_id bigint, external_product_name string, external_category string, "
        "quantity decimal(10,3), price_unit decimal(10,2), created_at timestamp_ntz, "
        "nfe_bling_id bigint, sale_order_bling_id bigint")


def frames(spark, deliveries):
    headers = [
        (d["arrival"], d["platform_order_id"], d["store_id"], d["platform_status"], d["total"],
         d["franchise_tax"], d["vhsys"], d["type_of_load"], d["piv"], d["pid"], d["siv"], d["sid"])
        for d in deliveries
    ]
    items = [
        (d["arrival"], 0, pos, d["platform_order_id"], i["platform_item_id"], i["external_product_id"],
         "n", "c", None, None, None, i["nfe_bling_id"], i["sale_order_bling_id"])
        for d in deliveries for pos, i in enumerate(d["items"])
    ]
    return spark.createDataFrame(headers, HEADER), spark.createDataFrame(items, ITEM)


def order_set(rows):
    return sorted(
        (tuple((k, r[k]) for k in sorted(NAMES)) for r in rows), key=lambda row: str(row)
    )


def item_set(rows):
    names = ("platform_order_id", "platform_item_id", "external_product_id", "nfe_bling_id", "sale_order_bling_id")
    return sorted((tuple(r[n] for n in names) for r in rows), key=str)


@pytest.mark.parametrize("update", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_merge_equals_replay(spark, seed, update):
    rng = random.Random(seed)
    orders = spark.createDataFrame([], schemas.TABLES["supplier_order"])
    items = spark.createDataFrame([], schemas.TABLES["supplier_order_item"])
    model_orders, model_items = {}, []
    for batch in range(2):
        deliveries = [random_delivery(rng, 100 * batch + i, range(1 + 5 * batch, 13 + 5 * batch)) for i in range(40)]
        headers, lines = frames(spark, deliveries)
        counts = replay(model_orders, model_items, deliveries, update)
        assert order_merge.order_load_metrics(orders, headers, update).first().asDict() == counts
        resolved = order_merge.resolve_orders(orders, headers, update)
        merged = order_merge.merge_orders(orders, resolved, update, AS_OF)
        merged_items = order_merge.merge_order_items(items, resolved, lines, update)
        orders = spark.createDataFrame(merged.drop("action").collect(), orders.schema)
        items = spark.createDataFrame(merged_items.drop("action").collect(), items.schema)
    got = [{k: r[NAMES[k]] for k in NAMES} for r in orders.collect()]
    assert order_set(got) == order_set(model_orders.values())
    keys = {r.id: r.platform_order_id for r in orders.collect()}
    assert sorted(keys) == list(range(1, len(keys) + 1))
    got = [{**r.asDict(), "platform_order_id": keys[r.order_id]} for r in items.collect()]
    assert item_set(got) == item_set(model_items)


def test_ids_are_dense_and_repeatable(spark):
    rows = spark.range(5000).select((F.col("id") * 1009 + 3).alias("key"))
    numbered = merging.assign_ids(rows, F.lit(10), F.col("key"))
    first = {r.key: r.id for r in numbered.collect()}
    assert sorted(first.values()) == list(range(11, 5011))
    again = merging.assign_ids(rows.repartition(3), F.lit(10), F.col("key"))
    assert {r.key: r.id for r in again.collect()} == first


def test_last_change_per_key(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 3), (1, "c", 2), (2, "d", 1)], "k int, v string, at int")
    got = {r.k: r.v for r in merging.last_per_key(rows, ["k"], "at").collect()}
    assert got == {1: "b", 2: "d"}


def as_document(delivery):
    invoices = []
    if delivery["piv"] is not None or delivery["pid"] is not None:
        invoices.append({"f2_chvnfe": "1" * 44, "f2_valfat": delivery["piv"] and str(delivery["piv"]),
                         "f2_doc": delivery["pid"]})
    if delivery["siv"] is not None or delivery["sid"] is not None:
        invoices.append({"f2_chvnfe": None, "f2_valfat": delivery["siv"] and float(delivery["siv"]),
                         "f2_doc": delivery["sid"]})
    return {
        "id": delivery["platform_order_id"], "store_id": delivery["store_id"],
        "status": delivery["platform_status"], "type_of_load": delivery["type_of_load"],
        "vhsys": delivery["vhsys"],
        "total": None if delivery["total"] is None else str(delivery["total"]).replace(".", ","),
        "franchise_tax": None if delivery["franchise_tax"] is None else float(delivery["franchise_tax"]),
        "invoices": invoices,
        "orderItems": [
            {"id": i["platform_item_id"], "product_id": i["external_product_id"], "quantity": 1,
             "nfe_bling_id": i["nfe_bling_id"], "sale_order_bling_id": i["sale_order_bling_id"]}
            for i in delivery["items"]
        ],
    }


def write_lines(path, deliveries):
    path.write_text("\n".join(json.dumps(as_document(d)) for d in deliveries))


def state(tables):
    orders = tables.read(order_ingest.ORDERS).collect()
    keys = {r.id: r.platform_order_id for r in orders}
    items = [r.asDict() for r in tables.read(order_ingest.ITEMS).collect()]
    assert len({i["id"] for i in items}) == len(items) and all(i["id"] for i in items)
    for item in items:
        item["platform_order_id"] = keys[item["order_id"]]
    return [{k: r[NAMES[k]] for k in NAMES} for r in orders], items


def test_ingest_stream_equals_replay(spark, tmp_path):
    rng = random.Random(7)
    landing, root = tmp_path / "landing", str(tmp_path / "tables")
    landing.mkdir()
    model_orders, model_items = {}, []
    tables = order_ingest.order_tables(spark, root, range_width=5)

    def run():
        order_ingest.start_order_ingest(
            spark, str(landing), root, True, AS_OF, range_width=5
        ).awaitTermination()

    for step in range(2):
        deliveries = [random_delivery(rng, 1000 * step + i, range(1, 14 + 6 * step)) for i in range(30)]
        for name, part in (("a", deliveries[:12]), ("b", deliveries[12:])):
            write_lines(landing / f"{step}-{name}.json", part)
        replay(model_orders, model_items, deliveries, True)
        run()
        orders, items = state(tables)
        assert order_set(orders) == order_set(model_orders.values())
        assert item_set(items) == item_set(model_items)

    versions = tables.log().count()
    run()
    assert tables.log().count() == versions


def test_repeated_and_broken_off_batches(spark, tmp_path):
    rng = random.Random(3)
    lines = tmp_path / "lines.json"
    deliveries = [random_delivery(rng, i, [1, 2, 30]) for i in range(12)]
    write_lines(lines, deliveries)
    tables = order_ingest.order_tables(spark, str(tmp_path / "tables"), range_width=10)
    docs = read_order_lines(spark, str(lines))
    # A writer that died before its log entry leaves files that nobody reads.
    spark.range(3).select("id", F.lit(0).alias(RANGE)).write.partitionBy(RANGE).parquet(
        f"{tables.root}/{order_ingest.ORDERS}/version=1"
    )
    assert tables.read(order_ingest.ORDERS).count() == 0
    order_ingest.merge_batch(tables, docs, 0)
    before = state(tables)
    order_ingest.merge_batch(tables, docs, 0)
    assert state(tables) == before
    model_orders, model_items = {}, []
    replay(model_orders, model_items, deliveries, False)
    assert order_set(before[0]) == order_set(model_orders.values())
    assert item_set(before[1]) == item_set(model_items)


def test_only_touched_ranges_are_rewritten(spark, tmp_path):
    tables = order_ingest.order_tables(spark, str(tmp_path / "tables"), range_width=10)
    rng = random.Random(5)
    for batch, keys in enumerate(([1, 15], [16])):
        lines = tmp_path / f"{batch}.json"
        write_lines(lines, [random_delivery(rng, batch * 10 + i, keys) for i in range(6)])
        order_ingest.merge_batch(tables, read_order_lines(spark, str(lines)), batch)
    log = tables.log().where(F.col("table_name") == order_ingest.ORDERS).collect()
    assert sorted((r.version, r[RANGE]) for r in log) == [(1, 0), (1, 1), (2, 1)]
    assert tables.read(order_ingest.ORDERS).count() == 3


def test_pages_and_load_types(spark, tmp_path):
    rng = random.Random(1)
    for name, keys in (("cold", [1, 2]), ("dry", [2, 3])):
        (tmp_path / name).mkdir()
        for page in range(2):
            body = {"content": [as_document(random_delivery(rng, i, keys)) for i in range(3)], "totalPages": 2}
            (tmp_path / name / f"page-{page}.json").write_text(json.dumps(body, indent=1))
    both = concat_load_types(
        read_order_pages(spark, str(tmp_path / "cold")), read_order_pages(spark, str(tmp_path / "dry"))
    )
    rows = both.orderBy("arrival").collect()
    assert len(rows) == 12 and len({r.arrival for r in rows}) == 12
    assert {r.id for r in rows[:6]} <= {1, 2} and {r.id for r in rows[6:]} <= {2, 3}


def test_broken_documents_stop_the_import(spark, tmp_path):
    lines = tmp_path / "lines.json"
    lines.write_text('{"id": 1, "total": 5}\n{"id": 2, "orderItems": [')
    tables = order_ingest.order_tables(spark, str(tmp_path / "tables"))
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|FAILED_READ_FILE"):
        order_ingest.merge_batch(tables, read_order_lines(spark, str(lines)), 0)
    assert tables.read(order_ingest.ORDERS).count() == 0


def test_numbers_and_text_amounts(spark, tmp_path):
    lines = tmp_path / "lines.json"
    lines.write_text('{"id": 1, "total": 12.5, "franchise_tax": "1,25", "unknown": {"a": 1}}')
    tables = order_ingest.order_tables(spark, str(tmp_path / "tables"))
    order_ingest.merge_batch(tables, read_order_lines(spark, str(lines)), 0)
    row = tables.read(order_ingest.ORDERS).first()
    assert (row.total, row.franchise_tax) == (Decimal("12.50"), Decimal("1.25"))


def test_parts_of_a_delivery_may_land_apart(spark, tmp_path):
    """Three items a part in two files, read a file at a time; the header lands last."""
    landing = tmp_path / "landing"
    landing.mkdir()
    for number, part in enumerate((1, 2, 0)):
        items = [{"id": 10 * part + i, "product_id": i, "quantity": 1} for i in range(3)] if part else []
        line = {"id": 4, "status": 1, "orderItems": items, "delivery": 9, "part": part, "parts": 3}
        (landing / f"{number}.json").write_text(json.dumps(line))
    root = str(tmp_path / "tables")
    order_ingest.start_order_ingest(spark, str(landing), root, files_per_trigger=1).awaitTermination()
    orders, items = state(order_ingest.order_tables(spark, root))
    assert len(orders) == 1 and len(items) == 6


def test_items_match_their_headers_however_files_are_cut(spark, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    for number in range(6):
        lines = [{"id": 100 * number + i + 1, "orderItems": [{"id": 1, "product_id": 2, "quantity": 1}]} for i in range(20)]
        (folder / f"{number}.json").write_text("\n".join(map(json.dumps, lines)))
    spark.conf.set("spark.sql.files.minPartitionNum", "2")
    try:
        docs = read_order_lines(spark, str(folder))
        headers = ingest.normalize_order_headers(docs).collect()
        spark.conf.set("spark.sql.files.minPartitionNum", "12")
        items = ingest.normalize_order_items(docs).collect()
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert len({r.arrival for r in headers} & {r.arrival for r in items}) == 120


def test_an_order_of_equal_lines_keeps_its_header(spark):
    header = spark.createDataFrame([(1, 1, 5)], "arrival bigint, src_key bigint, id bigint")
    for name in ("store_id", "status", "type_of_load", "vhsys"):
        header = header.withColumn(name, F.lit(1))
    header = header.withColumn("total", F.lit("1,5")).withColumn("franchise_tax", F.lit("1"))
    names = "id bigint, product_id bigint, line_source bigint, nfe_bling_id bigint, sale_order_bling_id bigint"
    items = spark.createDataFrame([(1, 7, 7, 1, 1)] * 1500, names).withColumn("src_key", F.lit(1).cast("bigint"))
    for name in ("quantity", "price_unit", "created_at", "product_name", "category_name"):
        items = items.withColumn(name, F.lit("1"))
    invoices = spark.createDataFrame([], "arrival bigint, pos int, f2_chvnfe string, f2_valfat string, f2_doc string")
    docs = order_documents(header, invoices, items)
    assert ingest.normalize_order_headers(docs).count() == 1
    assert ingest.normalize_order_items(docs).count() == 1500


def test_a_merge_returns_its_counts(spark, tmp_path):
    lines = tmp_path / "lines.json"
    lines.write_text('{"id": 1}\n{"id": 2}\n{"id": 1}')
    tables = order_ingest.order_tables(spark, str(tmp_path / "tables"))
    docs = read_order_lines(spark, str(lines))
    assert order_ingest.merge_batch(tables, docs, 0, True) == {"inserted": 2, "updated": 1, "skipped": 0}
    assert order_ingest.merge_batch(tables, docs, 0, True) == {"inserted": 0, "updated": 0, "skipped": 0}
