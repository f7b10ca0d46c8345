"""Every report by name, over the tables of a test-data folder.

A plan is lazy: nothing runs until the caller acts on the result. The exceptions are
the order merges and purchase orders, which store what they use several times, and the
streams, which run to the end of their input. Decimals leave as doubles and ratios are rounded, so that two engines can be compared value by value.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions import asc, desc, moment_label
from larder.functions.texts import DAY_SHOWN
from larder.operators import (
    changes,
    constraints,
    consumption,
    ingest,
    mapping,
    merging,
    order_merge,
    pricing,
    products,
    purchasing,
    replenishment,
    settings,
    stock,
    totals,
)
from larder.plans import jobs
from larder.session import discard, releasing, shared_folder, staged
from larder.sources import buckets
from larder.sources import tables as sources
from larder.sources.testdata import (
    CONSUMPTION_AS_OF,
    PLATFORM_AS_OF,
    PRODUCTS_PER_PART,
    RANGE_END,
    RANGE_START,
    TestTables,
    order_documents,
)
from larder.sources.versions import RANGE, VersionedTables
from larder.streaming import order_ingest, weekly_consumption, weekly_windows

Plan = Callable[[TestTables], DataFrame]
REPORTS: dict[str, Plan] = {}

DAYS = 30
SEARCH = "RING.*#1"
NUMBER_PREFIX = "12"


def report(plan: Plan) -> Plan:
    REPORTS[plan.__name__] = plan
    return plan


def plain(df: DataFrame, digits: int | None = None) -> DataFrame:
    """Decimals as doubles; with ``digits``, the doubles among the columns rounded.

    Sums of doubles differ in their last bits with the order of the rows. The small
    addend keeps exact ties from being rounded either way.
    """

    def value(field: T.StructField):
        if isinstance(field.dataType, T.DecimalType):
            return F.col(field.name).cast("double").alias(field.name)
        if isinstance(field.dataType, T.DoubleType) and digits is not None:
            return F.round(F.col(field.name) + F.lit(1e-9), digits).alias(field.name)
        return F.col(field.name)

    return df.select(*[value(field) for field in df.schema.fields])


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return REPORTS[name](TestTables(spark, sf_dir))


# Stock and consumption


@report
def empty_positions_count(t: TestTables) -> DataFrame:
    return stock.empty_positions_count(t.freezer_position, t.product, t.status)


def _stock(t: TestTables) -> DataFrame:
    return stock.current_stock(
        t.freezer_position, t.product, t.freezer, t.status, t.product_exclude
    )


@report
def current_stock(t: TestTables) -> DataFrame:
    return _stock(t).orderBy(asc("product_desc"), asc("freezer_name"))


@report
def stock_metrics(t: TestTables) -> DataFrame:
    return stock.stock_metrics(_stock(t), SEARCH)


def _used(t: TestTables) -> DataFrame:
    return consumption.consumption_summary(
        t.freezer_position_history, t.product, t.product_exclude, DAYS, CONSUMPTION_AS_OF
    )


def _weekly(t: TestTables) -> DataFrame:
    return consumption.consumption_weekly(
        t.freezer_position_history, t.product, t.product_exclude, DAYS, CONSUMPTION_AS_OF
    )


@report
def consumption_summary(t: TestTables) -> DataFrame:
    return plain(_used(t)).orderBy(desc("total_consumed"))


@report
def consumption_weekly(t: TestTables) -> DataFrame:
    return _weekly(t).orderBy(asc("week"), asc("product_desc"))


@report
def consumption_total(t: TestTables) -> DataFrame:
    return consumption.consumption_total(_used(t))


@report
def top_consumed(t: TestTables) -> DataFrame:
    return plain(consumption.top_consumed(_used(t)))


@report
def top_products_weekly(t: TestTables) -> DataFrame:
    return consumption.top_products_weekly(_weekly(t), _used(t)).orderBy(
        asc("week"), asc("product_desc")
    )


# Settings and products


@report
def stock_minimum_config(t: TestTables) -> DataFrame:
    return stock.stock_minimum_config(t.product, t.freezer_position, t.stock_minimum).orderBy(
        asc("product_desc")
    )


@report
def stock_minimum_validate(t: TestTables) -> DataFrame:
    return settings.stock_minimum_validate(t.stock_minimum_edit)


@report
def stock_minimum_upsert(t: TestTables) -> DataFrame:
    return settings.stock_minimum_upsert(t.stock_minimum, t.stock_minimum_edit, CONSUMPTION_AS_OF)


def _config(t: TestTables) -> DataFrame:
    return products.products_config(
        t.product, t.freezer_position, t.status, t.product_exclude, t.freezer_position_history
    )


@report
def products_config(t: TestTables) -> DataFrame:
    return _config(t).orderBy(asc("product_desc"))


@report
def products_metrics(t: TestTables) -> DataFrame:
    return products.products_metrics(_config(t))


@report
def products_filtered(t: TestTables) -> DataFrame:
    return products.products_filtered(_config(t), SEARCH, "Apenas ativos").orderBy(
        asc("product_desc")
    )


@report
def products_filtered_excluded(t: TestTables) -> DataFrame:
    return products.products_filtered(_config(t), None, "Excluidos de calculos").orderBy(
        asc("product_desc")
    )


def _flags_diff(t: TestTables) -> DataFrame:
    return products.product_flags_diff(_config(t), t.product_flag_edit)


@report
def product_flags_diff(t: TestTables) -> DataFrame:
    return _flags_diff(t)


@report
def product_flags_counts(t: TestTables) -> DataFrame:
    return products.product_flags_counts(_flags_diff(t))


@report
def product_status_update(t: TestTables) -> DataFrame:
    return products.product_status_update(t.product, t.product_flag_edit)


@report
def product_exclude_apply(t: TestTables) -> DataFrame:
    return products.product_exclude_apply(t.product_exclude, t.product_flag_edit)


@report
def product_insert(t: TestTables) -> DataFrame:
    return products.product_insert(t.product, t.product_new)


@report
def product_insert_exclusions(t: TestTables) -> DataFrame:
    return products.exclusions_of_new(products.product_insert(t.product, t.product_new))


# Replenishment and purchase orders


def _suggestions(t: TestTables, include_no_position: bool = False) -> DataFrame:
    return replenishment.order_suggestions(
        t.product,
        t.freezer_position,
        t.status,
        t.freezer_position_history,
        t.product_exclude,
        t.stock_minimum,
        t.product_mapping,
        t.supplier_order_item,
        days=DAYS,
        include_no_position=include_no_position,
        as_of=CONSUMPTION_AS_OF,
        platform_as_of=PLATFORM_AS_OF,
    )


def _worklist(t: TestTables) -> DataFrame:
    return replenishment.order_worklist(_suggestions(t))


def _edited(t: TestTables) -> DataFrame:
    return replenishment.edit_worklist(_worklist(t), t.order_edit)


def _offered(t: TestTables) -> DataFrame:
    worklist = staged(_worklist(t), "worklist")
    return replenishment.supplier_availability_join(worklist, t.supplier_availability)


@report
def order_suggestions(t: TestTables) -> DataFrame:
    return plain(_suggestions(t)).orderBy(desc("suggested_qty"), asc("local_desc"))


@report
def order_suggestions_all(t: TestTables) -> DataFrame:
    return plain(_suggestions(t, include_no_position=True)).orderBy(
        desc("suggested_qty"), asc("local_desc")
    )


@report
def order_worklist(t: TestTables) -> DataFrame:
    return plain(_worklist(t)).orderBy(desc("suggested_qty"), asc("local_desc"))


@report
def suggestion_metrics(t: TestTables) -> DataFrame:
    return replenishment.suggestion_metrics(_suggestions(t))


@report
def supplier_availability_join(t: TestTables) -> DataFrame:
    return plain(_offered(t)).orderBy(desc("suggested_qty"), asc("local_desc"))


@report
def supplier_availability_counts(t: TestTables) -> DataFrame:
    return replenishment.supplier_availability_counts(_offered(t))


@report
def order_below_target(t: TestTables) -> DataFrame:
    return plain(replenishment.order_below_target(_edited(t))).orderBy(asc("local_desc"))


@report
def purchase_order_build(t: TestTables) -> DataFrame:
    return plain(
        replenishment.purchase_order_build(
            staged(_offered(t), "offered"),
            merging.highest_id(t.purchase_order),
            DAYS,
            " weekly order ",
            " ana ",
            CONSUMPTION_AS_OF,
        )
    )


def _purchase_summary(t: TestTables, status: str | None = None) -> DataFrame:
    return purchasing.purchase_orders_summary(t.purchase_order, t.purchase_order_item, status)


@report
def purchase_orders_summary(t: TestTables) -> DataFrame:
    return _purchase_summary(t).orderBy(desc("order_date"))


@report
def purchase_orders_summary_drafts(t: TestTables) -> DataFrame:
    return _purchase_summary(t, purchasing.DRAFT).orderBy(desc("order_date"))


@report
def purchase_order_metrics(t: TestTables) -> DataFrame:
    return purchasing.purchase_order_metrics(_purchase_summary(t))


@report
def purchase_order_items(t: TestTables) -> DataFrame:
    return plain(purchasing.purchase_order_items(t.purchase_order_item, t.product))


@report
def order_status_apply(t: TestTables) -> DataFrame:
    return purchasing.order_status_apply(t.purchase_order, t.order_status_request)


@report
def order_status_rejected(t: TestTables) -> DataFrame:
    return purchasing.order_status_rejected(t.purchase_order, t.order_status_request)


# Supplier orders: documents and merges


@report
def flatten_platform_orders(t: TestTables) -> DataFrame:
    return ingest.flatten_platform_orders(t.documents)


@report
def extract_products(t: TestTables) -> DataFrame:
    return ingest.extract_products(t.documents)


@report
def classify_invoices(t: TestTables) -> DataFrame:
    return plain(
        ingest.classify_invoices(t.documents).select(
            "arrival", "id", "product_invoice_value", "product_invoice_doc",
            "service_invoice_value", "service_invoice_doc",
        )
    )


def _headers(t: TestTables) -> DataFrame:
    return ingest.normalize_order_headers(t.documents)


@report
def normalize_order_headers(t: TestTables) -> DataFrame:
    return plain(_headers(t))


@report
def normalize_order_items(t: TestTables) -> DataFrame:
    return plain(ingest.normalize_order_items(t.documents))


# The batch is used by several merges, so it is staged once it is typed and resolved.


def _resolved(t: TestTables, update_existing: bool, headers: DataFrame) -> DataFrame:
    headers = staged(headers, "headers")
    resolved = staged(order_merge.resolve_orders(t.supplier_order, headers, update_existing), "resolved")
    discard(headers)
    return resolved


def _merged_orders(t: TestTables, update_existing: bool) -> DataFrame:
    headers = ingest.normalize_order_headers(t.documents.where("part = 0"))
    return order_merge.merge_orders(
        t.supplier_order, _resolved(t, update_existing, headers), update_existing, PLATFORM_AS_OF
    )


def _merged_items(t: TestTables, update_existing: bool) -> DataFrame:
    typed = staged(ingest.type_documents(t.documents), "typed")
    resolved = _resolved(t, update_existing, ingest.headers_of(typed))
    placed = staged(order_merge.placed_items(resolved, ingest.items_of(typed), update_existing), "placed")
    discard(typed, resolved)
    return order_merge.merge_order_items(
        t.supplier_order_item, resolved, order_merge.settled(placed), update_existing, after_id=F.lit(0)
    )


@report
def merge_orders_insert_only(t: TestTables) -> DataFrame:
    return plain(_merged_orders(t, False))


@report
def merge_orders_update(t: TestTables) -> DataFrame:
    return plain(_merged_orders(t, True))


@report
def merge_order_items(t: TestTables) -> DataFrame:
    return plain(_merged_items(t, True))


@report
def merge_order_items_insert_only(t: TestTables) -> DataFrame:
    return plain(_merged_items(t, False))


@report
def order_load_metrics(t: TestTables) -> DataFrame:
    headers = _headers(t)
    counts = order_merge.order_load_metrics(t.supplier_order, headers, update_existing=True)
    return counts.select(
        F.expr("stack(2, 'insert', inserted, skipped, updated, 'update', inserted, updated, skipped)").alias(
            "mode", "inserted", "updated", "skipped"
        )
    )


@report
def order_load_observed(t: TestTables) -> DataFrame:
    """The same counts, taken while the resolved orders of either mode are written."""
    headers = staged(_headers(t), "headers")
    rows = []
    for mode, update in (("insert", False), ("update", True)):
        seen = Observation("load")
        staged(order_merge.observed_load(order_merge.resolve_orders(t.supplier_order, headers, update), seen), "resolved")
        counts = order_merge.load_counts(seen, update)
        rows.append((mode, counts["inserted"], counts["updated"], counts["skipped"]))
    return t.spark.createDataFrame(rows, "mode string, inserted bigint, updated bigint, skipped bigint")


# Product mapping


@report
def product_mapping_list(t: TestTables) -> DataFrame:
    return mapping.product_mapping_list(t.product_mapping, t.product).orderBy(asc("external_name"))


@report
def product_mapping_upsert(t: TestTables) -> DataFrame:
    return mapping.product_mapping_upsert(
        t.product_mapping, t.product_mapping_edit, PLATFORM_AS_OF
    )


def _synced(t: TestTables) -> DataFrame:
    return mapping.mapping_sync(t.supplier_order_item, t.product_mapping)


@report
def mapping_sync(t: TestTables) -> DataFrame:
    return plain(_synced(t))


@report
def mapping_sync_count(t: TestTables) -> DataFrame:
    return mapping.mapping_sync_count(_synced(t))


@report
def local_products(t: TestTables) -> DataFrame:
    return mapping.local_products(t.product).orderBy(asc("status"), asc("description"))


@report
def unmapped_products(t: TestTables) -> DataFrame:
    return mapping.unmapped_products(t.supplier_order_item, t.product_mapping).orderBy(
        asc("external_product_name")
    )


# Supplier orders: costs, prices, frequency


def _summary(t: TestTables, type_of_load: int | None = None) -> DataFrame:
    return pricing.supplier_orders_summary(
        t.supplier_order, t.supplier_order_item, type_of_load
    )


def _newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("order_date").desc_nulls_last(), desc("loaded_at"))


@report
def supplier_orders_summary(t: TestTables) -> DataFrame:
    return _newest_first(plain(_summary(t)))


@report
def supplier_orders_summary_dry(t: TestTables) -> DataFrame:
    return _newest_first(plain(_summary(t, type_of_load=1)))


@report
def supplier_orders_filtered(t: TestTables) -> DataFrame:
    return _newest_first(
        plain(
            pricing.supplier_orders_filtered(_summary(t), RANGE_START, RANGE_END, NUMBER_PREFIX)
        )
    )


@report
def supplier_order_costs(t: TestTables) -> DataFrame:
    return _newest_first(plain(pricing.supplier_order_costs(_summary(t))))


@report
def supplier_order_items(t: TestTables) -> DataFrame:
    return plain(pricing.supplier_order_items(t.supplier_order_item, t.product))


@report
def supplier_order_item_costs(t: TestTables) -> DataFrame:
    items = pricing.supplier_order_items(t.supplier_order_item, t.product)
    return plain(pricing.supplier_order_item_costs(items, _summary(t)))


def _priced(t: TestTables) -> DataFrame:
    return pricing.price_items(
        t.supplier_order_item, t.supplier_order, t.product, RANGE_START, RANGE_END
    )


def _averages(t: TestTables) -> DataFrame:
    return pricing.price_average(_priced(t))


def _averages_shown(t: TestTables) -> DataFrame:
    return pricing.price_average_filtered(_averages(t), tipo="Gelado", search=SEARCH)


@report
def price_items(t: TestTables) -> DataFrame:
    return plain(_priced(t)).orderBy(asc("product_desc"))


@report
def price_average(t: TestTables) -> DataFrame:
    return plain(_averages(t), digits=4).orderBy(asc("produto"))


@report
def price_average_filtered(t: TestTables) -> DataFrame:
    return plain(_averages_shown(t), digits=4).orderBy(asc("produto"))


@report
def price_average_by_category(t: TestTables) -> DataFrame:
    return plain(pricing.price_average_by_category(_averages_shown(t)), digits=4).orderBy(
        asc("categoria")
    )


def _frequency(t: TestTables) -> DataFrame:
    return pricing.item_frequency(
        t.supplier_order_item, t.supplier_order, t.product, RANGE_START, RANGE_END
    )


@report
def item_frequency(t: TestTables) -> DataFrame:
    return plain(_frequency(t)).orderBy(desc("num_pedidos"), desc("qty_total"))


@report
def item_frequency_pct(t: TestTables) -> DataFrame:
    return plain(pricing.item_frequency_pct(_frequency(t))).orderBy(
        desc("num_pedidos"), desc("qty_total")
    )


@report
def item_frequency_filtered(t: TestTables) -> DataFrame:
    return plain(
        pricing.item_frequency_filtered(
            pricing.item_frequency_pct(_frequency(t)), "Desconhecido", "Sorvetes", SEARCH
        )
    ).orderBy(desc("num_pedidos"), desc("qty_total"))


@report
def filter_options(t: TestTables) -> DataFrame:
    cold = F.when(F.col("tipo") == "Gelado", F.col("categoria"))
    prices = {"price_type": F.col("tipo"), "price_category": cold}
    counts = {"frequency_type": F.col("tipo"), "frequency_category": F.col("categoria")}
    options = pricing.filter_options(_averages(t), prices).unionByName(
        pricing.filter_options(pricing.item_frequency_pct(_frequency(t)), counts)
    )
    return options.orderBy(asc("filter"), asc("value"))


# The same over tables stored for it: in buckets, by month, as totals, bitmaps and versions


BUCKETS = 16


def _bucketed(t: TestTables) -> tuple[DataFrame, DataFrame]:
    """Orders and items in buckets of the order's id."""
    folder = _folder(t, "buckets")
    orders = buckets.store_bucketed(t.supplier_order, f"{folder}/orders", "id", BUCKETS)
    return orders, buckets.store_bucketed(t.supplier_order_item, f"{folder}/items", "order_id", BUCKETS)


@report
def supplier_orders_summary_bucketed(t: TestTables) -> DataFrame:
    return plain(pricing.supplier_orders_summary(*_bucketed(t)))


@report
def supplier_order_item_costs_bucketed(t: TestTables) -> DataFrame:
    orders, items = _bucketed(t)
    rows = pricing.supplier_order_items(items, t.product)
    return plain(pricing.supplier_order_item_costs(rows, pricing.supplier_orders_summary(orders, items)))


@report
def price_items_bucketed(t: TestTables) -> DataFrame:
    orders, items = _bucketed(t)
    return plain(pricing.price_items(items, orders, t.product, RANGE_START, RANGE_END))


def _numbered_items(t: TestTables) -> DataFrame:
    """The items with a number for an id, as stored tables have."""
    return t.supplier_order_item.withColumn("id", F.xxhash64("id"))


@report
def item_frequency_by_month(t: TestTables) -> DataFrame:
    folder = _folder(t, "months")
    sources.append_items(_numbered_items(t), folder)
    items = sources.read_items(t.spark, folder, RANGE_START, RANGE_END)
    return plain(pricing.item_frequency(items, t.supplier_order, t.product, RANGE_START, RANGE_END))


@report
def category_order_counts(t: TestTables) -> DataFrame:
    """Distinct orders per category and load type; the range ends in mid-month."""
    bitmaps = staged(totals.monthly_order_bitmaps(t.supplier_order_item, t.supplier_order), "bitmaps")
    return totals.category_order_counts(
        bitmaps, t.supplier_order_item, t.supplier_order, RANGE_START, "2000-12-17"
    )


def _stored_items(t: TestTables) -> VersionedTables:
    """All items in versioned tables, with the totals of their orders, in three batches."""
    tables = order_ingest.order_tables(t.spark, _folder(t, "items"))
    of_order = tables.range_of(F.col("order_id"))
    numbered = staged(sources.conform(_numbered_items(t), order_ingest.ITEMS), "numbered")
    for batch in range(3):
        items = numbered.where(F.pmod("order_id", F.lit(3)) == batch)
        filed = items.withColumn(RANGE, order_ingest.item_range(of_order, F.col("local_product_id")))
        added = totals.order_totals(items.withColumn(RANGE, of_order), RANGE)
        stored = tables.read(order_ingest.ITEMS)
        sums = totals.add_totals(tables.read(order_ingest.TOTALS), added, RANGE)
        tables.publish({order_ingest.ITEMS: filed, order_ingest.TOTALS: sums}, batch, kept={order_ingest.ITEMS: stored})
    jobs.sync_mapping(tables, t.product_mapping, 3)
    return tables


@report
def mapping_sync_stored(t: TestTables) -> DataFrame:
    """The stored items after a sync that opens only items without a local product."""
    kept = [name for name in t.supplier_order_item.columns if name != "id"]
    return plain(_stored_items(t).read(order_ingest.ITEMS).select(*kept))


@report
def supplier_orders_summary_stored(t: TestTables) -> DataFrame:
    """The summary from totals that three batches and a sync have changed by deltas."""
    stored = totals.shown_totals(_stored_items(t).read(order_ingest.TOTALS).drop(RANGE))
    return plain(pricing.orders_with_totals(t.supplier_order, stored))


@report
def product_changes(t: TestTables) -> DataFrame:
    """Every field that status edits and new products have changed, and removed products."""
    edited = products.product_status_update(t.product, t.product_flag_edit).where("id % 13 <> 5")
    new = products.product_insert(t.product, t.product_new)
    names = ["id", "description", "product_type", "status"]
    after = edited.select(*names).unionByName(new.select(*names))
    return changes.field_changes(changes.changed_rows(t.product.select(*names), after, ["id"]), ["id"])


@report
def purchase_orders_display(t: TestTables) -> DataFrame:
    return t.purchase_order.select("id", moment_label(F.col("order_date")).alias("order_date"))


@report
def supplier_orders_display(t: TestTables) -> DataFrame:
    return _summary(t).select("id", moment_label(F.col("order_date"), DAY_SHOWN).alias("order_date"))


# Streams: each runs to the end of its input in a folder of its own, then reads the state


def _folder(t: TestTables, name: str) -> str:
    return f"{shared_folder(t.spark)}/larder/{name}-{uuid.uuid4().hex}"


def _numbered_documents(t: TestTables) -> DataFrame:
    """The documents with their delivery's number and how many parts it has."""
    parts = t.raw_order_item.select("src_key", F.expr(f"product_id div {PRODUCTS_PER_PART}").alias("p"))
    counted = parts.repartition("src_key").groupBy("src_key").agg((F.count_distinct("p") + 1).cast("int").alias("n"))
    numbered = t.raw_order_header.where("arrival IS NOT NULL").join(counted, "src_key", "left")
    headers = numbered.withColumn("parts", F.coalesce("n", F.lit(1))).drop("n")
    documents = order_documents(headers, t.raw_order_invoice, t.raw_order_item, "parts")
    return documents.withColumnRenamed("arrival", "delivery")


@report
def stream_order_ingest(t: TestTables) -> DataFrame:
    """Orders and their items after the documents, landed as JSON, were ingested."""
    folder = _folder(t, "order-ingest")
    with releasing(t.spark):
        _numbered_documents(t).write.json(f"{folder}/landing", compression="gzip")
    order_ingest.start_order_ingest(
        t.spark, f"{folder}/landing", folder, update_existing=True, as_of=PLATFORM_AS_OF
    ).awaitTermination()
    tables = order_ingest.order_tables(t.spark, folder)
    per_order = tables.read(order_ingest.ITEMS).groupBy(F.col("order_id").alias("id")).agg(
        F.count("id").alias("total_items"),
        F.sum("quantity").alias("total_qty"),
        F.sum("nfe_bling_id").alias("nfe_sum"),
    )
    orders = tables.read(order_ingest.ORDERS).drop("key_range", "service_note")
    return plain(orders.join(per_order, "id", "left").drop("id"))


def _history_stream(t: TestTables) -> DataFrame:
    return (
        t.spark.readStream.schema(t.events.schema)
        .parquet(f"{t.sf_dir}/events.parquet*")  # a stream takes a folder or a pattern
        .select(F.col("user_id").alias("product"), F.col("ts").alias("change_date"))
    )


@report
def stream_weekly_consumption(t: TestTables) -> DataFrame:
    """The weekly report from a stream over the history files."""
    folder = _folder(t, "weekly-consumption")
    weekly_consumption.start_weekly_consumption(_history_stream(t), folder).awaitTermination()
    return weekly_consumption.read_weekly_consumption(
        t.spark, folder, t.product, t.product_exclude, DAYS, CONSUMPTION_AS_OF
    ).orderBy(asc("week"), asc("product_desc"))


@report
def stream_weekly_windows(t: TestTables) -> DataFrame:
    """The weeks that event time has closed, from windows over the history files."""
    folder = _folder(t, "weekly-windows")
    weekly_windows.run_weekly_windows(_history_stream(t), folder)
    return weekly_windows.read_closed_weeks(t.spark, folder, t.product, t.product_exclude).orderBy(
        asc("week"), asc("product_desc")
    )


@report
def stream_weekly_late(t: TestTables) -> DataFrame:
    """Changes that arrived, those in closed and in open weeks, and late ones."""
    folder = _folder(t, "weekly-windows")
    weekly_windows.run_weekly_windows(_history_stream(t), folder)
    return weekly_windows.late_changes(t.spark, folder)


# Constraints


@report
def constraint_violations(t: TestTables) -> DataFrame:
    """Broken uniqueness, required values and references over the stored tables."""
    unique = [
        ("product", ["id"]), ("freezer_position", ["id"]), ("stock_minimum", ["product"]),
        ("product_exclude", ["product_id"]), ("product_mapping", ["external_product_id"]),
        ("supplier_order", ["platform_order_id"]), ("supplier_order_item", ["id"]),
        ("local_mapping", ["local_product_id"]),
    ]
    required = [
        ("supplier_order", "loaded_at"), ("supplier_order_item", "order_id"),
        ("product_mapping", "external_name"), ("purchase_order", "status"),
    ]
    references = [
        ("supplier_order_item", "order_id", t.supplier_order),
        ("supplier_order_item", "local_product_id", t.product),
        ("purchase_order_item", "order_id", t.purchase_order),
        ("purchase_order_item", "product", t.product),
        ("product_mapping", "local_product_id", t.product),
        ("product_exclude", "product_id", t.product),
        ("stock_minimum", "product", t.product),
        ("freezer_position_history", "product", t.product),
    ]

    def table(name: str) -> DataFrame:
        # Not a rule of the data model: shows that a local product may be mapped twice.
        return t.product_mapping if name == "local_mapping" else getattr(t, name)

    checks = [constraints.unique_violations(table(n), n, keys) for n, keys in unique]
    checks += [constraints.required_violations(table(n), n, column) for n, column in required]
    checks += [
        constraints.reference_violations(table(n), n, column, parent)
        for n, column, parent in references
    ]
    found = checks[0]
    for check in checks[1:]:
        found = found.unionByName(check)
    return found
