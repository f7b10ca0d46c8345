"""Landed cost, average price and item frequency of supplier orders."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import (
    asc,
    contains_text,
    load_type_label,
    number_starts_with,
    order_status_label,
    ratio,
    within_dates,
)
from larder.operators.mapping import needs_mapping

# Fixed value: share of the tax-rate difference added to the value of the goods.
TAX_FACTOR = 0.85 * 0.06

EVERY_TYPE, EVERY_CATEGORY = "Todos", "Todas"


def items_per_order(items: DataFrame) -> DataFrame:
    """First date, lines, quantity, value and unmapped lines of each order."""
    unmapped = F.col("local_product_id").isNull() & needs_mapping(F.col("external_category"))
    return items.groupBy("order_id").agg(
        F.min("created_at").alias("order_date"),
        F.count("id").alias("total_items"),
        F.sum("quantity").alias("total_qty"),
        F.round(F.sum(F.col("quantity") * F.col("price_unit")), 2).alias("items_value"),
        F.count_if(unmapped).alias("unmapped_items"),
    )


def supplier_orders_summary(
    orders: DataFrame, items: DataFrame, type_of_load: int | None = None
) -> DataFrame:
    """Order headers with the totals of their items, optionally of one load type."""
    return orders_with_totals(orders, items_per_order(items), type_of_load)


def orders_with_totals(
    orders: DataFrame, totals: DataFrame, type_of_load: int | None = None
) -> DataFrame:
    """The same from totals by order that are there already."""
    if type_of_load is not None:
        orders = orders.where(F.col("type_of_load") == type_of_load)
    totals = totals.withColumnRenamed("order_id", "id")
    none = F.lit(0).cast("bigint")
    return orders.join(totals, "id", "left").select(
        "id", "platform_order_id", "vhsys", "platform_status", "type_of_load", "total",
        "product_invoice_value", "product_invoice_doc",
        "service_invoice_value", "service_invoice_doc", "loaded_at", "order_date",
        F.coalesce("total_items", none).alias("total_items"),
        "total_qty",
        "items_value",
        F.coalesce("unmapped_items", none).alias("unmapped_items"),
    )


def supplier_orders_filtered(
    summary: DataFrame, start: date | str, end: date | str, number_prefix: str | None = None
) -> DataFrame:
    """Orders in a date range, undated ones included, by a prefix of the order number."""
    dated = F.col("order_date").isNull() | within_dates(F.col("order_date"), start, end)
    return summary.where(dated & number_starts_with(F.col("vhsys"), number_prefix))


def _double(name: str) -> Column:
    return F.col(name).cast("double")


def supplier_order_costs(summary: DataFrame) -> DataFrame:
    """Landed cost per order; amounts are NULL until both invoices are there.

    A sum or difference is NULL as soon as one operand is, which is the rule wanted.
    """
    factor = F.lit(TAX_FACTOR)
    invoiced = _double("product_invoice_value") + _double("service_invoice_value")
    unmapped = F.col("unmapped_items")
    alert = F.when(unmapped > 0, F.concat(F.lit("⚠ "), unmapped.cast("string"), F.lit(" sem mapa")))
    value = _double("items_value")
    return (
        summary.withColumns(
            {
                "status_desc": order_status_label(F.col("platform_status")),
                "alerta": F.coalesce(alert, F.lit("")),
                "valor_faturado": invoiced,
            }
        )
        .withColumns(
            {
                "dif_icms": F.when(F.col("valor_faturado").isNotNull(), value * factor),
                "frete_imposto": F.col("valor_faturado") - value,
            }
        )
        .withColumn("preco_real", F.col("valor_faturado") + F.col("dif_icms"))
        .withColumn("pct_custo", ratio(F.col("preco_real") - value, value) * 100)
    )


def supplier_order_items(
    items: DataFrame, product: DataFrame, order_id: int | None = None
) -> DataFrame:
    """Items with the name of their local product, of all orders, or sorted of one."""
    if order_id is not None:
        items = items.where(F.col("order_id") == order_id)
    names = product.select(
        F.col("id").alias("local_product_id"), F.col("description").alias("local_product_desc")
    )
    rows = items.join(names, "local_product_id", "left").select(
        "id", "order_id", "external_product_id", "external_product_name", "external_category",
        "quantity", "price_unit", "created_at", "local_product_id", "local_product_desc",
    )
    return rows if order_id is None else rows.orderBy(asc("external_product_name"))


def supplier_order_item_costs(items: DataFrame, summary: DataFrame) -> DataFrame:
    """Tax, freight share and landed price per unit of each item."""
    order = summary.select(
        F.col("id").alias("order_id"),
        (_double("product_invoice_value") + _double("service_invoice_value")).alias("invoiced"),
        _double("items_value").alias("value"),
    )
    price, both = _double("price_unit"), F.col("invoiced").isNotNull()
    nothing = F.lit(0.0)
    share = ratio(F.col("invoiced") - F.col("value"), F.col("value"))
    return (
        items.join(order, "order_id")
        .withColumns(
            {
                "dif_icms": F.when(both, price * F.lit(TAX_FACTOR)),
                "frete_imposto": price * share,
            }
        )
        .withColumn(
            "preco_real",
            F.when(
                both,
                price
                + F.coalesce("frete_imposto", nothing)
                + F.coalesce("dif_icms", nothing),
            ),
        )
        .withColumn("pct_custo", ratio(F.col("preco_real") - price, price) * 100)
        .drop("invoiced", "value")
    )


def _local_names(product: DataFrame) -> DataFrame:
    return product.select(F.col("id").alias("local_product_id"), "description")


def price_items(
    items: DataFrame, orders: DataFrame, product: DataFrame, start: date | str, end: date | str
) -> DataFrame:
    """Items of fully invoiced orders in a date range, with their order's totals.

    An order's value covers all of its items, also those outside the range. It is
    summed per order before the join, so a very large order is combined map-side.
    """
    totals = items.groupBy("order_id").agg(
        F.sum(F.col("quantity") * F.col("price_unit")).alias("order_items_value")
    )
    invoiced = orders.where(
        F.col("product_invoice_value").isNotNull() & F.col("service_invoice_value").isNotNull()
    ).select(
        F.col("id").alias("order_id"),
        "type_of_load",
        (F.col("product_invoice_value") + F.col("service_invoice_value")).alias("valor_faturado"),
    )
    dated = items.where(within_dates(F.col("created_at"), start, end)).select(
        "order_id", "local_product_id", "external_product_name", "external_category",
        "quantity", "price_unit", "created_at",
    )
    return (
        dated.join(invoiced.join(totals, "order_id"), "order_id")
        .join(_local_names(product), "local_product_id", "left")
        .select(
            F.coalesce("description", "external_product_name").alias("product_desc"),
            "external_category",
            "type_of_load",
            "quantity",
            "price_unit",
            "created_at",
            "order_items_value",
            "valor_faturado",
        )
    )


def price_average(priced: DataFrame) -> DataFrame:
    """Quantity-weighted unit and landed price per product, category and load type.

    Rows without a category or load type take no part.
    """
    keys = ["product_desc", "external_category", "type_of_load"]
    qty, price = _double("quantity"), _double("price_unit")
    value = _double("order_items_value")
    freight = F.when(value == 0, F.lit(0.0)).otherwise(
        ratio(_double("valor_faturado") - value, value)
    )
    real = price * (F.lit(1.0) + freight + F.lit(TAX_FACTOR))
    unit_mean = ratio(F.col("sum_unit"), F.col("qtd_total"))
    real_mean = ratio(F.col("sum_real"), F.col("qtd_total"))
    nothing = F.lit(0.0)
    return (
        priced.dropna(subset=keys)
        .groupBy(*keys)
        .agg(
            F.coalesce(F.sum(qty), nothing).alias("qtd_total"),
            F.coalesce(F.sum(qty * price), nothing).alias("sum_unit"),
            F.coalesce(F.sum(qty * real), nothing).alias("sum_real"),
        )
        .withColumns({"preco_unit_medio": unit_mean, "preco_real_medio": real_mean})
        .withColumn("dif_por_caixa", F.col("preco_real_medio") - F.col("preco_unit_medio"))
        .select(
            F.col("product_desc").alias("produto"),
            load_type_label(F.col("type_of_load")).alias("tipo"),
            F.col("external_category").alias("categoria"),
            "qtd_total",
            "preco_unit_medio",
            "dif_por_caixa",
            "preco_real_medio",
            (ratio(F.col("dif_por_caixa"), F.col("preco_unit_medio")) * 100).alias("pct_custo"),
        )
    )


def by_type_category_search(
    rows: DataFrame,
    tipo: str = EVERY_TYPE,
    categoria: str = EVERY_CATEGORY,
    search: str | None = None,
) -> DataFrame:
    """Rows of one load type, one category and a product search; each may be open."""
    if tipo != EVERY_TYPE:
        rows = rows.where(F.col("tipo") == tipo)
    if categoria != EVERY_CATEGORY:
        rows = rows.where(F.col("categoria") == categoria)
    return rows.where(contains_text(F.col("produto"), (search or "").strip()))


price_average_filtered = by_type_category_search
item_frequency_filtered = by_type_category_search


def price_average_by_category(averages: DataFrame) -> DataFrame:
    """Means per category of the product means, weighted by quantity."""

    def weighted(name: str) -> Column:
        return ratio(F.sum(F.col(name) * F.col("qtd_total")), F.sum("qtd_total")).alias(name)

    return (
        averages.where(F.col("categoria").isNotNull())
        .groupBy("categoria")
        .agg(
            F.sum("qtd_total").alias("qtd_total"),
            weighted("preco_unit_medio"),
            weighted("preco_real_medio"),
        )
        .withColumn("dif_por_caixa", F.col("preco_real_medio") - F.col("preco_unit_medio"))
    )


def item_frequency(
    items: DataFrame, orders: DataFrame, product: DataFrame, start: date | str, end: date | str
) -> DataFrame:
    """Orders that contain an item, total and mean quantity; NULL keys form groups too."""
    dated = items.where(within_dates(F.col("created_at"), start, end)).select(
        "order_id", "local_product_id", "external_product_name", "external_category", "quantity"
    )
    loads = orders.select(F.col("id").alias("order_id"), "type_of_load")
    count = F.col("num_pedidos").cast("decimal(20,0)")
    return (
        dated.join(loads, "order_id")
        .join(_local_names(product), "local_product_id", "left")
        .groupBy(
            F.coalesce("description", "external_product_name").alias("product_desc"),
            "external_category",
            "type_of_load",
        )
        .agg(
            F.count_distinct("order_id").alias("num_pedidos"),
            F.sum("quantity").alias("qty_total"),
        )
        .withColumn("qty_media", F.round(ratio(F.col("qty_total"), count), 2))
    )


def item_frequency_pct(frequency: DataFrame) -> DataFrame:
    """Each item's orders as a percentage of the largest count, half to even.

    The largest count is a scalar subquery: one number reaches the other rows. It is
    taken together with the quantity only so that both plans read the same columns and
    Spark runs their common part once.
    """
    top = F.max(F.struct("num_pedidos", "qty_total"))
    largest = frequency.select(top["num_pedidos"].alias("n")).scalar()
    orders = F.col("num_pedidos").cast("double")
    return frequency.select(
        F.col("product_desc").alias("produto"),
        load_type_label(F.col("type_of_load")).alias("tipo"),
        F.col("external_category").alias("categoria"),
        "num_pedidos",
        F.bround(ratio(orders, largest.cast("double")) * 100, 1).alias("pct_pedidos"),
        "qty_total",
        "qty_media",
    )


def filter_options(rows: DataFrame, filters: Mapping[str, Column]) -> DataFrame:
    """(filter, value): the distinct values of several filters, from one pass over the rows."""
    offered = [F.struct(F.lit(name).alias("filter"), value.alias("value")) for name, value in filters.items()]
    return rows.select(F.inline(F.array(*offered))).where("value IS NOT NULL").distinct()
