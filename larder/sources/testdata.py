"""The engine's tables derived from the test tables, as SQL both engines accept.

``{name}`` stands for a test table or another view. Every view reads the whole of
its table, and batches of edits have a row for each of its rows; some of their ids are
shifted, so that they match nothing. Stored settings, mappings and exclusions are sparse
by a product attribute, and orders of one priority are delivered a second time.
"""

from __future__ import annotations

from functools import cached_property
from string import Formatter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder import schemas

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

# Reference times and date range of the test reports.
CONSUMPTION_AS_OF = "2024-01-31 00:00:00"
PLATFORM_AS_OF = "2001-06-30 00:00:00"
RANGE_START, RANGE_END = "2000-01-01", "2000-12-31"

_LINE_ID = (
    "CONCAT(l_orderkey,'-',l_linenumber,'-',l_partkey,'-',l_suppkey,'-',CAST(l_shipdate AS DATE))"
)



def _some_shifted(key: str, step: int) -> str:
    """The key, moved out of the table's range in every ``step``-th row."""
    return f"CASE WHEN {key} % {step} = 0 THEN {key} + 1000000000 ELSE {key} END"


VIEWS: dict[str, str] = {
    "status": """
        SELECT 1 AS id, 'OPEN' AS status_code
        UNION ALL SELECT 2, 'CLOSED' UNION ALL SELECT 3, 'RESERVED'""",
    "product": """
        SELECT p_partkey AS id, p_name AS product_name, CONCAT(p_name, ' ', p_brand) AS description,
          CASE p_type WHEN 'PROMO' THEN 'Vazio' WHEN 'LARGE' THEN 'Balde'
                      WHEN 'ECONOMY' THEN 'Sorvete' ELSE 'Outro' END AS product_type,
          CASE WHEN p_partkey % 11 = 10 THEN 2 ELSE 1 END AS status
        FROM {part}""",
    "freezer": "SELECT s_suppkey AS id, s_name AS freezer_name FROM {supplier}",
    # Every fifth product has no position: its lines count for the next product.
    "freezer_position": f"""
        SELECT {_LINE_ID} AS id,
          CASE WHEN l_partkey % 5 = 0 THEN l_partkey + 1 ELSE l_partkey END AS product,
          l_suppkey AS freezer,
          CASE WHEN l_linestatus = 'O' THEN 1 WHEN l_returnflag = 'R' THEN 3 ELSE 2 END AS status,
          l_shipdate AS update_date
        FROM {{lineitem}}""",
    "freezer_position_history": """
        SELECT event_id AS id, user_id AS product, ts AS change_date FROM {events}""",
    "product_exclude": """
        SELECT p_partkey AS product_id, 'placeholder' AS reason
        FROM {part} WHERE p_type = 'LARGE' AND p_size > 25""",
    "stock_minimum": """
        SELECT p_partkey AS product, p_size % 10 AS min_qty, p_size AS target_qty,
          30 AS period_days, TIMESTAMP '2024-01-01 00:00:00' AS updated_at
        FROM {part} WHERE p_type <> 'MEDIUM'""",
    "product_mapping": """
        SELECT p_partkey + 100000 AS external_product_id,
          CONCAT('EXT ', p_name, ' ', p_brand) AS external_name,
          CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 10 = 3 THEN p_partkey - 1
               ELSE p_partkey END AS local_product_id,
          TIMESTAMP '2024-01-01 00:00:00' AS updated_at
        FROM {part} WHERE p_brand <> 'Brand#13'""",
    "supplier_order": """
        SELECT o_orderkey AS id, o_orderkey + 500000 AS platform_order_id, o_custkey AS store_id,
          CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3
               WHEN '4-NOT SPECIFIED' THEN 7 ELSE 9 END AS platform_status,
          CAST(o_totalprice AS DECIMAL(12,2)) AS total,
          CAST(o_orderkey % 100 AS DECIMAL(12,2)) AS franchise_tax,
          o_orderdate AS loaded_at,
          CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS type_of_load,
          o_orderkey AS vhsys,
          CASE WHEN o_orderkey % 5 = 0 THEN NULL
               ELSE CAST(o_totalprice AS DECIMAL(12,2)) END AS product_invoice_value,
          CASE WHEN o_orderkey % 5 <> 0 THEN CONCAT('OLD-P', o_orderkey) END AS product_invoice_doc,
          CASE WHEN o_orderkey % 3 = 0 THEN NULL
               ELSE CAST(o_orderkey % 1000 AS DECIMAL(12,2)) END AS service_invoice_value,
          CASE WHEN o_orderkey % 3 <> 0 THEN CONCAT('OLD-S', o_orderkey) END AS service_invoice_doc
        FROM {orders}""",
    "supplier_order_item": f"""
        SELECT {_LINE_ID} AS id, l_orderkey AS order_id,
          CAST(l_linenumber AS BIGINT) AS platform_item_id,
          l_partkey + 100000 AS external_product_id,
          CONCAT('EXT ', p_name, ' ', p_brand) AS external_product_name,
          CASE p_type WHEN 'ECONOMY' THEN 'Sorvetes' WHEN 'SMALL' THEN 'ACAI'
               WHEN 'LARGE' THEN 'potes' WHEN 'PROMO' THEN NULL
               ELSE 'congelados' END AS external_category,
          CAST(l_quantity AS DECIMAL(10,3)) AS quantity,
          CAST(p_retailprice AS DECIMAL(10,2)) AS price_unit,
          CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE l_partkey END AS local_product_id,
          l_shipdate AS created_at,
          CASE WHEN l_suppkey % 4 = 0 THEN l_suppkey END AS nfe_bling_id,
          CASE WHEN l_suppkey % 5 = 0 THEN l_suppkey END AS sale_order_bling_id
        FROM {{lineitem}} JOIN {{part}} ON p_partkey = l_partkey""",
    "purchase_order": """
        SELECT o_orderkey AS id, o_orderdate AS order_date,
          CASE o_orderpriority WHEN '1-URGENT' THEN 'RASCUNHO' WHEN '2-HIGH' THEN 'CONFIRMADO'
               WHEN '3-MEDIUM' THEN 'ENVIADO' ELSE 'RECEBIDO' END AS status,
          30 AS period_days, CASE WHEN o_orderkey % 4 = 0 THEN 'note' END AS notes,
          CONCAT('user', o_custkey % 20) AS created_by
        FROM {orders}""",
    # Every fourth order has no items: its lines count for the next order.
    "purchase_order_item": f"""
        SELECT {_LINE_ID} AS id,
          CASE WHEN l_orderkey % 4 = 0 THEN l_orderkey + 1 ELSE l_orderkey END AS order_id,
          l_partkey AS product, l_linenumber AS current_stock, l_linenumber % 5 AS min_qty,
          l_linenumber + 10 AS target_qty,
          CAST(l_tax AS DECIMAL(10,4)) AS avg_daily_consumption,
          CAST(l_quantity AS INT) AS suggested_qty,
          CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE CAST(l_quantity AS INT) END AS confirmed_qty,
          CASE WHEN l_suppkey % 3 = 0 THEN NULL WHEN l_suppkey % 3 = 1 THEN TRUE
               ELSE FALSE END AS supplier_available,
          CAST(l_extendedprice AS DECIMAL(10,2)) AS supplier_price,
          CASE WHEN l_linenumber = 7 THEN 'obs' END AS notes
        FROM {{lineitem}}""",
    "order_status_request": f"""
        SELECT {_some_shifted('o_orderkey', 19)} AS order_id, CASE o_orderkey % 4 WHEN 0 THEN 'RASCUNHO'
          WHEN 1 THEN 'CONFIRMADO' WHEN 2 THEN 'ENVIADO' ELSE 'RECEBIDO' END AS new_status
        FROM {{orders}}""",
    "supplier_availability": f"""
        SELECT {_some_shifted('p_partkey', 23)} AS product_id, p_partkey % 3 <> 0 AS available,
          CAST(p_retailprice AS DECIMAL(10,2)) AS price
        FROM {{part}}""",
    "order_edit": f"""
        SELECT {_some_shifted('p_partkey', 17)} AS product_id, p_size - 20 AS confirmed_qty
        FROM {{part}}""",
    "stock_minimum_edit": f"""
        SELECT {_some_shifted('p_partkey', 13)} AS product_id, p_size % 15 AS min_qty, p_size % 20 AS target_qty,
          15 + p_size % 3 AS period_days
        FROM {{part}}""",
    "product_mapping_edit": f"""
        SELECT {_some_shifted('p_partkey', 5)} + 100000 AS external_product_id, CONCAT('NEW ', p_name) AS external_name,
          CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_partkey END AS local_product_id
        FROM {{part}}""",
    "product_flag_edit": f"""
        SELECT {_some_shifted('p_partkey', 7)} AS id, p_partkey % 11 <> 9 AS ativo, p_partkey % 17 = 0 AS excluir_calculos
        FROM {{part}}""",
    "product_new": """
        SELECT p_partkey AS seq,
          CASE WHEN p_partkey % 8 = 0 THEN '   '
               ELSE CONCAT('  new-', p_partkey, ' ') END AS product_name,
          CONCAT(' ', p_name, ' new ') AS description, 'Sorvete' AS product_type,
          CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE ' 6kg ' END AS product_size,
          p_size % 4 AS sort_order, p_partkey % 5 = 0 AS excluir
        FROM {part}""",
    # Orders of one status are stored already; the rest are new. High-priority orders
    # are delivered a second time, changed and without their order number.
    "raw_order_header": """
        SELECT o_orderkey AS arrival, o_orderkey AS src_key,
          CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderstatus = 'O' THEN o_orderkey + 500000
               ELSE o_orderkey + 1000000000 END AS id,
          o_custkey AS store_id, CAST(o_orderkey % 7 AS INT) AS status,
          CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS type_of_load,
          CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_orderkey END AS vhsys,
          CASE WHEN o_orderkey % 50 = 0 THEN '1.234,56' ELSE CONCAT(o_orderkey, ',50') END AS total,
          CONCAT(o_orderkey % 100, '.25') AS franchise_tax, o_orderpriority AS priority
        FROM {orders}
        UNION ALL
        SELECT o_orderkey + 1000000000000, o_orderkey,
          CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderstatus = 'O' THEN o_orderkey + 500000
               ELSE o_orderkey + 1000000000 END,
          o_custkey + 1, CAST(o_orderkey % 5 AS INT), NULL, NULL,
          CONCAT(o_orderkey, ',75'), '9.5', 'AGAIN'
        FROM {orders} WHERE o_orderpriority = '2-HIGH'""",
    "raw_order_invoice": """
        SELECT arrival, 0 AS pos, CONCAT(REPEAT('3', 20), '-', REPEAT('1', 24)) AS f2_chvnfe,
          CONCAT(src_key % 500, ',10') AS f2_valfat, CONCAT('P', src_key) AS f2_doc
        FROM {raw_order_header} WHERE priority <> '5-LOW'
        UNION ALL
        SELECT arrival, 1, 'a3f0-uuid',
          CASE WHEN src_key % 11 = 0 THEN '0' ELSE CONCAT(src_key % 90 + 1, '.5') END,
          CONCAT('S', src_key)
        FROM {raw_order_header} WHERE priority <> '1-URGENT'
        UNION ALL
        SELECT arrival, 2, NULL, NULL, NULL FROM {raw_order_header} WHERE priority = '3-MEDIUM'""",
    "raw_order_item": """
        SELECT l_orderkey AS src_key, CAST(l_linenumber AS BIGINT) AS id, l_partkey + 100000 AS product_id,
          l_suppkey AS line_source, CONCAT(CAST(l_quantity AS INT), ',5') AS quantity,
          CASE WHEN l_linenumber = 6 THEN 'n/a'
               ELSE CONCAT(l_linenumber * 10, '.99') END AS price_unit,
          CASE WHEN l_linenumber = 7 THEN 'invalid' ELSE
            CONCAT(LPAD(CAST(DAY(l_shipdate) AS VARCHAR(2)), 2, '0'), '-',
                   LPAD(CAST(MONTH(l_shipdate) AS VARCHAR(2)), 2, '0'), '-',
                   YEAR(l_shipdate), ' 10:00:00') END AS created_at,
          CASE WHEN l_suppkey % 2 = 0 THEN l_suppkey END AS nfe_bling_id,
          CASE WHEN l_suppkey % 3 = 0 THEN l_suppkey END AS sale_order_bling_id,
          CONCAT('EXT ', p_name, ' ', p_brand) AS product_name,
          CASE p_type WHEN 'ECONOMY' THEN 'Sorvetes' WHEN 'SMALL' THEN 'ACAI'
               ELSE 'congelados' END AS category_name
        FROM {lineitem} JOIN {part} ON p_partkey = l_partkey""",
}

# The items of a delivery come in one document for each run of this many product ids.
PRODUCTS_PER_PART = 1000


def names_in(sql: str) -> set[str]:
    return {field for _, field, _, _ in Formatter().parse(sql) if field}


class TestTables:
    """The derived tables of one test-data folder as lazy DataFrames, by attribute."""

    __test__ = False

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, str(sf_dir).rstrip("/")
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS and name not in BASE_TABLES:
            raise AttributeError(name)
        if name not in self._frames:
            self._frames[name] = self._build(name)
        return self._frames[name]

    def _build(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        inputs = {other: getattr(self, other) for other in names_in(VIEWS[name])}
        view = self.spark.sql(VIEWS[name], **inputs)
        # A TIMESTAMP literal is zoned in Spark; the tables have local times.
        zoned = [column for column, kind in view.dtypes if kind == "timestamp"]
        return view.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned})

    @cached_property
    def documents(self) -> DataFrame:
        """Nested order documents, as they would be read from JSON."""
        return order_documents(self.raw_order_header, self.raw_order_invoice, self.raw_order_item)


def order_documents(
    headers: DataFrame, invoices: DataFrame, items: DataFrame, *kept: str
) -> DataFrame:
    """Headers with their invoices and items nested, and the columns ``kept`` of the headers.

    Part 0 of a delivery has its header and invoices; its items follow in one part for
    each run of ``PRODUCTS_PER_PART`` product ids they are from. The items of a part are
    sorted, so an item's place is its part and its position there.

    Items are shuffled once, by order: they are nested and meet their headers where they
    lie. Lists do not shrink when combined before a shuffle, they only would be sorted there.
    """
    line = F.struct(
        F.col("id"),
        F.col("product_id"),
        "line_source",
        "created_at",
        "quantity",
        "price_unit",
        "nfe_bling_id",
        "sale_order_bling_id",
        F.struct(
            F.col("product_name").alias("name"),
            F.struct(F.col("category_name").alias("name")).alias("category"),
        ).alias("products"),
    )
    part = F.expr(f"cast(product_id div {PRODUCTS_PER_PART} + 1 as int)")
    nested_items = (
        items.withColumn("part", part).repartition("src_key").groupBy("src_key", "part")
        .agg(F.sort_array(F.collect_list(line)).alias("orderItems"))
    )
    invoice = F.struct("pos", "f2_chvnfe", "f2_valfat", "f2_doc")
    nested_invoices = invoices.groupBy("arrival").agg(
        F.sort_array(F.collect_list(invoice)).alias("invoices")
    )
    types = {field.name: field.dataType for field in schemas.ORDER_DOCUMENT.fields}
    order_items = F.transform(
        "orderItems",
        lambda i: F.struct(
            *[i[name].alias(name) for name in schemas.ORDER_LINE.fieldNames()]
        ),
    )
    invoice_list = F.transform(
        "invoices",
        lambda i: F.struct(*[i[name].alias(name) for name in schemas.INVOICE.fieldNames()]),
    )
    heads = headers.join(nested_invoices, "arrival", "left").select(
        *headers.columns,
        F.lit(0).alias("part"),
        invoice_list.cast(types["invoices"]).alias("invoices"),
        F.lit(None).cast(types["orderItems"]).alias("orderItems"),
    )
    bodies = headers.join(nested_items, "src_key").select(
        *headers.columns,
        "part",
        F.lit(None).cast(types["invoices"]).alias("invoices"),
        order_items.cast(types["orderItems"]).alias("orderItems"),
    )
    return heads.unionByName(bodies).select(
        "arrival", "part", *kept, *[F.col(name).cast(kind) for name, kind in types.items()]
    )
