"""Hand-made rows for rules that the test tables exercise too rarely."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from larder import schemas
from larder.functions import (
    contains_text,
    number_starts_with,
    order_status_label,
    parse_decimal,
    parse_moment,
    strip,
    within_dates,
)
from larder.operators import (
    consumption,
    ingest,
    mapping,
    pricing,
    products,
    purchasing,
    replenishment,
    settings,
    stock,
)

AS_OF = "2024-01-31 00:00:00"


def value(spark, column, **literals):
    frame = spark.range(1).select(*[v.alias(k) for k, v in literals.items()])
    return frame.select(column.alias("v")).first().v


def text(content):
    return F.lit(content).cast("string")


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("12,345", Decimal("12.35")), ("1.234,56", None), ("abc", None), (None, None),
        (" 7,5 ", Decimal("7.50")), ("99999999999,99", None), ("-3,25", Decimal("-3.25")),
    ],
)
def test_parse_decimal(spark, raw, expected):
    assert value(spark, parse_decimal(F.col("c"), 12, 2), c=text(raw)) == expected


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("31-02-2024 00:00:00", None), ("", None), (None, None), ("2024-02-05 03:04:05", None),
        ("5-2-2024 3:04:05", datetime.datetime(2024, 2, 5, 3, 4, 5)),
        ("05-02-2024 23:59:59", datetime.datetime(2024, 2, 5, 23, 59, 59)),
        ("05-02-2024 24:00:00", None), ("05-02-2024 10:00:00 ", None),
    ],
)
def test_parse_moment(spark, raw, expected):
    assert value(spark, parse_moment(F.col("c")), c=text(raw)) == expected


def test_search_is_case_insensitive_with_accents(spark):
    names = spark.createDataFrame([("Açaí 6kg",), ("Morango",), (None,)], "n string")
    assert [r.n for r in names.where(contains_text(F.col("n"), "AÇA")).collect()] == ["Açaí 6kg"]
    assert [r.n for r in names.where(contains_text(F.col("n"), "^m.*o$")).collect()] == ["Morango"]
    assert names.where(contains_text(F.col("n"), "")).count() == 3


def test_number_prefix(spark):
    numbers = spark.createDataFrame([(0,), (12,), (312,), (None,)], "n bigint")
    assert [r.n for r in numbers.where(number_starts_with(F.col("n"), " 1 ")).collect()] == [12]
    assert numbers.where(number_starts_with(F.col("n"), "0")).count() == 0
    assert numbers.where(number_starts_with(F.col("n"), "  ")).count() == 4


def test_labels_and_strip(spark):
    assert value(spark, order_status_label(F.col("c")), c=F.lit(7)) == "Em Separação"
    assert value(spark, order_status_label(F.col("c")), c=F.lit(6)) == "6"
    assert value(spark, strip(F.col("c")), c=text("\t a b \n")) == "a b"


def test_range_must_not_be_reversed():
    with pytest.raises(ValueError):
        within_dates(F.col("c"), "2024-02-01", "2024-01-01")


def history(spark, rows):
    return spark.createDataFrame(rows, "product bigint, change_date timestamp_ntz")


def no_exclusions(spark):
    return spark.createDataFrame([], schemas.TABLES["product_exclude"])


def product_table(spark, *rows):
    return spark.createDataFrame(
        rows, "id bigint, description string, product_type string, status int"
    )


def suggestions(spark, days=30, history_rows=(), positions=(), minimum=(), mappings=(),
                excluded=(), everything=False, product=None):
    schema = schemas.TABLES
    return replenishment.order_suggestions(
        product or product_table(spark, (1, "A", "Sorvete", 1)),
        spark.createDataFrame(list(positions), "product bigint, status int"),
        spark.createDataFrame([(1, "OPEN"), (2, "CLOSED"), (3, "OTHER")], schema["status"]),
        history(spark, list(history_rows)),
        spark.createDataFrame([(p, None) for p in excluded], schema["product_exclude"]),
        spark.createDataFrame(list(minimum), "product bigint, min_qty int, target_qty int"),
        spark.createDataFrame(
            list(mappings), "external_product_id bigint, external_name string, local_product_id bigint"
        ),
        spark.createDataFrame([], schema["supplier_order_item"]),
        days=days,
        include_no_position=everything,
        as_of=AS_OF,
    ).collect()


DAY = datetime.datetime(2024, 1, 30)


@pytest.mark.parametrize("units, days, average, quantity", [
    (20, 30, Decimal("0.6667"), 21), (1, 7, Decimal("0.1429"), 2), (30, 30, Decimal("1.0000"), 30),
])
def test_projection_uses_the_rounded_average(spark, units, days, average, quantity):
    row, = suggestions(spark, days, [(1, DAY)] * units, positions=[(1, 1)])
    assert (row.avg_daily_consumption, row.suggested_qty) == (average, quantity)


def test_order_is_triggered_at_the_minimum(spark):
    at, = suggestions(spark, positions=[(1, 2)] * 3, minimum=[(1, 3, 10)])
    above, = suggestions(spark, positions=[(1, 2)] * 4, minimum=[(1, 3, 10)])
    assert (at.suggested_qty, above.suggested_qty) == (7, 0)


def test_other_status_counts_in_the_total_only(spark):
    row, = suggestions(spark, positions=[(1, 1), (1, 2), (1, 3)])
    assert (row.total_positions, row.open_qty, row.closed_qty) == (3, 1, 1)


def test_two_external_names_give_two_rows(spark):
    rows = suggestions(spark, positions=[(1, 1)], mappings=[(7, "X", 1), (8, "Y", 1), (9, "Z", None)])
    assert sorted(r.product_desc for r in rows) == ["X", "Y"]
    assert {r.local_desc for r in rows} == {"A"}


def test_products_left_out(spark):
    items = product_table(spark, (1, "A", "S", 1), (2, "B", "S", 2), (3, "C", "S", 1), (4, "D", "S", 1))
    where = [(1, 1), (2, 1), (3, 1)]
    assert [r.id for r in suggestions(spark, positions=where, excluded=[3], product=items)] == [1]
    rows = suggestions(spark, positions=where, excluded=[3], product=items, everything=True)
    assert sorted(r.id for r in rows) == [1, 4]


def test_window_has_no_upper_bound(spark):
    rows = [(1, datetime.datetime(2024, 1, 1)), (1, datetime.datetime(2023, 12, 31, 23, 59, 59)),
            (1, datetime.datetime(2025, 1, 1))]
    used = consumption.consumption_summary(
        history(spark, rows), product_table(spark, (1, "A", "S", 1)), no_exclusions(spark), 30, AS_OF
    )
    assert used.first().total_consumed == 2


def test_weekly_counts_add_up(spark):
    rows = [(p, datetime.datetime(2024, 1, d, 12)) for p in (1, 2) for d in range(2, 30)]
    two = product_table(spark, (1, "same", "S", 1), (2, "same", "S", 1))
    weekly = consumption.consumption_weekly(history(spark, rows), two, no_exclusions(spark), 30, AS_OF)
    got = {r.week: r.consumed for r in weekly.collect()}
    assert sum(got.values()) == len(rows)
    assert all(week.weekday() == 0 for week in got)


def test_empty_input(spark):
    empty = history(spark, [])
    summary = consumption.consumption_summary(
        empty, product_table(spark, (1, "A", "S", 1)), no_exclusions(spark), 30, AS_OF
    )
    assert summary.count() == 0
    assert consumption.consumption_total(summary).first().total_consumed == 0
    board = spark.createDataFrame([], "id bigint, product_desc string, open_qty bigint, closed_qty bigint")
    assert tuple(stock.stock_metrics(board, "x").first()) == (0, 0, 0)


def worklist(spark, *rows):
    return spark.createDataFrame(
        rows, "id bigint, product_desc string, closed_qty bigint, target_qty int, "
        "suggested_qty bigint, min_para_alvo bigint, confirmed_qty bigint",
    )


def test_one_line_below_target_blocks_the_order(spark):
    good, bad = (1, "A", 2, 5, 3, 3, 4), (2, "B", 0, 5, 5, 5, 4)
    unconfirmed = (3, "C", 0, 5, 5, 5, 0)

    def build(*rows):
        return replenishment.purchase_order_build(
            worklist(spark, *rows), F.lit(41), 30, " n ", " ana ", AS_OF
        ).collect()

    row, = build(good, unconfirmed)
    assert (row.order_id, row.status, row.notes, row.created_by) == (42, "RASCUNHO", "n", "ana")
    assert (row.product, row.current_stock, row.confirmed_qty) == (1, 2, 4)
    assert build(good, bad) == []
    assert build(unconfirmed) == []
    with pytest.raises(ValueError):
        replenishment.purchase_order_build(worklist(spark, good), F.lit(1), 30, "", "  ")
    blocked = replenishment.order_below_target(worklist(spark, good, bad, unconfirmed))
    assert [r.id for r in blocked.collect()] == [2]


def test_feed_without_any_answer_is_no_feed(spark):
    lines = worklist(spark, (1, "A", 2, 5, 3, 3, 4))
    feed = spark.createDataFrame([(1, None, 9.5)], schemas.TABLES["supplier_availability"])
    for given in (feed, None):
        row = replenishment.supplier_availability_join(lines, given).first()
        assert (row.supplier_available, row.supplier_price) == (None, None)
    told = feed.union(spark.createDataFrame([(2, True, 1.0)], feed.schema))
    row = replenishment.supplier_availability_join(lines, told).first()
    assert (row.supplier_available, row.supplier_price) == (None, None)  # nobody asked for 2
    both = worklist(spark, (1, "A", 2, 5, 3, 3, 4), (2, "B", 2, 5, 3, 3, 4))
    rows = {r.id: r for r in replenishment.supplier_availability_join(both, told).collect()}
    assert (rows[1].supplier_available, rows[1].supplier_price) == (None, 9.5)
    assert (rows[2].supplier_available, rows[2].supplier_price) == (True, 1.0)


def test_status_requests(spark):
    orders = spark.createDataFrame(
        [(1, "RASCUNHO"), (2, "CONFIRMADO"), (3, "RECEBIDO"), (4, "ENVIADO")], "id bigint, status string"
    )
    requests = spark.createDataFrame(
        [(1, "ENVIADO", 1), (2, "ENVIADO", 2), (2, "RASCUNHO", 3), (2, "RECEBIDO", 4),
         (3, "RASCUNHO", 5), (9, "CONFIRMADO", 6), (4, "other", 7)],
        "order_id bigint, new_status string, at bigint",
    )
    after = purchasing.order_status_apply(orders, requests, "at").collect()
    assert {r.id: (r.status, r.status_changed) for r in after} == {
        1: ("RASCUNHO", False), 2: ("RASCUNHO", True), 3: ("RECEBIDO", False), 4: ("ENVIADO", False),
    }
    rejected = purchasing.order_status_rejected(orders, requests).collect()
    assert sorted((r.order_id, r.new_status) for r in rejected) == [
        (1, "ENVIADO"), (2, "RECEBIDO"), (3, "RASCUNHO"), (4, "other"), (9, "CONFIRMADO"),
    ]


def test_settings_merge(spark):
    stored = spark.createDataFrame(
        [(5, 1, 1, 2, 30, None), (6, 2, 3, 4, 30, None)], schemas.TABLES["stock_minimum"]
    )
    edits = spark.createDataFrame(
        [(1, 5, 9, 15), (2, 9, 5, 15), (3, 0, 0, 7)],
        "product_id bigint, min_qty int, target_qty int, period_days int",
    )
    once = settings.stock_minimum_upsert(stored, edits, AS_OF)
    got = {r["product"]: (r.id, r.min_qty, r.target_qty, r.action) for r in once.collect()}
    assert got == {1: (5, 5, 9, "updated"), 2: (6, 3, 4, "unchanged"), 3: (7, 0, 0, "inserted")}
    twice = settings.stock_minimum_upsert(once.drop("action"), edits, AS_OF)
    assert sorted(twice.drop("action").collect()) == sorted(once.drop("action").collect())


def test_products_insert_and_flags(spark):
    product = spark.createDataFrame([(10, "x")], "id bigint, product_name string")
    wanted = spark.createDataFrame(
        [(1, " a ", " d ", "S", "", 0, True), (2, "  ", "d", "S", None, 3, False),
         (3, "b", "\t", "S", "1", 1, False), (4, "c", "e", "S", " ", 2, None)],
        "seq bigint, product_name string, description string, product_type string, "
        "product_size string, sort_order int, excluir boolean",
    )
    added = products.product_insert(product, wanted)
    assert sorted((r.id, r.product_name, r.description, r.product_size, r.sort_order) for r in added.collect()) == [
        (11, "a", "d", None, None), (12, "c", "e", "", 2),
    ]
    assert [r.product_id for r in products.exclusions_of_new(added).collect()] == [11]


def test_exclusion_edits(spark):
    stored = spark.createDataFrame([(1, "old"), (2, "old"), (3, "old")], schemas.TABLES["product_exclude"])
    edits = spark.createDataFrame([(1, True), (2, False), (4, True)], "id bigint, excluir_calculos boolean")
    after = products.product_exclude_apply(stored, edits, "new").collect()
    assert sorted(after) == [(1, "new"), (3, "old"), (4, "new")]


def test_mapping_keeps_null_as_unmapped(spark):
    items = spark.createDataFrame(
        [(1, "x", "Sorvetes", None, "o1"), (2, "y", "açaí", None, "o1"), (3, "z", "ACAI", 9, "o2")],
        "external_product_id bigint, external_product_name string, external_category string, "
        "local_product_id bigint, order_id string",
    )
    mappings = spark.createDataFrame([(1, "x", None), (3, "z", 5)],
                                     "external_product_id bigint, external_name string, local_product_id bigint")
    assert [r.external_product_id for r in mapping.unmapped_products(items, mappings).collect()] == [1]
    synced = {r.external_product_id: (r.local_product_id, r.filled)
              for r in mapping.mapping_sync(items, mappings).collect()}
    assert synced == {1: (None, False), 2: (None, False), 3: (9, False)}


def test_local_product_labels(spark):
    rows = product_table(spark, (1, "A", "S", 1), (2, "A", "S", 1), (3, "A", "S", 2), (4, "A (inativo)", "S", 1))
    got = {r.label: r.id for r in mapping.local_products(rows).collect()}
    assert got == {"A": 2, "A (inativo)": 3}


PRICED = ("product_desc string, external_category string, type_of_load int, quantity decimal(10,3), "
          "price_unit decimal(10,2), created_at timestamp_ntz, order_items_value decimal(31,5), "
          "valor_faturado decimal(13,2)")


def test_price_average_rules(spark):
    d = Decimal
    rows = [
        ("A", "c", 0, d(2), d(10), None, d(20), d(30)),
        ("A", "c", 0, d(1), d(40), None, d(0), d(30)),
        ("B", None, 0, d(1), d(1), None, d(1), d(1)),
        ("B", "c", None, d(1), d(1), None, d(1), d(1)),
    ]
    row, = pricing.price_average(spark.createDataFrame(rows, PRICED)).collect()
    k = 0.85 * 0.06
    real = (2 * 10 * (1 + 0.5 + k) + 1 * 40 * (1 + 0 + k)) / 3
    assert (row.produto, row.tipo, row.qtd_total) == ("A", "Gelado", 3.0)
    assert row.preco_unit_medio == pytest.approx(20.0)
    assert row.preco_real_medio == pytest.approx(real)
    assert row.pct_custo == pytest.approx((real - 20) / 20 * 100)


def test_order_without_items(spark):
    orders = spark.createDataFrame(
        [(1, 11, 5, 1, 0, d, d, "p", d, "s", None) for d in [Decimal("1.00")]],
        "id bigint, platform_order_id bigint, vhsys bigint, platform_status int, type_of_load int, "
        "total decimal(12,2), product_invoice_value decimal(12,2), product_invoice_doc string, "
        "service_invoice_value decimal(12,2), service_invoice_doc string, loaded_at timestamp_ntz",
    )
    items = spark.createDataFrame([], schemas.TABLES["supplier_order_item"])
    summary = pricing.supplier_orders_summary(orders, items)
    kept = pricing.supplier_orders_filtered(summary, "2000-01-01", "2000-12-31")
    row = pricing.supplier_order_costs(kept).first()
    assert (row.total_items, row.items_value, row.valor_faturado) == (0, None, 2.0)
    assert (row.dif_icms, row.frete_imposto, row.preco_real, row.pct_custo) == (None,) * 4
    assert (row.status_desc, row.alerta) == ("Confirmado", "")


def documents(spark, *orders):
    rows = [(i, 0, *order) for i, order in enumerate(orders)]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.ORDER_DOCUMENT)
    return spark.createDataFrame(rows, f"arrival bigint, part int, {fields}")


def order(id_, invoices=None, items=None):
    return (id_, 1, 1, 0, 5, "10,00", "1,5", invoices, items)


def test_invoice_classes(spark):
    key = "3" * 20 + "-" + "1" * 24
    docs = documents(
        spark,
        order(1, [(key, "10,5", None), (key, "2.5", "P2"), ("uuid", "7", "S1"), (None, "1", "S2")]),
        order(2, [(key, "0", "P"), ("x" * 44, "abc", None)]),
        order(3, []), order(4, None),
        order(5, [(key, "0,005", "A"), (key, "0,005", "B")]),
    )
    got = {r.id: r[-4:] for r in ingest.classify_invoices(docs).collect()}
    d = Decimal
    assert got[1] == (d("13.00"), "P2", d("8.00"), "S1")
    assert got[2] == (None, "P", None, None)
    assert got[3] == got[4] == (None, None, None, None)
    assert got[5] == (d("0.01"), "A", None, None)


def test_orders_without_id_and_items(spark):
    item = (1, 9, "1", "2,5", "01-02-2024 00:00:00", None, 3, None)
    docs = documents(spark, order(0, None, [item]), order(None, None, [item]),
                     order(7, None, [item]), order(8, None, None))
    assert [r.platform_order_id for r in ingest.normalize_order_headers(docs).collect()] == [7, 8]
    row, = ingest.normalize_order_items(docs).collect()
    assert (row.external_product_name, row.external_category, row.price_unit) == ("", "", Decimal("2.50"))
    assert row.created_at == datetime.datetime(2024, 2, 1)
    assert ingest.flatten_platform_orders(docs).count() == 3


def test_first_product_name_wins(spark):
    def line(product, name):
        return (1, product, "1", "1", None, None, None, (name, None))

    docs = documents(spark, order(1, None, [line(5, "first"), line(0, "none"), line(None, "none")]),
                     order(2, None, [line(5, "second"), line(6, None)]))
    got = {r.external_product_id: r.external_name for r in ingest.extract_products(docs).collect()}
    assert got == {5: "first", 6: ""}
