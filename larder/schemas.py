"""Column types of the stored tables and of the supplier-order documents."""

from __future__ import annotations

from pyspark.sql import types as T

LONG, INT, TEXT, BOOL = T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType()
MOMENT = T.TimestampNTZType()
MONEY, PRICE, AMOUNT = T.DecimalType(12, 2), T.DecimalType(10, 2), T.DecimalType(10, 3)
RATE = T.DecimalType(10, 4)


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


TABLES: dict[str, T.StructType] = {
    "product": _table(
        id=LONG, product_name=TEXT, description=TEXT, product_type=TEXT, status=INT,
        product_size=TEXT, sort_order=INT, system_user=INT,
    ),
    "freezer": _table(id=LONG, freezer_name=TEXT),
    "status": _table(id=INT, status_code=TEXT),
    "freezer_position": _table(id=LONG, product=LONG, freezer=LONG, status=INT, update_date=MOMENT),
    "freezer_position_history": _table(id=LONG, product=LONG, change_date=MOMENT),
    "stock_minimum": _table(
        id=LONG, product=LONG, min_qty=INT, target_qty=INT, period_days=INT, updated_at=MOMENT,
    ),
    "purchase_order": _table(
        id=LONG, order_date=MOMENT, status=TEXT, period_days=INT, notes=TEXT, created_by=TEXT,
    ),
    "purchase_order_item": _table(
        id=LONG, order_id=LONG, product=LONG, current_stock=INT, min_qty=INT, target_qty=INT,
        avg_daily_consumption=RATE, suggested_qty=INT, confirmed_qty=INT,
        supplier_available=BOOL, supplier_price=PRICE, notes=TEXT,
    ),
    "product_exclude": _table(product_id=LONG, reason=TEXT),
    "product_mapping": _table(
        external_product_id=LONG, external_name=TEXT, local_product_id=LONG, updated_at=MOMENT,
    ),
    "supplier_order": _table(
        id=LONG, platform_order_id=LONG, store_id=LONG, platform_status=INT, total=MONEY,
        franchise_tax=MONEY, loaded_at=MOMENT, service_note=TEXT, type_of_load=INT, vhsys=LONG,
        product_invoice_value=MONEY, product_invoice_doc=TEXT,
        service_invoice_value=MONEY, service_invoice_doc=TEXT,
    ),
    "supplier_order_item": _table(
        id=LONG, order_id=LONG, platform_item_id=LONG, external_product_id=LONG,
        external_product_name=TEXT, external_category=TEXT, quantity=AMOUNT, price_unit=PRICE,
        local_product_id=LONG, created_at=MOMENT, nfe_bling_id=LONG, sale_order_bling_id=LONG,
    ),
    "supplier_availability": _table(product_id=LONG, available=BOOL, price=T.DoubleType()),
}

# Amounts come as numbers or as text with a decimal comma, so they are read as text.
INVOICE = _table(f2_chvnfe=TEXT, f2_valfat=TEXT, f2_doc=TEXT)
CATEGORY = _table(name=TEXT)
PRODUCT_INFO = _table(name=TEXT, category=CATEGORY)
ORDER_LINE = _table(
    id=LONG, product_id=LONG, quantity=TEXT, price_unit=TEXT, created_at=TEXT,
    nfe_bling_id=LONG, sale_order_bling_id=LONG, products=PRODUCT_INFO,
)
ORDER_DOCUMENT = _table(
    id=LONG, store_id=LONG, status=INT, type_of_load=INT, vhsys=LONG, total=TEXT,
    franchise_tax=TEXT, invoices=T.ArrayType(INVOICE), orderItems=T.ArrayType(ORDER_LINE),
)
ORDER_PAGE = _table(content=T.ArrayType(ORDER_DOCUMENT))

# Documents once their fields are typed: one row each, the header's fields in part 0.
TYPED_ITEM = _table(
    platform_item_id=LONG, external_product_id=LONG, external_product_name=TEXT,
    external_category=TEXT, quantity=AMOUNT, price_unit=PRICE, created_at=MOMENT,
    nfe_bling_id=LONG, sale_order_bling_id=LONG,
)
TYPED_HEADER = _table(
    platform_order_id=LONG, store_id=LONG, platform_status=INT, total=MONEY, franchise_tax=MONEY,
    vhsys=LONG, type_of_load=INT, product_invoice_value=MONEY, product_invoice_doc=TEXT,
    service_invoice_value=MONEY, service_invoice_doc=TEXT,
)
# What the items of an order add up to.
ORDER_TOTALS = _table(
    order_id=LONG, order_date=MOMENT, total_items=LONG, total_qty=T.DecimalType(20, 3),
    items_value=T.DecimalType(31, 5), unmapped_items=LONG,
)
# Parts of deliveries that are not whole yet.
PENDING = T.StructType(
    [
        *_table(delivery=LONG, part=INT, parts=INT, landed=T.TimestampType()).fields,
        *TYPED_HEADER.fields,
        T.StructField("items", T.ArrayType(TYPED_ITEM)),
    ]
)
