"""The same reports as plain SQL, for comparison in a second engine.

``{name}`` stands for a test table, a derived view or another query here; the full
text is put together as one WITH statement.
"""

from __future__ import annotations

from larder.plans.reports import DAYS, NUMBER_PREFIX, SEARCH
from larder.sources.testdata import (
    BASE_TABLES,
    CONSUMPTION_AS_OF,
    PLATFORM_AS_OF,
    RANGE_END,
    RANGE_START,
    VIEWS,
    names_in,
)

_FACTOR = "(CAST(0.85 AS DOUBLE) * CAST(0.06 AS DOUBLE))"
_LOAD = "CASE {0} WHEN 0 THEN 'Gelado' WHEN 1 THEN 'Seco' ELSE 'Desconhecido' END"
_BANNED = "IN (SELECT product_id FROM {product_exclude})"
_RECENT = f"change_date >= TIMESTAMP '{CONSUMPTION_AS_OF}' - INTERVAL {DAYS} DAY"
_IN_RANGE = f"BETWEEN DATE '{RANGE_START}' AND DATE '{RANGE_END}'"
_NOW = f"TIMESTAMP '{PLATFORM_AS_OF}'"


def _found(column: str) -> str:
    return f"COALESCE(regexp_matches({column}, '{SEARCH}', 'i'), FALSE)"


def _mean_2_digits(total: str, count: str) -> str:
    """total / count rounded half up to two digits, in integer arithmetic."""
    thousandths = f"CAST({total} * 1000 AS BIGINT)"
    return f"((200 * {thousandths} + 1000 * {count}) // (2000 * {count})) / 100.0"


# Pieces other queries use; amounts stay decimal here.
PIECES: dict[str, str] = {
    "q_used": f"""
        SELECT product, COUNT(*) AS units,
          CAST(ROUND(COUNT(*) / {DAYS}.0, 4) AS DECIMAL(18,4)) AS per_day
        FROM {{freezer_position_history}}
        WHERE {_RECENT} AND product NOT {_BANNED} GROUP BY product""",
    "q_position": """
        SELECT fp.*, st.status_code FROM {freezer_position} fp JOIN {status} st ON st.id = fp.status""",
    "q_boxes": """
        SELECT product, COUNT(*) AS held,
          COUNT(*) FILTER (WHERE status_code = 'OPEN') AS opened,
          COUNT(*) FILTER (WHERE status_code = 'CLOSED') AS closed
        FROM {q_position} GROUP BY product""",
    "q_platform": f"""
        SELECT m.local_product_id AS product,
          {_mean_2_digits('SUM(i.quantity)', 'COUNT(DISTINCT i.order_id)')} AS mean_qty
        FROM {{supplier_order_item}} i JOIN {{product_mapping}} m USING (external_product_id)
        WHERE i.created_at >= {_NOW} - INTERVAL 30 DAY GROUP BY m.local_product_id""",
    "q_suggest_facts": f"""
        SELECT p.id, COALESCE(m.external_name, p.description) AS product_desc,
          p.description AS local_desc, p.product_type,
          COALESCE(b.held, 0) AS total_positions, COALESCE(b.opened, 0) AS open_qty,
          COALESCE(b.closed, 0) AS closed_qty, COALESCE(s.min_qty, 0) AS min_qty,
          COALESCE(s.target_qty, 0) AS target_qty, COALESCE(u.units, 0) AS total_consumed,
          CAST(COALESCE(u.per_day, 0) AS DOUBLE) AS avg_daily_consumption,
          CAST(COALESCE(a.mean_qty, 0) AS DOUBLE) AS avg_platform_30d,
          CAST(CEIL(COALESCE(u.per_day, 0) * {DAYS}) AS BIGINT) AS need
        FROM {{product}} p
        LEFT JOIN {{q_boxes}} b ON b.product = p.id LEFT JOIN {{q_used}} u ON u.product = p.id
        LEFT JOIN {{stock_minimum}} s ON s.product = p.id
        LEFT JOIN {{product_mapping}} m ON m.local_product_id = p.id
        LEFT JOIN {{q_platform}} a ON a.product = p.id
        WHERE p.status = 1 AND p.id NOT {_BANNED}""",
    "q_suggest_every": """
        SELECT * EXCLUDE (need), CAST(
          CASE WHEN closed_qty > min_qty AND closed_qty >= need THEN 0
               ELSE GREATEST(target_qty, need, closed_qty) - closed_qty END AS BIGINT) AS suggested_qty
        FROM {q_suggest_facts}""",
    "q_suggest": "SELECT * FROM {q_suggest_every} WHERE total_positions > 0",
    "q_worklist": """
        SELECT *, GREATEST(target_qty - closed_qty, 0) AS min_para_alvo,
          GREATEST(target_qty - closed_qty, 0) AS confirmed_qty
        FROM {q_suggest} WHERE suggested_qty > 0""",
    "q_offered": """
        SELECT w.*, f.available AS supplier_available, CAST(f.price AS DOUBLE) AS supplier_price
        FROM {q_worklist} w LEFT JOIN {supplier_availability} f ON f.product_id = w.id""",
    "q_purchase": """
        SELECT o.*, (SELECT COUNT(*) FROM {purchase_order_item} i WHERE i.order_id = o.id) AS total_items,
          CAST(COALESCE((SELECT SUM(i.confirmed_qty) FROM {purchase_order_item} i
                         WHERE i.order_id = o.id), 0) AS BIGINT) AS total_qty
        FROM {purchase_order} o""",
    "q_request": """
        SELECT r.order_id, o.status AS from_status, r.new_status,
          COALESCE(o.status || '>' || r.new_status IN ('RASCUNHO>CONFIRMADO', 'CONFIRMADO>ENVIADO',
            'CONFIRMADO>RASCUNHO', 'ENVIADO>RECEBIDO', 'ENVIADO>CONFIRMADO'), FALSE) AS legal
        FROM {order_status_request} r LEFT JOIN {purchase_order} o ON o.id = r.order_id""",
    "q_config": f"""
        SELECT p.id, p.description AS product_desc, p.product_type, p.status AS status_id,
          COUNT(DISTINCT x.id) AS total_positions,
          COUNT(DISTINCT x.id) FILTER (WHERE x.status_code = 'OPEN') AS open_qty,
          COUNT(DISTINCT x.id) FILTER (WHERE x.status_code = 'CLOSED') AS closed_qty,
          ANY_VALUE(h.latest) AS last_movement, p.id {_BANNED} AS excluir_calculos
        FROM {{product}} p
        LEFT JOIN (SELECT f.*, st.status_code FROM {{freezer_position}} f
                   LEFT JOIN {{status}} st ON st.id = f.status) x ON x.product = p.id
        LEFT JOIN (SELECT product, MAX(change_date) AS latest FROM {{freezer_position_history}}
                   GROUP BY product) h ON h.product = p.id
        GROUP BY p.id, p.description, p.product_type, p.status""",
    "q_flags": """
        SELECT e.id, e.ativo, e.excluir_calculos, e.ativo <> (c.status_id = 1) AS ativo_changed,
          e.excluir_calculos <> c.excluir_calculos AS excluir_changed
        FROM {product_flag_edit} e JOIN {q_config} c ON c.id = e.id
        WHERE e.ativo <> (c.status_id = 1) OR e.excluir_calculos <> c.excluir_calculos""",
    "q_new_product": """
        SELECT (SELECT MAX(id) FROM {product}) + ROW_NUMBER() OVER (ORDER BY seq % 1009, seq) AS id,
          TRIM(product_name) AS product_name, TRIM(description) AS description, product_type,
          1 AS status, TRIM(product_size) AS product_size,
          CASE WHEN sort_order > 0 THEN sort_order END AS sort_order, 1 AS system_user, excluir
        FROM {product_new} WHERE TRIM(product_name) <> '' AND TRIM(description) <> ''""",
    "q_product_after": """
        SELECT p.id, p.description, p.product_type,
          CASE WHEN e.ativo THEN 1 WHEN NOT e.ativo THEN 2 ELSE p.status END AS status
        FROM {product} p LEFT JOIN {product_flag_edit} e ON e.id = p.id WHERE p.id % 13 <> 5
        UNION ALL SELECT id, description, product_type, status FROM {q_new_product}""",
    "q_product_fields": """
        SELECT COALESCE(b.id, a.id) AS id,
          CASE WHEN b.id IS NULL THEN 'inserted' WHEN a.id IS NULL THEN 'deleted' ELSE 'changed' END AS change,
          unnest(['description', 'product_type', 'status']) AS field,
          unnest([b.description, b.product_type, CAST(b.status AS VARCHAR)]) AS old,
          unnest([a.description, a.product_type, CAST(a.status AS VARCHAR)]) AS new
        FROM {product} b FULL JOIN {q_product_after} a ON a.id = b.id""",
    "q_summary": """
        SELECT o.id, o.platform_order_id, o.vhsys, o.platform_status, o.type_of_load,
          CAST(o.total AS DOUBLE) AS total,
          CAST(o.product_invoice_value AS DOUBLE) AS product_invoice_value, o.product_invoice_doc,
          CAST(o.service_invoice_value AS DOUBLE) AS service_invoice_value, o.service_invoice_doc,
          o.loaded_at, x.order_date, COALESCE(x.n, 0) AS total_items,
          CAST(x.qty AS DOUBLE) AS total_qty, CAST(ROUND(x.value, 2) AS DOUBLE) AS items_value,
          COALESCE(x.unmapped, 0) AS unmapped_items
        FROM {supplier_order} o LEFT JOIN (
          SELECT order_id, MIN(created_at) AS order_date, COUNT(id) AS n, SUM(quantity) AS qty,
            SUM(quantity * price_unit) AS value,
            COUNT(*) FILTER (WHERE local_product_id IS NULL
              AND LOWER(external_category) IN ('sorvetes', 'acai')) AS unmapped
          FROM {supplier_order_item} GROUP BY order_id) x ON x.order_id = o.id""",
    "q_supplier_item": """
        SELECT i.id, i.order_id, i.external_product_id, i.external_product_name,
          i.external_category, CAST(i.quantity AS DOUBLE) AS quantity,
          CAST(i.price_unit AS DOUBLE) AS price_unit, i.created_at, i.local_product_id,
          p.description AS local_product_desc
        FROM {supplier_order_item} i LEFT JOIN {product} p ON p.id = i.local_product_id""",
    "q_priced": f"""
        SELECT COALESCE(p.description, i.external_product_name) AS product_desc,
          i.external_category, o.type_of_load, CAST(i.quantity AS DOUBLE) AS quantity,
          CAST(i.price_unit AS DOUBLE) AS price_unit, i.created_at,
          CAST((SELECT SUM(a.quantity * a.price_unit) FROM {{supplier_order_item}} a
                WHERE a.order_id = i.order_id) AS DOUBLE) AS order_items_value,
          CAST(o.product_invoice_value + o.service_invoice_value AS DOUBLE) AS valor_faturado
        FROM {{supplier_order}} o JOIN {{supplier_order_item}} i ON i.order_id = o.id
        LEFT JOIN {{product}} p ON p.id = i.local_product_id
        WHERE o.product_invoice_value + o.service_invoice_value IS NOT NULL
          AND CAST(i.created_at AS DATE) {_IN_RANGE}""",
    "q_average_sums": f"""
        SELECT product_desc, type_of_load, external_category, SUM(quantity) AS q,
          SUM(quantity * price_unit) AS unit_sum,
          SUM(quantity * (price_unit * (1.0::DOUBLE + CASE WHEN order_items_value = 0 THEN 0
            ELSE (valor_faturado - order_items_value) / order_items_value END + {_FACTOR}))) AS real_sum
        FROM {{q_priced}}
        WHERE product_desc IS NOT NULL AND external_category IS NOT NULL AND type_of_load IS NOT NULL
        GROUP BY ALL""",
    "q_average": f"""
        SELECT product_desc AS produto, {_LOAD.format('type_of_load')} AS tipo,
          external_category AS categoria, q AS qtd_total, unit_sum / NULLIF(q, 0) AS preco_unit_medio,
          real_sum / NULLIF(q, 0) - unit_sum / NULLIF(q, 0) AS dif_por_caixa,
          real_sum / NULLIF(q, 0) AS preco_real_medio,
          (real_sum / NULLIF(q, 0) - unit_sum / NULLIF(q, 0))
            / NULLIF(unit_sum / NULLIF(q, 0), 0) * 100 AS pct_custo
        FROM {{q_average_sums}}""",
    "q_average_shown": f"""
        SELECT * FROM {{q_average}} WHERE tipo = 'Gelado' AND {_found('produto')}""",
    "q_frequency": f"""
        SELECT COALESCE(p.description, i.external_product_name) AS product_desc,
          i.external_category, o.type_of_load, COUNT(DISTINCT o.id) AS num_pedidos,
          CAST(SUM(i.quantity) AS DOUBLE) AS qty_total,
          CAST({_mean_2_digits('SUM(i.quantity)', 'COUNT(DISTINCT o.id)')} AS DOUBLE) AS qty_media
        FROM {{supplier_order_item}} i JOIN {{supplier_order}} o ON o.id = i.order_id
        LEFT JOIN {{product}} p ON p.id = i.local_product_id
        WHERE CAST(i.created_at AS DATE) {_IN_RANGE} GROUP BY 1, 2, 3""",
    "q_share": f"""
        SELECT product_desc AS produto, {_LOAD.format('type_of_load')} AS tipo,
          external_category AS categoria, num_pedidos,
          round_even(CAST(num_pedidos AS DOUBLE)
            / (SELECT MAX(num_pedidos) FROM {{q_frequency}}) * 100, 1) AS pct_pedidos,
          qty_total, qty_media
        FROM {{q_frequency}}""",
    # Documents
    "q_invoice": """
        SELECT arrival, pos, f2_doc AS doc,
          COALESCE(TRY_CAST(REPLACE(f2_valfat, ',', '.') AS DECIMAL(24,6)), 0) AS amount,
          regexp_full_match(REPLACE(COALESCE(f2_chvnfe, ''), '-', ''), '[0-9]{{44}}') AS goods
        FROM {raw_order_invoice}""",
    "q_invoices": """
        SELECT arrival,
          CAST(NULLIF(SUM(amount) FILTER (WHERE goods), 0) AS DECIMAL(12,2)) AS goods_value,
          ARG_MIN(doc, pos) FILTER (WHERE goods AND doc IS NOT NULL) AS goods_doc,
          CAST(NULLIF(SUM(amount) FILTER (WHERE NOT goods), 0) AS DECIMAL(12,2)) AS service_value,
          ARG_MIN(doc, pos) FILTER (WHERE NOT goods AND doc IS NOT NULL) AS service_doc
        FROM {q_invoice} GROUP BY arrival""",
    "q_header": """
        SELECT h.arrival, h.id AS platform_order_id, h.store_id, h.status AS platform_status,
          TRY_CAST(REPLACE(h.total, ',', '.') AS DECIMAL(12,2)) AS total,
          TRY_CAST(REPLACE(h.franchise_tax, ',', '.') AS DECIMAL(12,2)) AS franchise_tax,
          h.vhsys, h.type_of_load, v.goods_value AS product_invoice_value,
          v.goods_doc AS product_invoice_doc, v.service_value AS service_invoice_value,
          v.service_doc AS service_invoice_doc
        FROM {raw_order_header} h LEFT JOIN {q_invoices} v USING (arrival)
        WHERE COALESCE(h.id, 0) <> 0""",
    "q_item": """
        SELECT h.arrival, h.id AS platform_order_id, i.id AS platform_item_id,
          CAST(i.product_id // 1000 + 1 AS INT) AS part,
          CAST(ROW_NUMBER() OVER (PARTITION BY h.arrival, i.product_id // 1000 ORDER BY i.id,
            i.product_id, i.line_source, i.created_at, i.quantity, i.price_unit) - 1 AS INT) AS pos,
          i.product_id AS external_product_id, i.product_name AS external_product_name,
          i.category_name AS external_category,
          TRY_CAST(REPLACE(i.quantity, ',', '.') AS DECIMAL(10,3)) AS quantity,
          TRY_CAST(REPLACE(i.price_unit, ',', '.') AS DECIMAL(10,2)) AS price_unit,
          TRY_STRPTIME(i.created_at, '%d-%m-%Y %H:%M:%S') AS created_at,
          i.nfe_bling_id, i.sale_order_bling_id
        FROM {raw_order_header} h JOIN {raw_order_item} i USING (src_key)
        WHERE COALESCE(h.id, 0) <> 0""",
    "q_numbered": """
        SELECT *, ROW_NUMBER() OVER (PARTITION BY platform_order_id ORDER BY arrival) AS copy,
          ROW_NUMBER() OVER (PARTITION BY platform_order_id ORDER BY arrival DESC) AS copy_back,
          platform_order_id IN (SELECT platform_order_id FROM {supplier_order}) AS known
        FROM {q_header}""",
    "q_new_id": """
        SELECT platform_order_id, (SELECT MAX(id) FROM {supplier_order})
          + ROW_NUMBER() OVER (ORDER BY platform_order_id % 1009, platform_order_id) AS id
        FROM {q_numbered} WHERE copy = 1 AND NOT known""",
    "q_kept": """
        SELECT platform_order_id,
          ARG_MAX(vhsys, arrival) FILTER (WHERE vhsys IS NOT NULL) AS vhsys,
          ARG_MAX(type_of_load, arrival) FILTER (WHERE type_of_load IS NOT NULL) AS type_of_load,
          ARG_MAX(product_invoice_value, arrival)
            FILTER (WHERE product_invoice_value IS NOT NULL) AS piv,
          ARG_MAX(product_invoice_doc, arrival)
            FILTER (WHERE product_invoice_doc IS NOT NULL) AS pid,
          ARG_MAX(service_invoice_value, arrival)
            FILTER (WHERE service_invoice_value IS NOT NULL) AS siv,
          ARG_MAX(service_invoice_doc, arrival)
            FILTER (WHERE service_invoice_doc IS NOT NULL) AS sid
        FROM {q_header} GROUP BY platform_order_id""",
    "q_stream_items": """
        SELECT i.arrival, COUNT(*) AS total_items, CAST(SUM(i.quantity) AS DOUBLE) AS total_qty,
          CAST(SUM(CASE WHEN c.n > 1 THEN COALESCE(r.nfe, i.nfe_bling_id)
                        ELSE i.nfe_bling_id END) AS BIGINT) AS nfe_sum
        FROM {q_item} i
        JOIN (SELECT platform_order_id, COUNT(*) AS n FROM {q_header} GROUP BY 1) c
          ON c.platform_order_id = i.platform_order_id
        LEFT JOIN (SELECT arrival, platform_item_id, ARG_MAX(nfe_bling_id, (part, pos))
                     FILTER (WHERE nfe_bling_id IS NOT NULL) AS nfe
                   FROM {q_item} GROUP BY 1, 2) r
          ON r.arrival = i.arrival AND r.platform_item_id = i.platform_item_id
        GROUP BY i.arrival""",
    "q_item_target": """
        SELECT order_id, platform_item_id, arrival, part, pos, nfe_bling_id, sale_order_bling_id
        FROM (SELECT i.*, COALESCE(o.id, n.id) AS order_id,
                o.id IS NULL AND i.arrival = f.arrival AS inserting
              FROM {q_item} i JOIN {q_numbered} f
                ON f.platform_order_id = i.platform_order_id AND f.copy = 1
              LEFT JOIN {supplier_order} o ON o.platform_order_id = i.platform_order_id
              LEFT JOIN {q_new_id} n ON n.platform_order_id = i.platform_order_id)
        WHERE NOT inserting""",
    "q_new_item": """
        SELECT CAST(ROW_NUMBER() OVER (ORDER BY
            ((i.platform_order_id % 1009) * 31 + i.part * 7 + i.pos) % 1009,
            i.platform_order_id, i.part, i.pos) AS VARCHAR) AS id,
          n.id AS order_id, i.platform_item_id,
          i.external_product_id, i.external_product_name, i.external_category, i.quantity,
          i.price_unit, CAST(NULL AS BIGINT) AS local_product_id, i.created_at, i.nfe_bling_id,
          i.sale_order_bling_id
        FROM {q_item} i JOIN {q_new_id} n USING (platform_order_id)
        JOIN {q_numbered} f ON f.platform_order_id = i.platform_order_id
          AND f.copy = 1 AND f.arrival = i.arrival""",
    "q_relinked": """
        SELECT order_id, platform_item_id,
          ARG_MAX(nfe_bling_id, (arrival, part, pos)) FILTER (WHERE nfe_bling_id IS NOT NULL) AS nfe,
          ARG_MAX(sale_order_bling_id, (arrival, part, pos))
            FILTER (WHERE sale_order_bling_id IS NOT NULL) AS sale
        FROM {q_item_target} WHERE platform_item_id IS NOT NULL GROUP BY 1, 2""",
}

_ORDER_COLUMNS = """s.id, s.platform_order_id, s.store_id, {status} AS platform_status,
          CAST({total} AS DOUBLE) AS total, CAST(s.franchise_tax AS DOUBLE) AS franchise_tax,
          s.loaded_at, {load} AS type_of_load, {vhsys} AS vhsys,
          CAST({piv} AS DOUBLE) AS product_invoice_value, {pid} AS product_invoice_doc,
          CAST({siv} AS DOUBLE) AS service_invoice_value, {sid} AS service_invoice_doc"""

_STORED = _ORDER_COLUMNS.format(
    status="s.platform_status", total="s.total", load="s.type_of_load", vhsys="s.vhsys",
    piv="s.product_invoice_value", pid="s.product_invoice_doc",
    siv="s.service_invoice_value", sid="s.service_invoice_doc",
)
_UPSERTED = _ORDER_COLUMNS.format(
    status="CASE WHEN l.arrival IS NULL THEN s.platform_status ELSE l.platform_status END",
    total="CASE WHEN l.arrival IS NULL THEN s.total ELSE l.total END",
    load="COALESCE(k.type_of_load, s.type_of_load)", vhsys="COALESCE(k.vhsys, s.vhsys)",
    piv="COALESCE(k.piv, s.product_invoice_value)", pid="COALESCE(k.pid, s.product_invoice_doc)",
    siv="COALESCE(k.siv, s.service_invoice_value)", sid="COALESCE(k.sid, s.service_invoice_doc)",
)

PIECES["q_orders_after_insert"] = f"""
        SELECT s.*, CASE WHEN s.platform_order_id IN (SELECT platform_order_id FROM {{q_header}})
          THEN 'skipped' ELSE 'unchanged' END AS action FROM {{supplier_order}} s
        UNION ALL BY NAME
        SELECT n.id, f.* EXCLUDE (arrival, copy, copy_back, known), {_NOW} AS loaded_at,
          'inserted' AS action
        FROM {{q_numbered}} f JOIN {{q_new_id}} n USING (platform_order_id) WHERE f.copy = 1"""

_ITEM_COLUMNS = """id, order_id, platform_item_id, external_product_id, external_product_name,
          external_category, CAST(quantity AS DOUBLE) AS quantity,
          CAST(price_unit AS DOUBLE) AS price_unit, local_product_id, created_at"""

PIECES["q_items_after_insert"] = """
        SELECT *, 'unchanged' AS action FROM {supplier_order_item}
        UNION ALL BY NAME SELECT *, 'inserted' AS action FROM {q_new_item}"""



def _rounded(value: str, name: str) -> str:
    """Four digits; the small addend keeps exact ties from going either way."""
    return f"ROUND({value} + 1e-9, 4) AS {name}"


PRICE_COLUMNS = "produto, tipo, categoria, " + ", ".join(
    _rounded(name, name)
    for name in ("qtd_total", "preco_unit_medio", "dif_por_caixa", "preco_real_medio", "pct_custo")
)

UNIQUE = [
    ("product", "id", "product"), ("freezer_position", "id", "freezer_position"),
    ("stock_minimum", "product", "stock_minimum"),
    ("product_exclude", "product_id", "product_exclude"),
    ("product_mapping", "external_product_id", "product_mapping"),
    ("supplier_order", "platform_order_id", "supplier_order"),
    ("supplier_order_item", "id", "supplier_order_item"),
    ("local_mapping", "local_product_id", "product_mapping"),
]
REQUIRED = [
    ("supplier_order", "loaded_at"), ("supplier_order_item", "order_id"),
    ("product_mapping", "external_name"), ("purchase_order", "status"),
]
REFERENCES = [
    ("supplier_order_item", "order_id", "supplier_order"),
    ("supplier_order_item", "local_product_id", "product"),
    ("purchase_order_item", "order_id", "purchase_order"),
    ("purchase_order_item", "product", "product"),
    ("product_mapping", "local_product_id", "product"),
    ("product_exclude", "product_id", "product"),
    ("stock_minimum", "product", "product"),
    ("freezer_position_history", "product", "product"),
]


def _constraint_sql() -> str:
    rows = [
        f"SELECT '{name}' AS table_name, 'unique {key}' AS rule, "
        f"COUNT({key}) - COUNT(DISTINCT {key}) AS violations FROM {{{table}}}"
        for name, key, table in UNIQUE
    ]
    rows += [
        f"SELECT '{t}', 'required {c}', COUNT(*) - COUNT({c}) FROM {{{t}}}" for t, c in REQUIRED
    ]
    rows += [
        f"SELECT '{t}', 'reference {c}', COUNT(*) FROM {{{t}}} x "
        f"WHERE x.{c} IS NOT NULL AND x.{c} NOT IN (SELECT id FROM {{{parent}}})"
        for t, c, parent in REFERENCES
    ]
    return " UNION ALL ".join(rows)


QUERIES: dict[str, str] = {
    "empty_positions_count": """
        SELECT COUNT(*) AS empty_positions FROM {q_position} x JOIN {product} p ON p.id = x.product
        WHERE x.status_code = 'CLOSED' AND p.product_type = 'Vazio'""",
    "current_stock": f"""
        SELECT p.id, p.description AS product_desc, p.product_type, f.id AS freezer_id,
          f.freezer_name, COUNT(*) AS total_positions,
          COUNT(*) FILTER (WHERE x.status_code = 'OPEN') AS open_qty,
          COUNT(*) FILTER (WHERE x.status_code = 'CLOSED') AS closed_qty,
          MAX(x.update_date) AS last_update
        FROM {{q_position}} x JOIN {{product}} p ON p.id = x.product
        JOIN {{freezer}} f ON f.id = x.freezer WHERE p.id NOT {_BANNED} GROUP BY 1, 2, 3, 4, 5""",
    "stock_metrics": f"""
        SELECT COUNT(DISTINCT p.id) AS products,
          COUNT(*) FILTER (WHERE x.status_code = 'OPEN') AS open_qty,
          COUNT(*) FILTER (WHERE x.status_code = 'CLOSED') AS closed_qty
        FROM {{q_position}} x JOIN {{product}} p ON p.id = x.product
        JOIN {{freezer}} f ON f.id = x.freezer
        WHERE p.id NOT {_BANNED} AND {_found('p.description')}""",
    "consumption_summary": """
        SELECT p.id, p.description AS product_desc, p.product_type, u.units AS total_consumed,
          CAST(u.per_day AS DOUBLE) AS avg_daily_consumption
        FROM {q_used} u JOIN {product} p ON p.id = u.product""",
    "consumption_weekly": f"""
        SELECT CAST(DATE_TRUNC('week', h.change_date) AS DATE) AS week,
          p.description AS product_desc, p.product_type, COUNT(*) AS consumed
        FROM {{freezer_position_history}} h JOIN {{product}} p ON p.id = h.product
        WHERE {_RECENT} AND p.id NOT {_BANNED} GROUP BY 1, 2, 3""",
    "consumption_total": """
        SELECT CAST(COALESCE(SUM(total_consumed), 0) AS BIGINT) AS total_consumed
        FROM {consumption_summary}""",
    "top_consumed": "SELECT * FROM {consumption_summary} ORDER BY total_consumed DESC, id LIMIT 15",
    "top_products_weekly": """
        SELECT * FROM {consumption_weekly} WHERE product_desc IN (
          SELECT product_desc FROM (SELECT * FROM {consumption_summary}
                                    ORDER BY total_consumed DESC, id LIMIT 8))""",
    "stock_minimum_config": """
        SELECT p.id AS product_id, p.description AS product_desc, p.product_type,
          COALESCE(s.min_qty, 0) AS min_qty, COALESCE(s.target_qty, 0) AS target_qty,
          COALESCE(s.period_days, 30) AS period_days, s.updated_at
        FROM {product} p LEFT JOIN {stock_minimum} s ON s.product = p.id
        WHERE p.id IN (SELECT product FROM {freezer_position})""",
    "stock_minimum_validate": """
        SELECT *, target_qty >= min_qty AS accepted FROM {stock_minimum_edit}""",
    "stock_minimum_upsert": f"""
        SELECT COALESCE(e.product_id, s.product) AS product,
          COALESCE(e.min_qty, s.min_qty) AS min_qty, COALESCE(e.target_qty, s.target_qty) AS target_qty,
          COALESCE(e.period_days, s.period_days) AS period_days,
          CASE WHEN e.product_id IS NULL THEN s.updated_at
               ELSE TIMESTAMP '{CONSUMPTION_AS_OF}' END AS updated_at,
          CASE WHEN e.product_id IS NULL THEN 'unchanged' WHEN s.product IS NULL THEN 'inserted'
               ELSE 'updated' END AS action
        FROM {{stock_minimum}} s FULL JOIN (
          SELECT * FROM {{stock_minimum_edit}} WHERE target_qty >= min_qty) e
          ON e.product_id = s.product""",
    "products_config": "SELECT * FROM {q_config}",
    "products_metrics": """
        SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE status_id = 1) AS ativos,
          COUNT(*) FILTER (WHERE status_id <> 1) AS inativos,
          COUNT(*) FILTER (WHERE excluir_calculos) AS excluidos FROM {q_config}""",
    "products_filtered": f"""
        SELECT *, status_id = 1 AS ativo FROM {{q_config}}
        WHERE status_id = 1 AND {_found('product_desc')}""",
    "products_filtered_excluded": """
        SELECT *, status_id = 1 AS ativo FROM {q_config} WHERE excluir_calculos""",
    "product_flags_diff": "SELECT * FROM {q_flags}",
    "product_flags_counts": """
        SELECT COUNT(*) FILTER (WHERE ativo_changed AND ativo) AS ativados,
          COUNT(*) FILTER (WHERE ativo_changed AND NOT ativo) AS desativados,
          COUNT(*) FILTER (WHERE excluir_changed AND excluir_calculos) AS excluidos,
          COUNT(*) FILTER (WHERE excluir_changed AND NOT excluir_calculos) AS incluidos
        FROM {q_flags}""",
    "product_status_update": """
        SELECT p.* REPLACE (CASE e.ativo WHEN TRUE THEN 1 WHEN FALSE THEN 2
                            ELSE p.status END AS status)
        FROM {product} p LEFT JOIN {product_flag_edit} e ON e.id = p.id""",
    "product_exclude_apply": """
        SELECT product_id, reason FROM {product_exclude}
        WHERE product_id NOT IN (SELECT id FROM {product_flag_edit})
        UNION ALL
        SELECT id, 'Produto placeholder (Vazio/Balde) — excluido de calculos'
        FROM {product_flag_edit} WHERE excluir_calculos""",
    "product_insert": "SELECT * FROM {q_new_product}",
    "product_insert_exclusions": """
        SELECT id AS product_id, 'Cadastrado como placeholder' AS reason
        FROM {q_new_product} WHERE excluir""",
    "order_suggestions": "SELECT * FROM {q_suggest}",
    "order_suggestions_all": "SELECT * FROM {q_suggest_every}",
    "order_worklist": "SELECT * FROM {q_worklist}",
    "suggestion_metrics": """
        SELECT COUNT(*) AS analysed, COUNT(*) FILTER (WHERE suggested_qty > 0) AS needs_order,
          CAST(COALESCE(SUM(closed_qty), 0) AS BIGINT) AS closed_qty FROM {q_suggest}""",
    "supplier_availability_join": "SELECT * FROM {q_offered}",
    "supplier_availability_counts": """
        SELECT COUNT(DISTINCT CASE WHEN supplier_available THEN id END) AS available,
          COUNT(*) AS checked FROM {q_offered}""",
    "order_below_target": """
        SELECT * FROM (
          SELECT w.* REPLACE (COALESCE(e.confirmed_qty, w.confirmed_qty) AS confirmed_qty)
          FROM {q_worklist} w LEFT JOIN {order_edit} e ON e.product_id = w.id)
        WHERE confirmed_qty BETWEEN 1 AND min_para_alvo - 1""",
    "purchase_order_build": f"""
        SELECT (SELECT MAX(id) FROM {{purchase_order}}) + 1 AS order_id,
          TIMESTAMP '{CONSUMPTION_AS_OF}' AS order_date, 'RASCUNHO' AS status,
          {DAYS} AS period_days, 'weekly order' AS notes, 'ana' AS created_by, id AS product,
          closed_qty AS current_stock, min_qty, target_qty, avg_daily_consumption, suggested_qty,
          confirmed_qty, supplier_available, supplier_price
        FROM {{q_offered}} WHERE confirmed_qty > 0 AND NOT EXISTS (
          SELECT 1 FROM {{q_offered}} b WHERE b.confirmed_qty > 0 AND b.confirmed_qty < b.min_para_alvo)""",
    "purchase_orders_summary": "SELECT * FROM {q_purchase}",
    "purchase_orders_summary_drafts": "SELECT * FROM {q_purchase} WHERE status = 'RASCUNHO'",
    "purchase_order_metrics": """
        SELECT COUNT(*) AS orders, CAST(COALESCE(SUM(total_items), 0) AS BIGINT) AS items,
          CAST(COALESCE(SUM(total_qty), 0) AS BIGINT) AS units FROM {q_purchase}""",
    "purchase_order_items": """
        SELECT i.order_id, p.description AS product_desc, p.product_type, i.current_stock,
          i.min_qty, i.target_qty, CAST(i.avg_daily_consumption AS DOUBLE) AS avg_daily_consumption,
          i.suggested_qty, i.confirmed_qty, i.supplier_available,
          CAST(i.supplier_price AS DOUBLE) AS supplier_price, i.notes
        FROM {purchase_order_item} i JOIN {product} p ON p.id = i.product""",
    "order_status_apply": """
        SELECT o.* REPLACE (COALESCE(r.new_status, o.status) AS status),
          r.new_status IS NOT NULL AS status_changed
        FROM {purchase_order} o LEFT JOIN {q_request} r ON r.order_id = o.id AND r.legal""",
    "order_status_rejected": """
        SELECT order_id, from_status, new_status FROM {q_request} WHERE NOT legal""",
    "flatten_platform_orders": """
        SELECT h.id AS order_id, h.status, h.total, i.product_id, i.product_name AS product,
          i.category_name AS category, i.quantity, i.price_unit, i.created_at
        FROM {raw_order_header} h JOIN {raw_order_item} i USING (src_key)""",
    "extract_products": """
        SELECT DISTINCT i.product_id AS external_product_id, i.product_name AS external_name
        FROM {raw_order_header} h JOIN {raw_order_item} i USING (src_key) WHERE i.product_id <> 0""",
    "classify_invoices": """
        SELECT h.arrival, h.id, CAST(v.goods_value AS DOUBLE) AS product_invoice_value,
          v.goods_doc AS product_invoice_doc, CAST(v.service_value AS DOUBLE) AS service_invoice_value,
          v.service_doc AS service_invoice_doc
        FROM {raw_order_header} h LEFT JOIN {q_invoices} v USING (arrival)""",
    "normalize_order_headers": """
        SELECT * REPLACE (CAST(total AS DOUBLE) AS total, CAST(franchise_tax AS DOUBLE) AS franchise_tax,
          CAST(product_invoice_value AS DOUBLE) AS product_invoice_value,
          CAST(service_invoice_value AS DOUBLE) AS service_invoice_value) FROM {q_header}""",
    "normalize_order_items": """
        SELECT * REPLACE (CAST(quantity AS DOUBLE) AS quantity, CAST(price_unit AS DOUBLE) AS price_unit)
        FROM {q_item}""",
    "merge_orders_insert_only": f"SELECT {_STORED}, s.action FROM {{q_orders_after_insert}} s",
    "merge_orders_update": f"""
        SELECT {_UPSERTED}, CASE WHEN s.action = 'skipped' THEN 'updated' ELSE s.action END AS action
        FROM {{q_orders_after_insert}} s
        LEFT JOIN {{q_numbered}} l ON l.platform_order_id = s.platform_order_id AND l.copy_back = 1
        LEFT JOIN {{q_kept}} k ON k.platform_order_id = s.platform_order_id""",
    "merge_order_items": f"""
        SELECT {_ITEM_COLUMNS}, COALESCE(r.nfe, nfe_bling_id) AS nfe_bling_id,
          COALESCE(r.sale, sale_order_bling_id) AS sale_order_bling_id,
          CASE WHEN action = 'unchanged' AND r.order_id IS NOT NULL THEN 'updated'
               ELSE action END AS action
        FROM {{q_items_after_insert}} LEFT JOIN {{q_relinked}} r USING (order_id, platform_item_id)""",
    "merge_order_items_insert_only": f"""
        SELECT {_ITEM_COLUMNS}, nfe_bling_id, sale_order_bling_id, action
        FROM {{q_items_after_insert}}""",
    "order_load_metrics": """
        SELECT 'insert' AS mode, COUNT(*) FILTER (WHERE copy = 1 AND NOT known) AS inserted,
          CAST(0 AS BIGINT) AS updated, COUNT(*) FILTER (WHERE copy > 1 OR known) AS skipped
        FROM {q_numbered}
        UNION ALL
        SELECT 'update', COUNT(*) FILTER (WHERE copy = 1 AND NOT known),
          COUNT(*) FILTER (WHERE copy > 1 OR known), CAST(0 AS BIGINT) FROM {q_numbered}""",
    "order_load_observed": "SELECT * FROM {order_load_metrics}",
    "product_mapping_list": """
        SELECT m.external_product_id, m.external_name, m.local_product_id,
          p.description AS local_product_desc
        FROM {product_mapping} m LEFT JOIN {product} p ON p.id = m.local_product_id""",
    "product_mapping_upsert": f"""
        SELECT external_product_id, external_name, local_product_id, {_NOW} AS updated_at,
          CASE WHEN external_product_id IN (SELECT external_product_id FROM {{product_mapping}})
               THEN 'updated' ELSE 'inserted' END AS action
        FROM {{product_mapping_edit}}
        UNION ALL
        SELECT external_product_id, external_name, local_product_id, updated_at, 'unchanged'
        FROM {{product_mapping}} WHERE external_product_id NOT IN (
          SELECT external_product_id FROM {{product_mapping_edit}})""",
    "mapping_sync": """
        SELECT i.* REPLACE (CAST(i.quantity AS DOUBLE) AS quantity,
            CAST(i.price_unit AS DOUBLE) AS price_unit,
            COALESCE(i.local_product_id, m.local_product_id) AS local_product_id),
          i.local_product_id IS NULL AND m.local_product_id IS NOT NULL AS filled
        FROM {supplier_order_item} i LEFT JOIN {product_mapping} m USING (external_product_id)""",
    "mapping_sync_count": """
        SELECT COUNT(*) AS updated FROM {supplier_order_item} i
        JOIN {product_mapping} m USING (external_product_id)
        WHERE i.local_product_id IS NULL AND m.local_product_id IS NOT NULL""",
    "local_products": """
        SELECT label, id, description, status FROM (
          SELECT *, ROW_NUMBER() OVER (PARTITION BY label
                                       ORDER BY status DESC, description DESC, id DESC) AS r
          FROM (SELECT *, CASE status WHEN 1 THEN description
                          ELSE description || ' (inativo)' END AS label FROM {product}))
        WHERE r = 1""",
    "unmapped_products": """
        SELECT DISTINCT i.external_product_id, i.external_product_name, i.external_category
        FROM {supplier_order_item} i
        WHERE LOWER(i.external_category) IN ('sorvetes', 'acai') AND i.external_product_id NOT IN (
          SELECT external_product_id FROM {product_mapping} WHERE local_product_id IS NOT NULL)""",
    "supplier_orders_summary": "SELECT * FROM {q_summary}",
    "supplier_orders_summary_dry": "SELECT * FROM {q_summary} WHERE type_of_load = 1",
    "supplier_orders_filtered": f"""
        SELECT * FROM {{q_summary}}
        WHERE COALESCE(CAST(order_date AS DATE) {_IN_RANGE}, TRUE)
          AND COALESCE(CAST(NULLIF(vhsys, 0) AS VARCHAR), '') LIKE '{NUMBER_PREFIX}%'""",
    "supplier_order_costs": f"""
        SELECT * EXCLUDE (invoiced, both_there),
          CASE platform_status WHEN 1 THEN 'Confirmado' WHEN 2 THEN 'Em trânsito'
            WHEN 3 THEN 'Finalizado' WHEN 4 THEN 'Cancelado' WHEN 5 THEN 'Em estoque'
            WHEN 7 THEN 'Em Separação' ELSE CAST(platform_status AS VARCHAR) END AS status_desc,
          CASE WHEN unmapped_items > 0 THEN CONCAT('⚠ ', unmapped_items, ' sem mapa')
               ELSE '' END AS alerta,
          invoiced AS valor_faturado,
          CASE WHEN both_there THEN items_value * {_FACTOR} END AS dif_icms,
          invoiced - items_value AS frete_imposto,
          invoiced + items_value * {_FACTOR} AS preco_real,
          (invoiced + items_value * {_FACTOR} - items_value)
            / NULLIF(items_value, 0) * 100 AS pct_custo
        FROM (SELECT *, product_invoice_value + service_invoice_value AS invoiced,
                product_invoice_value IS NOT NULL AND service_invoice_value IS NOT NULL AS both_there
              FROM {{q_summary}})""",
    "supplier_order_items": "SELECT * FROM {q_supplier_item}",
    "supplier_order_item_costs": f"""
        SELECT * EXCLUDE (icms, freight, both_there, landed), icms AS dif_icms,
          freight AS frete_imposto, landed AS preco_real,
          (landed - price_unit) / NULLIF(price_unit, 0) * 100 AS pct_custo
        FROM (SELECT *, CASE WHEN both_there
                THEN price_unit + COALESCE(freight, 0) + COALESCE(icms, 0) END AS landed
              FROM (SELECT i.*, s.product_invoice_value + s.service_invoice_value IS NOT NULL AS both_there,
                      CASE WHEN s.product_invoice_value + s.service_invoice_value IS NOT NULL
                           THEN i.price_unit * {_FACTOR} END AS icms,
                      i.price_unit * ((s.product_invoice_value + s.service_invoice_value - s.items_value)
                                      / NULLIF(s.items_value, 0)) AS freight
                    FROM {{q_supplier_item}} i JOIN {{q_summary}} s ON s.id = i.order_id))""",
    "price_items": "SELECT * FROM {q_priced}",
    "price_average": f"SELECT {PRICE_COLUMNS} FROM {{q_average}}",
    "price_average_filtered": f"SELECT {PRICE_COLUMNS} FROM {{q_average_shown}}",
    "price_average_by_category": f"""
        SELECT categoria, {_rounded('q', 'qtd_total')}, {_rounded('u', 'preco_unit_medio')},
          {_rounded('r', 'preco_real_medio')}, {_rounded('r - u', 'dif_por_caixa')}
        FROM (SELECT categoria, SUM(qtd_total) AS q,
                SUM(preco_unit_medio * qtd_total) / NULLIF(SUM(qtd_total), 0) AS u,
                SUM(preco_real_medio * qtd_total) / NULLIF(SUM(qtd_total), 0) AS r
              FROM {{q_average_shown}} GROUP BY categoria)""",
    "item_frequency": "SELECT * FROM {q_frequency}",
    "item_frequency_pct": "SELECT * FROM {q_share}",
    "item_frequency_filtered": f"""
        SELECT * FROM {{q_share}} WHERE tipo = 'Desconhecido' AND categoria = 'Sorvetes'
          AND {_found('produto')}""",
    "filter_options": """
        SELECT DISTINCT 'price_type' AS filter, tipo AS value FROM {q_average}
        UNION ALL SELECT DISTINCT 'price_category', categoria FROM {q_average}
          WHERE tipo = 'Gelado' AND categoria IS NOT NULL
        UNION ALL SELECT DISTINCT 'frequency_type', tipo FROM {q_share}
        UNION ALL SELECT DISTINCT 'frequency_category', categoria FROM {q_share}
          WHERE categoria IS NOT NULL""",
    "supplier_orders_summary_bucketed": "SELECT * FROM {q_summary}",
    "supplier_order_item_costs_bucketed": "SELECT * FROM {supplier_order_item_costs}",
    "price_items_bucketed": "SELECT * FROM {q_priced}",
    "item_frequency_by_month": "SELECT * FROM {q_frequency}",
    "category_order_counts": f"""
        SELECT i.external_category, o.type_of_load, COUNT(DISTINCT o.id) AS num_pedidos
        FROM {{supplier_order_item}} i JOIN {{supplier_order}} o ON o.id = i.order_id
        WHERE CAST(i.created_at AS DATE) BETWEEN DATE '{RANGE_START}' AND DATE '2000-12-17' GROUP BY 1, 2""",
    "mapping_sync_stored": "SELECT * EXCLUDE (id, filled) FROM {mapping_sync}",
    "supplier_orders_summary_stored": """
        SELECT s.* REPLACE (COALESCE(x.unmapped, 0) AS unmapped_items)
        FROM {q_summary} s LEFT JOIN (
          SELECT order_id, COUNT(*) FILTER (WHERE local_product_id IS NULL
            AND LOWER(external_category) IN ('sorvetes', 'acai')) AS unmapped
          FROM {mapping_sync} GROUP BY order_id) x ON x.order_id = s.id""",
    "product_changes": "SELECT * FROM {q_product_fields} WHERE old IS DISTINCT FROM new",
    "purchase_orders_display": """
        SELECT id, COALESCE(strftime(order_date, '%d/%m/%Y %H:%M'), '—') AS order_date FROM {purchase_order}""",
    "supplier_orders_display": """
        SELECT id, COALESCE(strftime(order_date, '%d/%m/%Y'), '—') AS order_date FROM {q_summary}""",
    # The stream starts from empty tables: every order is new.
    "stream_order_ingest": f"""
        SELECT f.platform_order_id, f.store_id, l.platform_status, CAST(l.total AS DOUBLE) AS total,
          CAST(f.franchise_tax AS DOUBLE) AS franchise_tax, {_NOW} AS loaded_at, k.type_of_load,
          k.vhsys, CAST(k.piv AS DOUBLE) AS product_invoice_value, k.pid AS product_invoice_doc,
          CAST(k.siv AS DOUBLE) AS service_invoice_value, k.sid AS service_invoice_doc,
          i.total_items, i.total_qty, i.nfe_sum
        FROM {{q_numbered}} f
        JOIN {{q_numbered}} l ON l.platform_order_id = f.platform_order_id AND l.copy_back = 1
        JOIN {{q_kept}} k ON k.platform_order_id = f.platform_order_id
        LEFT JOIN {{q_stream_items}} i ON i.arrival = f.arrival
        WHERE f.copy = 1""",
    "stream_weekly_consumption": "SELECT * FROM {consumption_weekly}",
    # A week is closed when the latest change is seven days past its end.
    "stream_weekly_windows": f"""
        SELECT CAST(DATE_TRUNC('week', h.change_date) AS DATE) AS week,
          p.description AS product_desc, p.product_type, COUNT(*) AS consumed
        FROM {{freezer_position_history}} h JOIN {{product}} p ON p.id = h.product
        WHERE DATE_TRUNC('week', h.change_date) + INTERVAL 14 DAY
            <= (SELECT MAX(change_date) FROM {{freezer_position_history}})
          AND p.id NOT {_BANNED} GROUP BY 1, 2, 3""",
    # One file has all changes, so none is late.
    "stream_weekly_late": """
        SELECT COUNT(*) AS arrived, COUNT(*) FILTER (WHERE shut) AS closed,
          COUNT(*) FILTER (WHERE NOT shut) AS open, CAST(0 AS BIGINT) AS late
        FROM (SELECT DATE_TRUNC('week', change_date) + INTERVAL 14 DAY
                <= MAX(change_date) OVER () AS shut FROM {freezer_position_history})""",
    "constraint_violations": _constraint_sql(),
}


def _text(name: str) -> str:
    for source in (VIEWS, PIECES, QUERIES):
        if name in source:
            return source[name]
    raise KeyError(name)


def _inputs(name: str, seen: list[str]) -> list[str]:
    """Names a query needs, each after the ones it needs itself."""
    for other in sorted(names_in(_text(name))):
        if other not in BASE_TABLES and other not in seen:
            _inputs(other, seen)
            seen.append(other)
    return seen


class _Names(dict):
    def __missing__(self, name: str) -> str:
        return name


def full_sql(name: str) -> str:
    """One self-contained statement over the test tables."""
    inputs = _inputs(name, [])
    body = _text(name).format_map(_Names())
    if not inputs:
        return body.strip()
    parts = [f"{other} AS ({_text(other).format_map(_Names())})" for other in inputs]
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()
