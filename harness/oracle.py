"""SQL for each query, written separately from the operators: windows where they
aggregate, joins where they compare. Only the source views share their text.
"""

from __future__ import annotations

import re

from harness.retail import RUNS
from tillhouse.plans.pipeline import TABLES
from tillhouse.plans.serving import SERVED
from tillhouse.schemas import BEGINNING, FOREVER, SOURCES
from tillhouse.sources.retail_views import VIEWS

WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
TRACKED = "customer_id, full_name, email, country_code, country_name, signup_date"


def _first_per_key(table: str) -> str:
    key = SOURCES[table][0]
    columns = [part.split()[0] for part in SOURCES[table][1].split(", ")]
    order = ", ".join(f"{c} ASC NULLS FIRST" for c in columns if c != key)
    return f"""
        SELECT {", ".join(columns)} FROM (
            SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn
            FROM src_{table}) WHERE rn = 1"""


# Named parts, in dependency order. A query gets those it mentions, directly or not.
PARTS: dict[str, str] = {}
for _t, _text in VIEWS.items():
    PARTS[f"src_{_t}"] = re.sub(r"\{(\w+)\}", r"\1", _text)
for _t in VIEWS:
    PARTS[f"one_{_t}"] = _first_per_key(_t)

PARTS |= {
    "clean_customers": f"""
        SELECT customer_id, trim(full_name, {WHITE}) AS full_name, lower(email) AS email,
               upper(country_code) AS country_code, signup_date FROM one_customers""",
    "clean_products": f"""
        SELECT product_id, trim(product_name, {WHITE}) AS product_name,
               upper(category_code) AS category_code, unit_price
        FROM one_products WHERE unit_price >= 0""",
    "customer_min": """
        SELECT email, min(customer_id) AS customer_id FROM clean_customers
        GROUP BY email""",
    "product_min": """
        SELECT product_name, category_code, min(product_id) AS product_id FROM clean_products
        GROUP BY product_name, category_code""",
    "customer_map": """
        SELECT c.customer_id, m.customer_id AS surviving_customer_id
        FROM clean_customers c JOIN customer_min m ON c.email = m.email""",
    "product_map": """
        SELECT p.product_id, m.product_id AS surviving_product_id
        FROM clean_products p JOIN product_min m
          ON p.product_name = m.product_name AND p.category_code = m.category_code""",
    "silver_customers": """
        SELECT c.customer_id, c.full_name, c.email, c.country_code,
               coalesce(r.country_name, 'Unknown') AS country_name, c.signup_date
        FROM customer_min m JOIN clean_customers c ON c.customer_id = m.customer_id
        LEFT JOIN one_country_ref r ON r.country_code = c.country_code""",
    "silver_products": """
        SELECT p.product_id, p.product_name, p.category_code,
               coalesce(r.category_name, 'Unknown') AS category_name, p.unit_price
        FROM product_min m JOIN clean_products p ON p.product_id = m.product_id
        LEFT JOIN one_category_ref r ON r.category_code = p.category_code""",
    "silver_stores": f"""
        SELECT s.store_id, trim(s.store_name, {WHITE}) AS store_name,
               trim(s.city, {WHITE}) AS city, upper(s.country_code) AS country_code,
               coalesce(r.country_name, 'Unknown') AS country_name
        FROM one_stores s LEFT JOIN one_country_ref r ON r.country_code = upper(s.country_code)""",
    "transactions_completed": """
        SELECT t.transaction_id, t.store_id, t.customer_id, t.transaction_date,
               lower(s.status_name) AS status, t.payment_method
        FROM one_transactions t JOIN one_status_ref s ON t.status_code = s.status_code
        WHERE lower(s.status_name) = 'completed'""",
    "silver_transactions": """
        SELECT t.transaction_id, t.store_id, m.surviving_customer_id AS customer_id,
               t.transaction_date, t.status, t.payment_method
        FROM transactions_completed t JOIN customer_map m ON m.customer_id = t.customer_id""",
    "items_completed": """
        SELECT t.transaction_id, i.item_id, i.product_id, i.quantity, i.unit_price, t.store_id,
               t.customer_id, t.transaction_date, t.status, t.payment_method
        FROM one_transaction_items i JOIN silver_transactions t
          ON t.transaction_id = i.transaction_id""",
    "silver_sales": """
        SELECT i.item_id, i.transaction_id, i.store_id, i.customer_id,
               m.surviving_product_id AS product_id, i.transaction_date, i.status,
               i.payment_method, i.quantity, i.unit_price,
               CAST(round(i.quantity * i.unit_price, 2) AS DECIMAL(18,2)) AS line_amount
        FROM items_completed i JOIN product_map m ON m.product_id = i.product_id
        WHERE i.customer_id IN (SELECT customer_id FROM silver_customers)
          AND i.store_id IN (SELECT store_id FROM silver_stores)""",
    "silver_rejected_sales": """
        SELECT item_id, transaction_id, store_id, customer_id, product_id, quantity, unit_price
        FROM items_completed i
        WHERE NOT EXISTS (SELECT 1 FROM silver_sales s WHERE s.item_id = i.item_id)""",
    "checked_refunds": """
        SELECT r.*, s.transaction_id, s.store_id, s.customer_id, s.product_id, s.line_amount,
               CAST(sum(r.amount) OVER (PARTITION BY r.item_id
                    ORDER BY r.refund_date, r.refund_id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(38,2))
                   AS refunded_so_far
        FROM one_refunds r JOIN silver_sales s ON s.item_id = r.item_id""",
    "silver_refunds": """
        SELECT refund_id, item_id, refund_date, quantity, amount, reason, transaction_id,
               store_id, customer_id, product_id
        FROM checked_refunds WHERE amount > 0 AND refunded_so_far <= line_amount""",
    "silver_rejected_refunds": """
        SELECT refund_id, item_id, refund_date, quantity, amount, reason FROM one_refunds r
        WHERE NOT EXISTS (SELECT 1 FROM silver_refunds s WHERE s.refund_id = r.refund_id)""",
}


def _snapshot(codes: str, rows: str) -> str:
    return f"""
        SELECT c.customer_id, c.full_name, c.email, c.country_code,
               coalesce(r.country_name, 'Unknown') AS country_name, c.signup_date
        FROM (SELECT * REPLACE ({codes} AS country_code) FROM clean_customers WHERE {rows}) c
        LEFT JOIN one_country_ref r ON r.country_code = c.country_code"""


_MOVED = """CASE WHEN customer_id % 10 <> 3 THEN country_code
                 WHEN country_code = 'N00' THEN 'N01' ELSE 'N00' END"""
PARTS |= {
    "snapshot_1": _snapshot("country_code", "customer_id % 20 <> 0"),
    "snapshot_2": _snapshot(_MOVED, "customer_id % 11 <> 5"),
    "snapshot_3": _snapshot(
        _MOVED, "customer_id % 11 <> 5 OR (customer_id % 22 = 5 AND customer_id % 20 <> 0)"
    ),
    "history_1": f"""
        SELECT {TRACKED}, TIMESTAMP '{BEGINNING}' AS valid_from, false AS is_deleted
        FROM snapshot_1""",
}


def _add_run(n: int, snapshot: str, name: str, when: str) -> None:
    """History ``name`` from ``history_n``, with ``snapshot`` observed at ``when``."""
    same = " AND ".join(
        f"a.{c} IS NOT DISTINCT FROM s.{c}" for c in TRACKED.split(", ")
    )
    old = f"history_{n}"
    PARTS[f"{name}_latest"] = f"""
        SELECT {TRACKED}, valid_from, is_deleted FROM (
            SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY valid_from DESC) AS rn
            FROM {old}) WHERE rn = 1"""
    PARTS[f"{name}_changed"] = f"""
        SELECT {TRACKED} FROM {snapshot} s WHERE NOT EXISTS (
            SELECT 1 FROM {name}_latest a WHERE NOT a.is_deleted AND {same})"""
    PARTS[f"{name}_removed"] = f"""
        SELECT {TRACKED} FROM {name}_latest a WHERE NOT a.is_deleted
          AND a.customer_id NOT IN (SELECT customer_id FROM {snapshot})"""
    PARTS[name] = f"""
        SELECT {TRACKED}, valid_from, is_deleted FROM {old}
        UNION ALL
        SELECT {TRACKED}, CASE WHEN customer_id IN (SELECT customer_id FROM {old})
                               THEN TIMESTAMP '{when}' ELSE TIMESTAMP '{BEGINNING}' END, false
        FROM {name}_changed
        UNION ALL
        SELECT {TRACKED}, TIMESTAMP '{when}', true FROM {name}_removed"""


_add_run(1, "snapshot_2", "history_2", str(RUNS[1]))
_add_run(2, "snapshot_3", "history_3", str(RUNS[2]))
_add_run(2, "snapshot_2", "history_2_again", str(RUNS[2]))
PARTS["history_3_newest"] = f"""
    SELECT {TRACKED}, valid_from, is_deleted FROM (
        SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY valid_from DESC) AS rn
        FROM history_3) WHERE rn = 1"""

PARTS |= {
    "dim_customer": f"""
        SELECT CAST(customer_id AS BIGINT) * 1000000 + version AS customer_key, customer_id,
               full_name, email, country_name AS country, signup_date,
               CAST(version AS INTEGER) AS version, valid_from, valid_to,
               valid_to = TIMESTAMP '{FOREVER}' AS is_current
        FROM (SELECT *, row_number() OVER w AS version,
                     coalesce(lead(valid_from) OVER w, TIMESTAMP '{FOREVER}') AS valid_to
              FROM history_3 WINDOW w AS (PARTITION BY customer_id ORDER BY valid_from))
        WHERE NOT is_deleted""",
    "dim_product": """
        SELECT product_id AS product_key, product_id, product_name, category_name AS category,
               unit_price FROM silver_products""",
    "dim_store": """
        SELECT store_id AS store_key, store_id, store_name, city, country_name AS country
        FROM silver_stores""",
    "all_dates": """
        SELECT transaction_date AS d FROM silver_sales
        UNION ALL SELECT refund_date FROM silver_refunds""",
    "days": """
        SELECT CAST(unnest(generate_series(
                   CAST(make_date(y0, 1, 1) AS TIMESTAMP),
                   CAST(make_date(y1, 12, 31) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date_key
        FROM (SELECT CAST(year(min(d)) AS INTEGER) AS y0, CAST(year(max(d)) AS INTEGER) AS y1
              FROM all_dates)""",
    "dim_date": """
        SELECT date_key, CAST(year(date_key) AS INTEGER) AS "year",
               CAST(quarter(date_key) AS INTEGER) AS "quarter",
               CAST(month(date_key) AS INTEGER) AS "month", monthname(date_key) AS month_name,
               CAST(day(date_key) AS INTEGER) AS "day",
               CAST(isodow(date_key) AS INTEGER) AS day_of_week, dayname(date_key) AS day_name,
               isodow(date_key) >= 6 AS is_weekend
        FROM days""",
    "fact_sales": """
        SELECT s.item_id AS item_key, s.transaction_date AS date_key, d.customer_key,
               s.product_id AS product_key, s.store_id AS store_key, s.transaction_id,
               s.quantity, s.unit_price, s.line_amount
        FROM silver_sales s JOIN dim_customer d ON d.customer_id = s.customer_id
         AND d.valid_from <= CAST(s.transaction_date AS TIMESTAMP)
         AND CAST(s.transaction_date AS TIMESTAMP) < d.valid_to""",
    "fact_refunds": """
        SELECT r.refund_id AS refund_key, r.item_id AS item_key, r.refund_date AS date_key,
               d.customer_key, r.product_id AS product_key, r.store_id AS store_key,
               r.transaction_id, r.quantity, r.amount, r.reason
        FROM silver_refunds r JOIN dim_customer d ON d.customer_id = r.customer_id
         AND d.valid_from <= CAST(r.refund_date AS TIMESTAMP)
         AND CAST(r.refund_date AS TIMESTAMP) < d.valid_to""",
    "day_sold": """
        SELECT f.date_key, s.store_name, count(DISTINCT f.transaction_id) AS transaction_count,
               sum(f.quantity) AS units_sold, sum(f.line_amount) AS revenue
        FROM fact_sales f JOIN dim_store s ON s.store_key = f.store_key GROUP BY ALL""",
    "day_refunded": """
        SELECT f.date_key, s.store_name, sum(f.amount) AS refund_amount
        FROM fact_refunds f JOIN dim_store s ON s.store_key = f.store_key GROUP BY ALL""",
    "mart_daily_sales": """
        SELECT coalesce(a.date_key, b.date_key) AS date_key,
               coalesce(a.store_name, b.store_name) AS store_name,
               CAST(coalesce(a.transaction_count, 0) AS BIGINT) AS transaction_count,
               CAST(coalesce(a.units_sold, 0) AS BIGINT) AS units_sold,
               CAST(coalesce(a.revenue, 0) AS DECIMAL(38,2)) AS revenue,
               CAST(coalesce(b.refund_amount, 0) AS DECIMAL(38,2)) AS refund_amount,
               CAST(coalesce(a.revenue, 0) - coalesce(b.refund_amount, 0) AS DECIMAL(38,2))
                   AS net_revenue
        FROM day_sold a FULL JOIN day_refunded b
          ON a.date_key = b.date_key AND a.store_name = b.store_name""",
    "mart_product_sales": """
        SELECT a.category, a.product_name, CAST(a.units_sold AS BIGINT) AS units_sold,
               CAST(a.revenue AS DECIMAL(38,2)) AS revenue,
               CAST(coalesce(b.refund_amount, 0) AS DECIMAL(38,2)) AS refund_amount,
               CAST(a.revenue - coalesce(b.refund_amount, 0) AS DECIMAL(38,2)) AS net_revenue
        FROM (SELECT p.category, p.product_name, sum(f.quantity) AS units_sold,
                     sum(f.line_amount) AS revenue
              FROM fact_sales f JOIN dim_product p ON p.product_key = f.product_key
              GROUP BY ALL) a
        LEFT JOIN (SELECT p.category, p.product_name, sum(f.amount) AS refund_amount
                   FROM fact_refunds f JOIN dim_product p ON p.product_key = f.product_key
                   GROUP BY ALL) b
          ON a.category = b.category AND a.product_name = b.product_name""",
    "mart_customer_sales": """
        SELECT c.customer_key, c.full_name, c.country,
               CAST(a.transaction_count AS BIGINT) AS transaction_count,
               CAST(a.total_spent AS DECIMAL(38,2)) AS total_spent, a.last_sale_date,
               CAST(coalesce(b.total_refunded, 0) AS DECIMAL(38,2)) AS total_refunded,
               CAST(a.total_spent - coalesce(b.total_refunded, 0) AS DECIMAL(38,2)) AS net_spent
        FROM (SELECT d.customer_id, count(DISTINCT f.transaction_id) AS transaction_count,
                     sum(f.line_amount) AS total_spent, max(f.date_key) AS last_sale_date
              FROM fact_sales f JOIN dim_customer d ON d.customer_key = f.customer_key
              GROUP BY ALL) a
        JOIN dim_customer c ON c.customer_id = a.customer_id AND c.is_current
        LEFT JOIN (SELECT d.customer_id, sum(f.amount) AS total_refunded
                   FROM fact_refunds f JOIN dim_customer d ON d.customer_key = f.customer_key
                   GROUP BY ALL) b ON b.customer_id = a.customer_id""",
    # --- change events
    "user_events": """
        SELECT CAST(user_id AS INTEGER) AS user_id, event_type, value, ts,
               CAST(epoch_ns(ts) AS BIGINT) AS ts_ns, event_type = 'error' AS is_delete
        FROM events""",
    "newest_events": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_ns DESC)
                                 AS rn FROM user_events) WHERE rn = 1""",
    "users_now": """
        SELECT user_id, event_type AS last_type, CAST(value AS DECIMAL(10,2)) AS amount,
               CAST(ts AS DATE) AS "day", ts_ns AS _cdc_ts
        FROM newest_events WHERE NOT is_delete""",
}


def with_parts(main: str) -> str:
    """The query with the named parts it needs, in dependency order."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in PARTS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(PARTS[name])

    visit(main)
    # A base table and a part never share a name, except those of the test data itself.
    parts = ",\n".join(f"{n} AS ({PARTS[n]})" for n in PARTS if n in needed)
    return f"WITH {parts}\n{main}" if parts else main


def _check(check: str, metric: str, value: str, passed: str, source: str = "") -> str:
    return f"""
        SELECT '{check}' AS "check", '{metric}' AS metric,
               CAST({value} AS DECIMAL(38,2)) AS "value", {passed} AS passed {source}"""


def _rows_check(check: str, table: str) -> str:
    optional = "true" if table == "refunds" else "count(*) > 0"
    return _check(check, table, "count(*)", optional, f"FROM src_{table}")


_KEYS = {"customer_key": "dim_customer", "product_key": "dim_product",
         "store_key": "dim_store", "date_key": "dim_date"}


def _orphans(fact: str, check: str) -> list[str]:
    return [
        _check(check, key, "count(*)", "count(*) = 0",
               f"FROM {fact} f WHERE NOT EXISTS (SELECT 1 FROM {dim} d WHERE d.{key} = f.{key})")
        for key, dim in _KEYS.items()
    ]


_GRAIN = [
    _check("grain", "rows", "count(*)", "count(*) > 0", "FROM fact_sales"),
    _check("grain", "duplicate_item_keys", "count(*) - count(DISTINCT item_key)",
           "count(*) = count(DISTINCT item_key)", "FROM fact_sales"),
]
_REFUND_ITEMS = _check(
    "refund_items", "refunds_of_unknown_items", "count(*)", "count(*) = 0",
    "FROM fact_refunds r WHERE NOT EXISTS "
    "(SELECT 1 FROM fact_sales s WHERE s.item_key = r.item_key)")
_CURRENT = _check(
    "current_version", "customers_without_one_current_version",
    "count(*) - count(DISTINCT customer_id)", "count(*) = count(DISTINCT customer_id)",
    "FROM dim_customer WHERE is_current")
_FACT_SUM = "(SELECT sum(line_amount) FROM fact_sales)"
_SILVER_SUM = "(SELECT sum(line_amount) FROM silver_sales)"
_REVENUE = [
    _check("revenue", "fact_revenue", _FACT_SUM, f"{_FACT_SUM} = {_SILVER_SUM}"),
    _check("revenue", "silver_revenue", _SILVER_SUM, f"{_FACT_SUM} = {_SILVER_SUM}"),
]
_REJECTED = _check("rejected", "rejected_sales", "count(*)", "true", "FROM silver_rejected_sales")


def _stack(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


# Published table -> the part that defines it, where the names differ.
_MARTS = {
    "daily_sales_mart": "mart_daily_sales",
    "product_sales_mart": "mart_product_sales",
    "customer_sales_mart": "mart_customer_sales",
    "customer_history": "history_3",
}


def _part_of(layer: str, table: str) -> str:
    return _MARTS.get(table) or (f"silver_{table}" if layer == "silver" else table)


_SERVED = []
for _name, (_layer, _) in SERVED.items():
    _part = _part_of(_layer, _name)
    for _side in ("lake", "served"):
        _SERVED.append(
            _check("served", f"{_name}.{_side}", "count(*)", "true", f"FROM {_part}")
        )

ORACLE: dict[str, str] = {
    "scan_parquet": """
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
               l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate FROM lineitem""",
    "lake_roundtrip": "SELECT * FROM src_transactions",
    "lake_overwrite_schema": """
        SELECT transaction_id, lower(status_code) AS status,
               CAST(year(transaction_date) AS INTEGER) AS "year" FROM src_transactions""",
    "ingest_full_refresh": "SELECT * FROM orders",
    "ingest_allow_empty": """
        SELECT 'full' AS step, count(*) AS row_count FROM lineitem
        UNION ALL SELECT 'emptied', count(*) FROM lineitem WHERE false""",
    "bronze_typed_copy": """
        SELECT *, 'extract' AS _loaded_by, TIMESTAMP '2024-01-01 00:00:00' AS _ingested_at
        FROM src_transaction_items""",
    "serve_publish": "SELECT * FROM mart_daily_sales",
    "serve_sorted": "SELECT * FROM fact_sales",
    "dedupe_by_key": "SELECT * FROM one_transaction_items",
    "customers_clean": "SELECT * FROM clean_customers",
    "products_clean": "SELECT * FROM clean_products",
    "customer_survivors": "SELECT email, customer_id FROM customer_min",
    "customer_survivor_map": "SELECT * FROM customer_map",
    "product_survivor_map": "SELECT * FROM product_map",
    "translate_lookup": """
        SELECT c.customer_id, c.country_code,
               coalesce(r.country_name, 'Unknown') AS country_name
        FROM clean_customers c LEFT JOIN one_country_ref r ON r.country_code = c.country_code""",
    "transactions_completed": "SELECT * FROM transactions_completed",
    "items_completed": "SELECT * FROM items_completed",
    "sales_semi_valid": """
        SELECT * FROM silver_transactions
        WHERE customer_id IN (SELECT customer_id FROM silver_customers)
          AND store_id IN (SELECT store_id FROM silver_stores)""",
    "sales_line_amount": """
        SELECT item_id, quantity, unit_price,
               CAST(round(quantity * unit_price, 2) AS DECIMAL(18,2)) AS line_amount
        FROM one_transaction_items""",
    "refund_running_total": """
        SELECT refund_id, item_id, refund_date, amount, line_amount, refunded_so_far
        FROM checked_refunds""",
    "silver_customers": "SELECT * FROM silver_customers",
    "silver_products": "SELECT * FROM silver_products",
    "silver_stores": "SELECT * FROM silver_stores",
    "silver_transactions": "SELECT * FROM silver_transactions",
    "silver_sales": "SELECT * FROM silver_sales",
    "rejected_sales": "SELECT * FROM silver_rejected_sales",
    "refunds_valid": "SELECT * FROM silver_refunds",
    "rejected_refunds": "SELECT * FROM silver_rejected_refunds",
    "scd2_append": "SELECT * FROM history_3",
    "scd2_changed": "SELECT * FROM history_2_changed",
    "scd2_removed": "SELECT * FROM history_2_removed",
    "scd2_latest": "SELECT * FROM history_3_newest",
    "scd2_rerun_noop": "SELECT * FROM history_2_again",
    "scd2_dimension": "SELECT * FROM dim_customer",
    "dim_customer_current": "SELECT * FROM dim_customer WHERE is_current",
    "as_of_version": """
        SELECT t.transaction_id, t.customer_id, t.transaction_date, d.customer_key
        FROM silver_transactions t JOIN dim_customer d ON d.customer_id = t.customer_id
         AND CAST(t.transaction_date AS TIMESTAMP) >= d.valid_from
         AND CAST(t.transaction_date AS TIMESTAMP) < d.valid_to""",
    "dim_product": "SELECT * FROM dim_product",
    "dim_store": "SELECT * FROM dim_store",
    "dim_date": "SELECT * FROM dim_date",
    "fact_sales": "SELECT * FROM fact_sales",
    "fact_refunds": "SELECT * FROM fact_refunds",
    "mart_daily_sales": "SELECT * FROM mart_daily_sales",
    "mart_product_sales": "SELECT * FROM mart_product_sales",
    "mart_customer_sales": "SELECT * FROM mart_customer_sales",
    "cdc_latest_event": """
        SELECT user_id AS _key,
               CASE WHEN NOT is_delete THEN event_type END AS last_type,
               CASE WHEN NOT is_delete THEN CAST(value AS DECIMAL(10,2)) END AS amount,
               CASE WHEN NOT is_delete THEN CAST(ts AS DATE) END AS "day",
               is_delete AS _is_delete, ts_ns AS _cdc_ts
        FROM newest_events""",
    "cdc_after_mark": """
        SELECT user_id AS _key,
               CASE WHEN NOT is_delete THEN event_type END AS last_type,
               CASE WHEN NOT is_delete THEN CAST(value AS DECIMAL(10,2)) END AS amount,
               CASE WHEN NOT is_delete THEN CAST(ts AS DATE) END AS "day",
               is_delete AS _is_delete, ts_ns AS _cdc_ts
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_ns DESC) AS rn
              FROM user_events
              WHERE ts_ns > (SELECT max(ts_ns) FROM user_events WHERE ts_ns < 1705276800000000000))
        WHERE rn = 1""",
    "cdc_high_water": """
        SELECT max(ts_ns) AS high_water FROM user_events""",
    "check_table_rows": _rows_check("table_rows", "transaction_items"),
    "check_row_counts": _stack([_rows_check("row_counts", t) for t in SOURCES]),
    "check_gold": _stack([
        *_GRAIN, *_orphans("fact_sales", "orphan_keys"),
        *_orphans("fact_refunds", "refund_orphan_keys"), _REFUND_ITEMS, _CURRENT, *_REVENUE,
        _REJECTED,
    ]),
    "check_fact_orphans": _stack(_orphans("fact_sales", "orphan_keys")),
    "check_refund_orphans": _stack(_orphans("fact_refunds", "refund_orphan_keys")),
    "check_refund_items": _REFUND_ITEMS,
    "check_current_version": _CURRENT,
    "check_revenue": _stack(_REVENUE),
    "check_served": _stack(_SERVED),
    "lake_table_counts": _stack([
        f"SELECT '{t.layer}.{t.name}' AS table_name, count(*) AS row_count "
        f"FROM {_part_of(t.layer, t.name)}" for t in TABLES
    ]),
    "adhoc_revenue": """
        SELECT count(*) AS sales_rows, CAST(sum(line_amount) AS DECIMAL(38,2)) AS revenue
        FROM fact_sales""",
    "adhoc_current_of_returning": """
        SELECT customer_key, customer_id, country FROM dim_customer
        WHERE is_current AND customer_id IN (
            SELECT d.customer_id FROM fact_sales f JOIN dim_customer d ON d.customer_key = f.customer_key
            GROUP BY d.customer_id HAVING count(DISTINCT f.customer_key) > 1)""",
    "adhoc_ordered_read": """
        SELECT *, row_number() OVER (ORDER BY date_key, item_key) AS place FROM fact_sales""",
    "mart_product_ranked": """
        SELECT *, row_number() OVER (ORDER BY revenue DESC NULLS LAST, category NULLS FIRST,
                                     product_name NULLS FIRST) AS rank
        FROM mart_product_sales""",
    "mart_customer_ranked": """
        SELECT *, row_number() OVER (ORDER BY total_spent DESC NULLS LAST, customer_key) AS rank
        FROM mart_customer_sales""",
    "dim_date_without_facts": PARTS["dim_date"].replace(
        "FROM days", "FROM (SELECT CAST(unnest(generate_series(DATE '2000-01-01', DATE '2000-12-31', INTERVAL 1 DAY)) AS DATE) AS date_key)"
    ),
    "check_outcomes": """
        SELECT 'holds' AS name, count(*) > 0 AS passed FROM supplier UNION ALL
        SELECT 'fails', count(*) > 0 FROM supplier WHERE false UNION ALL
        SELECT 'cannot run', false UNION ALL SELECT 'skipped', true""",
    "lake_retention": """
        SELECT CAST(y - 1995 AS INTEGER) AS version, count(*) AS row_count
        FROM range(1998, 2001) years(y) JOIN orders ON year(o_orderdate) <= y GROUP BY y""",
    "adhoc_distinct_days": "SELECT DISTINCT date_key FROM fact_sales",
    "cdc_tie_across_batches": "SELECT * FROM users_now WHERE user_id % 2 <> 0",
    "cdc_tie_across_polls": "SELECT * FROM users_now WHERE user_id % 2 <> 0",
    "adhoc_version_moved": """
        SELECT f.customer_key, count(*) AS sales_rows,
               CAST(sum(f.line_amount) AS DECIMAL(38,2)) AS revenue
        FROM fact_sales f JOIN dim_customer d ON d.customer_key = f.customer_key
        WHERE NOT d.is_current AND f.quantity <> 0 GROUP BY f.customer_key""",
}
# Whatever the order and repetition of delivery, the table ends as the newest events say.
for _key in ("cdc_rebuild", "cdc_merge", "cdc_incremental", "cdc_stream_merge",
             "cdc_reapply_noop", "cdc_late_event", "cdc_mode_switch", "cdc_empty_bootstrap",
             "cdc_state_view"):
    ORACLE[_key] = "SELECT * FROM users_now"


def oracle() -> dict[str, str]:
    return {key: with_parts(sql) for key, sql in ORACLE.items()}
