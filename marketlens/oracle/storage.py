"""DuckDB SQL of what sinks and sources hold, and of the key checks on damaged
tables, from the canonical tables and the stated damage alone."""

from __future__ import annotations

from marketlens.oracle.ctes import register
from marketlens.oracle.queries import Q
from marketlens.schema import FOREIGN_KEYS, PRIMARY_KEYS, SCHEMAS

_DAMAGED = {f"x_{table}": (f"""
SELECT * EXCLUDE (code, copy) REPLACE (CASE WHEN code <> 2 THEN {key} END AS {key})
FROM (SELECT *, coalesce(ascii(right({key}, 1)) % 10, 0) AS code FROM k_{table}) AS coded,
  (VALUES (1), (2)) AS copies(copy)
WHERE code <> 3 AND (copy = 1 OR code = 1)""", [f"k_{table}"]) for table, (key,) in PRIMARY_KEYS.items()}


def _in(table: str) -> str:
    return f"x_{table}" if table in PRIMARY_KEYS else f"k_{table}"


def _pk(table: str) -> tuple[str, list[str]]:
    (key,) = PRIMARY_KEYS[table]
    return f"""
SELECT CAST({key} AS VARCHAR) AS key, count(*) AS n, if({key} IS NULL, 'null', 'duplicate') AS reason
FROM {_in(table)} GROUP BY {key} HAVING {key} IS NULL OR count(*) > 1""", [_in(table)]


def _fk(relation: str) -> tuple[str, list[str]]:
    child, col, parent, key = FOREIGN_KEYS[relation]
    return f"""
SELECT child.{col} AS value, count(*) AS n FROM {_in(child)} AS child
ANTI JOIN {_in(parent)} AS parent ON parent.{key} = child.{col}
WHERE child.{col} IS NOT NULL GROUP BY child.{col}""", [_in(child), _in(parent)]


_reports, _needs = [], set()
for _kind, _names, _of in (("pk", PRIMARY_KEYS, _pk), ("fk", FOREIGN_KEYS, _fk)):
    for _name in _names:
        _body, _tables = _of(_name)
        register(Q, f"damaged_{_kind}_{_name}", _body, _tables, _DAMAGED)
        _needs.update(_tables)
        _reports.append(f"""
SELECT '{'primary' if _kind == 'pk' else 'foreign'}_key' AS kind, '{_name}' AS name, count(*) AS bad_values,
  CAST(coalesce(sum(n), 0) AS BIGINT) AS bad_rows FROM ({_body}) AS found""")
register(Q, "damaged_constraint_report", " UNION ALL ".join(_reports), sorted(_needs), _DAMAGED)

for _table in SCHEMAS:
    register(Q, f"staged_{_table}", f"FROM k_{_table} SELECT *", [f"k_{_table}"])
register(Q, "staged_order_sums", """
SELECT order_status, count(*) AS orders, CAST(coalesce(sum(items), 0) AS BIGINT) AS items,
  CAST(coalesce(sum(pays), 0) AS BIGINT) AS payments, CAST(coalesce(sum(revs), 0) AS BIGINT) AS reviews
FROM k_orders LEFT JOIN (SELECT order_id, count(*) AS items FROM k_order_item GROUP BY order_id) AS lines USING (order_id)
LEFT JOIN g_pay USING (order_id) LEFT JOIN g_rev USING (order_id)
GROUP BY order_status""", ["k_orders", "k_order_item", "g_pay", "g_rev"])
register(Q, "sales_in_period", """
SELECT strftime(order_purchase_timestamp, '%Y-%m') AS purchase_month, count(*) AS orders,
  CAST(sum(paid) AS DECIMAL(38,2)) AS total_paid
FROM k_orders LEFT JOIN g_pay USING (order_id)
WHERE CAST(order_purchase_timestamp AS DATE) BETWEEN DATE '1997-03-15' AND DATE '1998-02-10'
GROUP BY ALL""", ["k_orders", "g_pay"])
register(Q, "late_month_refresh", """
SELECT purchase_month, order_status, count(*) AS orders
FROM (SELECT purchase_month, if(coalesce(purchase_month = max(purchase_month) OVER (), false), 'late', order_status) AS order_status
      FROM (SELECT strftime(order_purchase_timestamp, '%Y-%m') AS purchase_month, order_status FROM k_orders) AS months) AS seen
GROUP BY ALL""", ["k_orders"])
register(Q, "csv_folder_customers", "SELECT * FROM k_customer", ["k_customer"])

_EXPORT = {"x_export": ("""
SELECT order_id, payment_type, digit = 4 AND coalesce(payment_type = 'boleto', false) AS unnumbered,
  digit IN (4, 6) AND payment_value IS NOT NULL AS unpriced, payment_sequential, payment_value
FROM (SELECT *, ascii(right(order_id, 1)) % 10 AS digit FROM k_order_payments) AS coded""", ["k_order_payments"])}
register(Q, "csv_quarantine", """
SELECT order_id, if(unnumbered, 'first', CAST(payment_sequential AS VARCHAR)) AS payment_sequential, payment_type,
  if(unpriced, 'R$ ', '') || CAST(payment_value AS VARCHAR) AS payment_value,
  concat_ws(',', if(unnumbered, 'payment_sequential', NULL), if(unpriced, 'payment_value', NULL)) AS reason
FROM x_export WHERE unnumbered OR unpriced""", ["x_export"], _EXPORT)
register(Q, "csv_import", """
SELECT order_id, payment_sequential, payment_type, payment_value FROM x_export WHERE NOT (unnumbered OR unpriced)""",
         ["x_export"], _EXPORT)
register(Q, "csv_import_counts", """
SELECT unnest(['rows', 'rejected', 'fault_payment_sequential', 'fault_payment_value', 'fault_malformed']) AS count,
  unnest([count(*), count(*) FILTER (unnumbered OR unpriced), count(*) FILTER (unnumbered), count(*) FILTER (unpriced), 0]) AS n
FROM x_export""", ["x_export"], _EXPORT)
register(Q, "database_tables", f"SELECT unnest({list(SCHEMAS)}) AS table_name", [])

# The published views and their keys, the exported tables and theirs.
_VIEWS = ["orders_detail", "customer_profile", "seller_profile", "product_profile", "payment_profile", "zone_profile"]
_MODEL = {"fact_order_items": "fact_order_items", "dim_order_hub": "order_hub", "dim_customer": "dim_customer",
          "dim_seller": "dim_seller", "dim_product": "dim_product", "dim_order_payments": "order_payments_model",
          "calendar": "calendar"}
register(Q, "views_published", " UNION ALL ".join(
    f"SELECT '{v}' AS view, count(*) AS rows FROM {{{{sql:{v}}}}} AS v" for v in _VIEWS), [])
register(Q, "model_exported", " UNION ALL ".join(
    f"SELECT '{n}' AS model_table, count(*) AS rows FROM {{{{sql:{k}}}}} AS m" for n, k in _MODEL.items()), [])
