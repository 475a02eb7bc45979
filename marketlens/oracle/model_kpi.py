"""DuckDB oracle SQL for the star model (M) and the measures (K)."""

from __future__ import annotations

from marketlens.functions.labels import ACCENTED, NEGATIVE_SCORE, STATUS_LABELS, UNACCENTED
from marketlens.oracle.ctes import SPECS, avg_of_avgs, dd, ratio, register
from marketlens.oracle.queries import Q

EXTRA = {
    "m_fact": ("""
SELECT oi.order_item_id, oi.order_id, o.customer_id, oi.product_id, oi.seller_id, oi.price,
  oi.freight_value, oi.shipping_limit_date
FROM k_order_item oi JOIN k_orders o ON oi.order_id = o.order_id""",
               ["k_order_item", "k_orders"]),
    "m_sales": ("""
SELECT f.order_id, f.customer_id, f.product_id, f.price, o.order_purchase_timestamp,
  o.order_approved_at, o.order_delivered_customer_date
FROM m_fact f JOIN k_orders o ON f.order_id = o.order_id""", ["m_fact", "k_orders"]),
    "m_reviews": (f"""
SELECT order_id, {ratio('sum(review_score)', 'count(review_score)')} AS avg_review_score,
  count(*) AS review_count, max(review_score) AS max_review_score,
  min(review_score) AS min_review_score
FROM k_order_reviews GROUP BY order_id""", ["k_order_reviews"]),
    "m_calendar": ("""
SELECT date,
  CAST(year(date) * 10000 + month(date) * 100 + day(date) AS INTEGER) AS date_key,
  CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
  strftime(date, '%b') AS month_short, strftime(date, '%Y-%m') AS year_month,
  strftime(date, '%b %Y') AS year_month_short, CAST(quarter(date) AS INTEGER) AS quarter,
  CAST(year(date) AS VARCHAR) || '-Q' || CAST(quarter(date) AS VARCHAR) AS year_quarter,
  CAST(weekofyear(date) AS INTEGER) AS week_of_year,
  CAST(ceil((day(date) + isodow(CAST(date_trunc('month', date) AS DATE)) - 1) / 7.0)
       AS INTEGER) AS week_of_month,
  CAST(date + CAST(7 - isodow(date) AS INTEGER) AS DATE) AS week_end,
  CAST(date_trunc('month', date) AS DATE) AS month_start, last_day(date) AS month_end,
  CAST(day(date) AS INTEGER) AS day, strftime(date, '%a') AS day_short,
  CAST(dayofyear(date) AS INTEGER) AS day_of_year, CAST(isodow(date) AS INTEGER) AS day_of_week
FROM (SELECT CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP),
                                         INTERVAL 1 DAY)) AS DATE) AS date
      FROM (SELECT min(CAST(order_purchase_timestamp AS DATE)) AS lo,
                   max(CAST(order_purchase_timestamp AS DATE)) AS hi FROM k_orders) b) d""",
                   ["k_orders"]),
    "m_first": ("""
SELECT c.customer_unique_id, min(o.order_purchase_timestamp) AS first_purchase
FROM k_orders o JOIN k_customer c ON o.customer_id = c.customer_id GROUP BY 1""",
                ["k_orders", "k_customer"]),
    "m_state_days": (f"""
SELECT c.customer_state AS state, {ratio('sum(days)', 'count(days)')} AS avg_days
FROM (SELECT customer_id, {dd('order_purchase_timestamp', 'order_delivered_customer_date')}
        AS days FROM k_orders) o
JOIN k_customer c ON o.customer_id = c.customer_id
WHERE days IS NOT NULL GROUP BY 1""", ["k_orders", "k_customer"]),
}


def _q(key: str, body: str, needs: list[str]) -> None:
    register(Q, key, body, needs, EXTRA)


def _alias(key: str, base: str) -> None:
    Q[key] = Q[base]
    SPECS[key] = SPECS[base]


def _norm(col: str) -> str:
    return (f"translate(lower(regexp_replace(trim({col}), '\\s+', ' ', 'g')), "
            f"'{ACCENTED}', '{UNACCENTED}')")


def _sub(key: str, col: str) -> str:
    """Scalar subquery over another registered query's SQL."""
    return f"(SELECT {col} FROM {{{{sql:{key}}}}} s)"


# --------------------------------------------------------------- star model
_q("fact_order_items", "SELECT * FROM m_fact", ["m_fact"])
_q("review_metrics", "SELECT * FROM m_reviews", ["m_reviews"])
_q("order_hub", """
SELECT o.order_id, o.customer_id, i.seller_id, o.order_status,
  o.order_purchase_timestamp AS purchased_at, o.order_approved_at AS approved_at,
  o.order_delivered_customer_date AS delivered_at,
  o.order_estimated_delivery_date AS estimated_delivery_at,
  o.order_delivered_carrier_date AS handed_to_carrier_at, i.ship_limit_at,
  r.avg_review_score, coalesce(r.review_count, 0) AS review_count, r.max_review_score,
  r.min_review_score
FROM k_orders o
LEFT JOIN (SELECT order_id, min(seller_id) AS seller_id,
             max(shipping_limit_date) AS ship_limit_at
           FROM k_order_item GROUP BY order_id) i ON o.order_id = i.order_id
LEFT JOIN m_reviews r ON o.order_id = r.order_id""", ["k_orders", "k_order_item", "m_reviews"])
_q("dim_customer", """
SELECT c.customer_id, c.customer_unique_id, c.customer_city, c.customer_state,
  c.customer_zip_code_prefix, g.lat AS geolocation_lat, g.lng AS geolocation_lng
FROM k_customer c LEFT JOIN (
  SELECT geolocation_zip_code_prefix AS zip,
    """ + ratio("sum(CAST(geolocation_lat AS DECIMAL(18,10)))", "count(geolocation_lat)") + """ AS lat,
    """ + ratio("sum(CAST(geolocation_lng AS DECIMAL(18,10)))", "count(geolocation_lng)") + """ AS lng
  FROM k_geolocation GROUP BY 1) g ON c.customer_zip_code_prefix = g.zip""",
   ["k_customer", "k_geolocation"])
_q("dim_seller", """
SELECT seller_id, seller_city, seller_state, seller_zip_code_prefix AS seller_zip_code
FROM k_sellers""", ["k_sellers"])
_q("dim_product", """
SELECT p.product_id, t.product_category_name_english AS product_category
FROM k_products p LEFT JOIN k_translation t
  ON p.product_category_name = t.product_category_name""", ["k_products", "k_translation"])
_q("order_payments_model", """
SELECT order_id, payment_sequential, payment_type, payment_value FROM k_order_payments""",
   ["k_order_payments"])
_q("calendar", "SELECT * FROM m_calendar", ["m_calendar"])
_q("status_labels", "SELECT order_status, CASE order_status "
   + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS_LABELS.items())
   + " END AS status_label, count(*) AS orders FROM k_orders GROUP BY order_status",
   ["k_orders"])
_q("normalized_zones", f"""
SELECT DISTINCT geolocation_zip_code_prefix AS zip, {_norm('geolocation_city')} AS city,
  {_norm('geolocation_state')} AS state
FROM k_geolocation""", ["k_geolocation"])
_q("null_report", """
SELECT count(*) AS rows, count(*) - count(seller_id) AS seller_id_nulls,
  count(*) - count(category) AS category_nulls,
  count(*) - count(review_score) AS review_score_nulls
FROM v_w1""", ["v_w1"])

_q("null_report_all", """
SELECT column_name, n AS rows, n - filled AS nulls
FROM (UNPIVOT (SELECT count(COLUMNS(*)) FROM v_w1) ON COLUMNS(*) INTO NAME column_name VALUE filled) AS filled_in,
  (SELECT count(*) AS n FROM v_w1) AS whole""", ["v_w1"])

# ----------------------------------------------------------------- measures
_q("kpi_summary", f"""
SELECT (SELECT CAST(sum(price) AS DECIMAL(38,2)) FROM m_fact) AS total_sales,
  (SELECT count(DISTINCT c.customer_unique_id) FROM m_fact f
     JOIN k_customer c ON f.customer_id = c.customer_id) AS unique_customers,
  (SELECT count(DISTINCT order_id) FROM m_fact) AS orders,
  (SELECT {ratio('sum(price)', 'count(DISTINCT order_id)')} FROM m_fact) AS avg_ticket,
  {_sub('on_time_share', 'on_time_pct')} AS on_time_pct,
  (SELECT {ratio('sum(review_score)', 'count(review_score)')} FROM k_order_reviews)
    AS avg_review_score,
  {_sub('top10_seller_concentration', 'top10_pct')} AS top10_seller_pct""",
   ["m_fact", "k_customer", "k_order_reviews"])
_q("state_customer_share", f"""
SELECT customer_state AS state, count(DISTINCT customer_unique_id) AS customers,
  {ratio('count(DISTINCT customer_unique_id)',
         'sum(count(DISTINCT customer_unique_id)) OVER ()', 100.0)} AS pct
FROM k_customer GROUP BY customer_state""", ["k_customer"])
_q("new_customers_yoy", f"""
WITH y AS (SELECT CAST(year(first_purchase) AS INTEGER) AS year, count(*) AS new_customers
           FROM m_first GROUP BY 1),
l AS (SELECT year, new_customers,
        lag(new_customers) OVER (ORDER BY year ASC NULLS FIRST) AS prev_customers FROM y)
SELECT year, new_customers, prev_customers,
  {ratio('new_customers - prev_customers', 'prev_customers', 100.0)} AS growth_pct
FROM l ORDER BY year""", ["m_first"])
_q("sales_by_city", """
SELECT c.customer_city AS city, CAST(sum(f.price) AS DECIMAL(38,2)) AS sales
FROM m_fact f JOIN k_customer c ON f.customer_id = c.customer_id GROUP BY 1
ORDER BY sales DESC NULLS LAST, city ASC NULLS FIRST LIMIT 5""", ["m_fact", "k_customer"])
_q("units_by_category", """
SELECT category, CAST(sum(unit_count) AS BIGINT) AS units FROM v_w4 GROUP BY category
ORDER BY units DESC NULLS LAST, category ASC NULLS FIRST LIMIT 5""", ["v_w4"])
_q("sales_by_product", """
SELECT product_id, CAST(sum(price) AS DECIMAL(38,2)) AS sales FROM m_fact GROUP BY 1
ORDER BY sales DESC NULLS LAST, product_id ASC NULLS FIRST LIMIT 10""", ["m_fact"])
_q("sales_by_month", """
SELECT CAST(month(order_purchase_timestamp) AS INTEGER) AS month,
  CAST(sum(price) AS DECIMAL(38,2)) AS sales, count(DISTINCT order_id) AS orders
FROM m_sales GROUP BY 1 ORDER BY 1""", ["m_sales"])
_q("sales_by_weekday", """
SELECT CAST(isodow(order_purchase_timestamp) AS INTEGER) AS day_of_week,
  CAST(sum(price) AS DECIMAL(38,2)) AS sales, count(DISTINCT order_id) AS orders
FROM m_sales GROUP BY 1 ORDER BY 1""", ["m_sales"])


def _seg(ts: str) -> str:
    return (f"CASE WHEN month({ts}) = 11 AND isodow({ts}) = 5 THEN 'november_friday' "
            f"ELSE 'other_days' END")


_q("november_fridays", f"""
WITH s AS (SELECT {_seg('order_purchase_timestamp')} AS segment, sum(price) AS sales
           FROM m_sales GROUP BY 1),
d AS (SELECT {_seg('order_purchase_timestamp')} AS segment,
        count(DISTINCT CAST(order_purchase_timestamp AS DATE)) AS days
      FROM k_orders WHERE order_purchase_timestamp IS NOT NULL GROUP BY 1),
n AS (SELECT {_seg('first_purchase')} AS segment, count(*) AS new_customers
      FROM m_first WHERE first_purchase IS NOT NULL GROUP BY 1),
k AS (SELECT segment FROM s UNION SELECT segment FROM d UNION SELECT segment FROM n)
SELECT k.segment, d.days, CAST(s.sales AS DECIMAL(38,2)) AS sales,
  {ratio('s.sales', 'd.days')} AS sales_per_day,
  CAST(coalesce(n.new_customers, 0) AS BIGINT) AS new_customers
FROM k LEFT JOIN s ON k.segment = s.segment LEFT JOIN d ON k.segment = d.segment
LEFT JOIN n ON k.segment = n.segment""", ["m_sales", "k_orders", "m_first"])
_alias("seller_ranking", "seller_order_rank_view")
_alias("seller_concentration", "top10_seller_concentration")
_alias("avg_ticket_by_payment", "avg_payment_by_type")
_alias("single_vs_multi", "multi_payment_share")
_q("delivery_days_overall", f"""
SELECT (SELECT {ratio('sum(days)', 'count(days)')} FROM (
          SELECT {dd('order_purchase_timestamp', 'order_delivered_customer_date')} AS days
          FROM k_orders) o) AS overall_avg_days,
  {_sub('fastest_sellers_row_number_exact', avg_of_avgs('avg_days'))} AS best10_avg_days""",
   ["k_orders"])
_q("delivery_days_extremes", """
SELECT (SELECT state FROM m_state_days ORDER BY avg_days ASC NULLS FIRST, state ASC NULLS FIRST
        LIMIT 1) AS fastest_state,
  (SELECT avg_days FROM m_state_days ORDER BY avg_days ASC NULLS FIRST, state ASC NULLS FIRST
   LIMIT 1) AS fastest_days,
  (SELECT state FROM m_state_days ORDER BY avg_days DESC NULLS LAST, state ASC NULLS FIRST
   LIMIT 1) AS slowest_state,
  (SELECT avg_days FROM m_state_days ORDER BY avg_days DESC NULLS LAST, state ASC NULLS FIRST
   LIMIT 1) AS slowest_days""", ["m_state_days"])
_q("late_share_by_customer_state", f"""
WITH d AS (SELECT customer_id,
             {dd('order_purchase_timestamp', 'order_delivered_customer_date')} AS days,
             {dd('order_purchase_timestamp', 'order_estimated_delivery_date')} AS est
           FROM k_orders WHERE order_purchase_timestamp IS NOT NULL
             AND order_delivered_customer_date IS NOT NULL
             AND order_estimated_delivery_date IS NOT NULL)
SELECT c.customer_state AS state, count(*) AS total_orders,
  CAST(sum(CASE WHEN days > est THEN 1 ELSE 0 END) AS BIGINT) AS late,
  {ratio('sum(CASE WHEN days > est THEN 1 ELSE 0 END)', 'count(*)', 100.0)} AS late_pct
FROM d JOIN k_customer c ON d.customer_id = c.customer_id GROUP BY 1
ORDER BY late_pct DESC NULLS LAST, state""", ["k_orders", "k_customer"])
_q("negative_reviews_by_status", f"""
SELECT o.order_status, count(*) AS reviews,
  CAST(sum(CASE WHEN r.review_score <= {NEGATIVE_SCORE} THEN 1 ELSE 0 END) AS BIGINT)
    AS negative,
  {ratio(f'sum(CASE WHEN r.review_score <= {NEGATIVE_SCORE} THEN 1 ELSE 0 END)',
         'count(*)', 100.0)} AS negative_pct
FROM k_order_reviews r JOIN k_orders o ON r.order_id = o.order_id
WHERE r.review_score IS NOT NULL GROUP BY 1""", ["k_order_reviews", "k_orders"])
_q("state_delivery_vs_score", f"""
WITH sc AS (SELECT c.customer_state AS state,
              {ratio('sum(r.review_score)', 'count(r.review_score)')} AS avg_score
            FROM k_orders o JOIN k_customer c ON o.customer_id = c.customer_id
            JOIN k_order_reviews r ON r.order_id = o.order_id GROUP BY 1)
SELECT coalesce(a.state, b.state) AS state, a.avg_days, b.avg_score
FROM m_state_days a FULL JOIN sc b ON a.state IS NOT DISTINCT FROM b.state""",
   ["m_state_days", "k_orders", "k_customer", "k_order_reviews"])
_q("five_star_share", f"""
SELECT (SELECT {ratio('sum(CASE WHEN review_score = 5 THEN 1 ELSE 0 END)', 'count(*)', 100.0)}
        FROM k_order_reviews WHERE review_score IS NOT NULL) AS five_star_pct,
  (SELECT {ratio('sum(review_score)', 'count(review_score)')} FROM k_order_reviews r
   WHERE review_score IS NOT NULL AND EXISTS (
     SELECT 1 FROM k_orders o WHERE o.order_id = r.order_id
       AND o.order_status = 'delivered')) AS delivered_avg_score""",
   ["k_order_reviews", "k_orders"])
_q("sales_ytd_mtd", """
WITH d AS (SELECT CAST(order_purchase_timestamp AS DATE) AS date, sum(price) AS sales
           FROM m_sales WHERE order_purchase_timestamp IS NOT NULL GROUP BY 1)
SELECT date, CAST(sales AS DECIMAL(38,2)) AS sales,
  CAST(sum(sales) OVER (PARTITION BY year(date) ORDER BY date
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(38,2)) AS sales_ytd,
  CAST(sum(sales) OVER (PARTITION BY year(date), month(date) ORDER BY date
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(38,2)) AS sales_mtd
FROM d""", ["m_sales"])
_q("sales_yoy", f"""
WITH m AS (SELECT CAST(year(order_purchase_timestamp) AS INTEGER) AS year,
             CAST(month(order_purchase_timestamp) AS INTEGER) AS month, sum(price) AS sales
           FROM m_sales WHERE order_purchase_timestamp IS NOT NULL GROUP BY 1, 2)
SELECT m.year, m.month, CAST(m.sales AS DECIMAL(38,2)) AS sales,
  CAST(p.sales AS DECIMAL(38,2)) AS prev_year_sales,
  {ratio('m.sales - p.sales', 'p.sales', 100.0)} AS yoy_pct
FROM m LEFT JOIN m p ON p.year = m.year - 1 AND p.month = m.month
ORDER BY m.year, m.month""", ["m_sales"])
for _key, _col in (("sales_by_purchase_month", "order_purchase_timestamp"),
                   ("sales_by_delivery_month", "order_delivered_customer_date"),
                   ("sales_by_approval_month", "order_approved_at")):
    _q(_key, f"""
SELECT c.year_month, CAST(sum(s.price) AS DECIMAL(38,2)) AS sales
FROM m_sales s LEFT JOIN m_calendar c ON CAST(s.{_col} AS DATE) = c.date
GROUP BY 1 ORDER BY 1 NULLS FIRST""", ["m_sales", "m_calendar"])
