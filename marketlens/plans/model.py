"""Star model of the BI layer (M1-M13), documented in prose only by the
source; the rules it leaves open are fixed here and stated per function.

Grain: ``fact_order_items`` one row per item; ``order_hub`` one row per
order; dimensions one row per key; ``calendar`` one row per day between the
first and the last purchase date.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.plans.grain import items_enriched, orders_with_customer
from marketlens.functions.columns import (at_least_one, normalize_text, ratio,
                                          status_label)

T = dict[str, DataFrame]


def fact_order_items(t: T) -> DataFrame:
    """M1: item-grain fact with the order's customer."""
    oi = t["order_item"]
    o = t["orders"].select("order_id", "customer_id")
    return oi.join(o, "order_id", "inner").select(
        "order_item_id", "order_id", "customer_id", "product_id", "seller_id", "price",
        "freight_value", "shipping_limit_date")


def review_metrics(t: T) -> DataFrame:
    """M8: per order average, count (review rows), min and max score; an
    order whose scores are all null keeps null metrics."""
    r = t["order_reviews"].groupBy("order_id").agg(
        F.sum("review_score").alias("_s"), F.count("review_score").alias("_n"),
        F.count(F.lit(1)).alias("review_count"),
        F.min("review_score").alias("min_review_score"),
        F.max("review_score").alias("max_review_score"))
    return r.select("order_id", ratio("_s", "_n").alias("avg_review_score"),
                    "review_count", "max_review_score", "min_review_score")


def order_hub(t: T) -> DataFrame:
    """M2: one row per order with dates, status, review metrics, and item
    attributes reduced to order grain (smallest seller id, latest shipping
    limit) — the documented hub has them at order grain without a rule."""
    o = t["orders"]
    it = t["order_item"].groupBy("order_id").agg(
        F.min("seller_id").alias("seller_id"),
        F.max("shipping_limit_date").alias("ship_limit_at"))
    j = o.join(it, "order_id", "left").join(review_metrics(t), "order_id", "left")
    return j.select(
        "order_id", "customer_id", "seller_id", "order_status",
        F.col("order_purchase_timestamp").alias("purchased_at"),
        F.col("order_approved_at").alias("approved_at"),
        F.col("order_delivered_customer_date").alias("delivered_at"),
        F.col("order_estimated_delivery_date").alias("estimated_delivery_at"),
        F.col("order_delivered_carrier_date").alias("handed_to_carrier_at"),
        "ship_limit_at", "avg_review_score", F.coalesce("review_count", F.lit(0))
        .alias("review_count"), "max_review_score", "min_review_score")


def dim_customer(t: T) -> DataFrame:
    """M3: customer with one point per zip: the average of its points, whose
    coordinates are summed exactly at ten decimals, so that it is the same
    whatever order the rows come in."""
    def mean(c):
        return ratio(F.sum(F.col(c).cast("decimal(18,10)")), F.count(c)).alias(c)

    g = t["geolocation"].groupBy(F.col("geolocation_zip_code_prefix").alias("customer_zip_code_prefix")).agg(
        mean("geolocation_lat"), mean("geolocation_lng"))
    c = t["customer"]
    return c.join(g, "customer_zip_code_prefix", "left").select(
        "customer_id", "customer_unique_id", "customer_city", "customer_state",
        "customer_zip_code_prefix", "geolocation_lat", "geolocation_lng")


def dim_seller(t: T) -> DataFrame:
    """M4: seller dimension."""
    return t["sellers"].select("seller_id", "seller_city", "seller_state",
                               F.col("seller_zip_code_prefix").alias("seller_zip_code"))


def dim_product(t: T) -> DataFrame:
    """M5: product with its translated category (null when untranslated)."""
    tr = t["translation"]
    return t["products"].join(tr, "product_category_name", "left").select(
        "product_id", F.col("product_category_name_english").alias("product_category"))


def order_payments_model(t: T) -> DataFrame:
    """M6: payments by order."""
    return t["order_payments"].select("order_id", "payment_sequential", "payment_type",
                                      "payment_value")


def calendar(t: T, date_col: str = "order_purchase_timestamp") -> DataFrame:
    """M7: one row per day from the first to the last purchase date.

    The day list comes from a one-row (min, max) aggregate: its size is the
    calendar span, independent of the number of orders.  Weeks start on
    Monday; ``week_of_month`` = ceil((day + weekday of the 1st) / 7).
    """
    d = F.to_date(F.col(date_col))
    bounds = t["orders"].agg(F.min(d).alias("lo"), F.max(d).alias("hi"))
    days = bounds.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 day")))
                         .alias("date"))
    wd = F.weekday("date")  # 0 = Monday
    month_start = F.trunc("date", "month")
    return days.select(
        "date",
        (F.year("date") * 10000 + F.month("date") * 100 + F.dayofmonth("date"))
        .alias("date_key"),
        F.year("date").alias("year"), F.month("date").alias("month"),
        F.date_format("date", "MMM").alias("month_short"),
        F.date_format("date", "yyyy-MM").alias("year_month"),
        F.date_format("date", "MMM yyyy").alias("year_month_short"),
        F.quarter("date").alias("quarter"),
        F.concat(F.year("date").cast("string"), F.lit("-Q"),
                 F.quarter("date").cast("string")).alias("year_quarter"),
        F.weekofyear("date").alias("week_of_year"),
        F.ceil((F.dayofmonth("date") + F.weekday(month_start)) / 7).cast("int")
        .alias("week_of_month"),
        F.date_add("date", (F.lit(6) - wd).cast("int")).alias("week_end"),
        month_start.alias("month_start"), F.last_day("date").alias("month_end"),
        F.dayofmonth("date").alias("day"),
        F.date_format("date", "EEE").alias("day_short"),
        F.dayofyear("date").alias("day_of_year"),
        (wd + 1).alias("day_of_week"))


ROLE_COLUMNS = {"purchase": "order_purchase_timestamp",
                "delivered": "order_delivered_customer_date",
                "approved": "order_approved_at"}


def with_calendar(t: T, df: DataFrame, role: str = "purchase") -> DataFrame:
    """Attach calendar attributes through the active (purchase) or an
    inactive (delivered, approved) date relation; ``df`` must carry the
    three order date columns.  Rows keep their place in the relation: one
    without a calendar day (no date, or outside the calendar's span) gets
    null attributes, the blank member, and is never dropped.  The calendar
    has one row per day, so the join is one-to-one per row.
    """
    cal = calendar(t)
    return df.join(cal, F.to_date(df[ROLE_COLUMNS[role]]) == cal["date"], "left")


def status_labels(t: T) -> DataFrame:
    """M9: order status codes with their display label and order count."""
    g = t["orders"].groupBy("order_status").agg(F.count(F.lit(1)).alias("orders"))
    return g.select("order_status", status_label("order_status").alias("status_label"),
                    "orders")


def normalized_zones(t: T) -> DataFrame:
    """M10 applied to the zip zones: distinct (zip, city, state) after text
    normalisation, so spelling variants of one place collapse."""
    g = t["geolocation"]
    return g.select(F.col("geolocation_zip_code_prefix").alias("zip"),
                    normalize_text("geolocation_city").alias("city"),
                    normalize_text("geolocation_state").alias("state")).distinct()


# Columns of the order-detail view by the table that each comes from.
DETAIL_GRAINS = {
    "order": ["order_id", "order_status", "purchased_at", "approved_at", "handed_to_carrier_at",
              "estimated_delivery_at", "delivered_at", "customer_id", "customer_zip", "customer_city", "customer_state"],
    "item": ["ship_limit_at", "product_id", "category", "order_item_id", "price", "freight_value", "seller_id",
             "seller_zip", "seller_city", "seller_state"],
    "payment": ["payment_type", "payment_value"],
    "review": ["review_score"],
}


def detail_null_counts(t: T, cols: Sequence[str]) -> DataFrame:
    """One row: ``rows`` of the order-detail view and, per column of it,
    ``<column>_nulls``, without forming the view.

    Each column's nulls are counted per order at the grain of its table and
    weighed with the rows of the other sides; a side without rows is one row of
    nulls."""
    asked = {g: [c for c in of if c in cols] for g, of in DETAIL_GRAINS.items()}
    unknown = set(cols).difference(*asked.values())
    if unknown:
        raise ValueError(f"no columns of the order detail: {', '.join(sorted(unknown))}")

    def side(df: DataFrame, grain: str, n: str) -> DataFrame:
        return df.groupBy("order_id").agg(F.count(F.lit(1)).alias(n), *[
            F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in asked[grain]])

    of_product, of_seller = ({"product_id", "category"}, {c for c in DETAIL_GRAINS["item"] if c.startswith("seller")})
    items = items_enriched(t, product=bool(of_product & set(cols)), seller=bool(of_seller & set(cols))) \
        if (of_product | of_seller) & set(cols) else \
        t["order_item"].withColumnRenamed("shipping_limit_date", "ship_limit_at")
    customer = any(c.startswith("customer") for c in asked["order"])
    orders = orders_with_customer(t) if customer else t["orders"].withColumnsRenamed({
        "order_purchase_timestamp": "purchased_at", "order_approved_at": "approved_at",
        "order_delivered_carrier_date": "handed_to_carrier_at", "order_estimated_delivery_date": "estimated_delivery_at",
        "order_delivered_customer_date": "delivered_at"})
    j = (orders.select("order_id", *[F.col(c).isNull().cast("int").alias(f"null_{c}") for c in asked["order"]])
         .join(side(items, "item", "ni"), "order_id", "left")
         .join(side(t["order_payments"], "payment", "np"), "order_id", "left")
         .join(side(t["order_reviews"], "review", "nr"), "order_id", "left"))
    mi, mp, mr = at_least_one("ni"), at_least_one("np"), at_least_one("nr")
    others = {"order": ("", mi * mp * mr), "item": ("ni", mp * mr), "payment": ("np", mi * mr), "review": ("nr", mi * mp)}
    sums = []
    for grain, (n, weight) in others.items():
        for c in asked[grain]:
            nulls = F.when(F.coalesce(F.col(n), F.lit(0)) == 0, 1).otherwise(F.col(f"null_{c}")) if n else F.col(f"null_{c}")
            sums.append(F.sum(nulls * weight).cast("bigint").alias(f"{c}_nulls"))
    return j.agg(F.sum(mi * mp * mr).cast("bigint").alias("rows"), *sums)


def null_report(t: T) -> DataFrame:
    """Nulls of seller, category and review score over the order-detail view."""
    return detail_null_counts(t, ["seller_id", "category", "review_score"])


def null_report_all(t: T) -> DataFrame:
    """M11 for every column of the order-detail view, a row each."""
    cols = [c for of in DETAIL_GRAINS.values() for c in of]
    one = detail_null_counts(t, cols)
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("rows"), F.col(f"{c}_nulls").alias("nulls"))
                                          for c in cols])).alias("r")).select("r.*")


QUERIES = {
    "fact_order_items": fact_order_items,
    "order_hub": order_hub,
    "dim_customer": dim_customer,
    "dim_seller": dim_seller,
    "dim_product": dim_product,
    "order_payments_model": order_payments_model,
    "calendar": calendar,
    "review_metrics": review_metrics,
    "status_labels": status_labels,
    "normalized_zones": normalized_zones,
    "null_report": null_report,
    "null_report_all": null_report_all,
}
