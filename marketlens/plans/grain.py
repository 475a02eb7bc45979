"""Per-order building blocks (O11) shared by the views and questions.

Every table hanging off an order is reduced to one row per order first
(hash aggregate with map-side partial aggregation), so later joins are
one-to-one on ``order_id`` and never multiply rows.  The source's
many-to-many joins (items x payments x reviews of one order) are then
reproduced arithmetically: a left join contributes ``m(n) = greatest(n, 1)``
rows per order for a side with ``n`` matches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions.columns import at_least_one, day_diff


def per_order(df: DataFrame, *aggs) -> DataFrame:
    """One row per order with the given aggregates."""
    return df.groupBy("order_id").agg(*aggs)


def per_order_items(t: dict[str, DataFrame], *more) -> DataFrame:
    """ni = item rows, ni_ids = non-null positions, freight sum / count, and
    ``more`` aggregates of the same pass."""
    return per_order(t["order_item"],
        F.count(F.lit(1)).alias("ni"),
        F.count("order_item_id").alias("ni_ids"),
        F.sum("freight_value").alias("freight_sum"),
        F.count("freight_value").alias("freight_cnt"), *more)


def items_per_order(t: dict[str, DataFrame]) -> DataFrame:
    """Item rows, positions and freight per order."""
    return per_order_items(t)


def payments_per_order(t: dict[str, DataFrame]) -> DataFrame:
    """W3 CTE: np = payment rows, pay_sum = sum(payment_value) per order."""
    return per_order(t["order_payments"],
        F.count(F.lit(1)).alias("np"),
        F.sum("payment_value").alias("pay_sum"),
        F.count("payment_value").alias("pay_cnt"))


def reviews_per_order(t: dict[str, DataFrame]) -> DataFrame:
    """W3 CTE: nr = review rows, score sum / count of non-null scores."""
    return per_order(t["order_reviews"],
        F.count(F.lit(1)).alias("nr"),
        F.count("review_score").alias("score_cnt"),
        F.sum("review_score").cast("bigint").alias("score_sum"))


def fanout_weights(t: dict[str, DataFrame], payments: bool = True,
                   reviews: bool = True, orders: DataFrame | None = None) -> DataFrame:
    """Per order: ``w`` = m(np) * m(nr), the rows one item row of the
    order-detail view stands for (only the sides asked for), beside the columns
    of ``orders`` (default: the ids alone), which are so read once."""
    o = t["orders"].select("order_id") if orders is None else orders
    kept, w = o.columns, F.lit(1).cast("bigint")
    if payments:
        o = o.join(t["order_payments"].groupBy("order_id").agg(
            F.count(F.lit(1)).alias("np")), "order_id", "left")
        w = w * at_least_one("np")
    if reviews:
        o = o.join(t["order_reviews"].groupBy("order_id").agg(
            F.count(F.lit(1)).alias("nr")), "order_id", "left")
        w = w * at_least_one("nr")
    return o.select(*kept, w.alias("w"))


def products_translated(t: dict[str, DataFrame]) -> DataFrame:
    """Products with their translated category.  The translation is joined
    here, at product grain: the item table is never dealt out by its category,
    a key of a few dozen values."""
    p = t["products"].select(F.col("product_id").alias("p_product_id"), "product_category_name")
    tr = t["translation"].select(F.col("product_category_name").alias("tr_name"),
                                 F.col("product_category_name_english").alias("category"))
    return p.join(tr, p["product_category_name"] == tr["tr_name"], "left").select(
        "p_product_id", "category")


def items_enriched(t: dict[str, DataFrame], product: bool = True,
                   seller: bool = True) -> DataFrame:
    """Item grain with product, translated category and seller attributes.

    ``product_id`` / ``seller_id`` come from the dimension tables (null when
    the referenced row is missing), as in the order-detail view.  Callers
    ask only for the dimensions they read: Catalyst cannot drop an unused
    left join to a plain table, and at scale each one is a shuffle of the
    item table on the dimension key.
    """
    oi = t["order_item"]
    j = oi
    cols = [oi["order_id"], oi["order_item_id"], oi["product_id"].alias("item_product_id"),
            oi["price"], oi["freight_value"], oi["shipping_limit_date"].alias("ship_limit_at"),
            oi["seller_id"].alias("item_seller_id")]
    if product:
        p = products_translated(t)
        j = j.join(p, oi["product_id"] == p["p_product_id"], "left")
        cols += [F.col("p_product_id").alias("product_id"), F.col("category")]
    if seller:
        s = t["sellers"].select(F.col("seller_id").alias("s_seller_id"),
                                F.col("seller_zip_code_prefix").alias("seller_zip"),
                                F.col("seller_city"), F.col("seller_state"))
        j = j.join(s, oi["seller_id"] == s["s_seller_id"], "left")
        cols += [F.col("s_seller_id").alias("seller_id"), "seller_zip", "seller_city",
                 "seller_state"]
    return j.select(*cols)


def orders_with_customer(t: dict[str, DataFrame], how: str = "left") -> DataFrame:
    """Orders with the customer's attributes (customer_id from *customer*)."""
    o = t["orders"]
    c = t["customer"].select(F.col("customer_id").alias("c_customer_id"),
                             F.col("customer_zip_code_prefix").alias("customer_zip"),
                             "customer_city", "customer_state")
    j = o.join(c, o["customer_id"] == c["c_customer_id"], how)
    return j.select(
        o["order_id"], o["order_status"],
        o["order_purchase_timestamp"].alias("purchased_at"),
        o["order_approved_at"].alias("approved_at"),
        o["order_delivered_carrier_date"].alias("handed_to_carrier_at"),
        o["order_estimated_delivery_date"].alias("estimated_delivery_at"),
        o["order_delivered_customer_date"].alias("delivered_at"),
        F.col("c_customer_id").alias("customer_id"),
        "customer_zip", "customer_city", "customer_state")


def delivery_days(t: dict[str, DataFrame]) -> DataFrame:
    """Per order: days from purchase to delivery and to the estimate."""
    o = t["orders"]
    return o.select(
        "order_id",
        day_diff("order_purchase_timestamp", "order_delivered_customer_date").alias("days"),
        day_diff("order_purchase_timestamp", "order_estimated_delivery_date")
        .alias("est_days"))
