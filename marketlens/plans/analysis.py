"""The business questions (Q01-Q27) and their clean / exact variants.

Each is ``f(t, **opts) -> DataFrame``.  Day averages follow the source
dialect's integer ``avg`` (``int_avg=True``); review averages are fractional.
Top-n cuts get a unique tie-breaker (the source leaves ties undefined).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions.columns import (at_least_one, avg_days, bucketize,
                                          day_diff, fixed, grade, int_div, pct, ratio)
from marketlens.functions.labels import INVALID_BUCKET
from marketlens.operators.ranking import dense_rank_all, rank_by, top_n, top_n_ranked
from marketlens.operators.shares import (conditional_share, period_growth,
                                         share_of_top_n)
from marketlens.plans.grain import (delivery_days, fanout_weights, items_enriched,
                                    items_per_order, orders_with_customer, payments_per_order,
                                    products_translated)
from marketlens.plans.views import (customer_profile, payment_profile,
                                    product_profile, seller_profile, unique_items,
                                    zone_profile, zone_profile_clean)
from marketlens.schema import FREIGHT_SUM, MONEY_SUM

T = dict[str, DataFrame]
ASC = F.asc_nulls_first
DESC = F.desc_nulls_last


# ------------------------------------------------- 3.1 customers and market
def _sum_by(df: DataFrame, key: str, value: str, alias: str) -> DataFrame:
    return df.groupBy(key).agg(F.sum(value).cast("bigint").alias(alias))


def top_states_by_customers(t: T, n: int = 10, clean: bool = False) -> DataFrame:
    """Q01: states with most customers (sum over zones of the zone view)."""
    z = zone_profile_clean(t) if clean else zone_profile(t)
    return top_n(_sum_by(z, "state", "customer_count", "customers"),
                 [DESC("customers"), ASC("state")], n)


def new_customers_growth(t: T) -> DataFrame:
    """Q02: customers by month of first purchase and growth against the
    previous month.  Reads orders and customer only: the other joins of the
    order-detail view cannot change a minimum."""
    oc = orders_with_customer(t, "left").select("customer_id", "purchased_at")
    first = oc.groupBy("customer_id").agg(F.min("purchased_at").alias("first_purchase"))
    monthly = first.groupBy(F.year("first_purchase").alias("year"),
                            F.month("first_purchase").alias("month")).agg(
        F.count("customer_id").alias("new_customers"))
    out = period_growth(monthly, ["year", "month"], "new_customers",
                        prev="prev_customers", growth="growth_pct")
    return out.orderBy(ASC("year"), ASC("month"))


def top_cities_by_customers(t: T, n: int = 10) -> DataFrame:
    """Q03: cities with most customers (the title asks order volume)."""
    return top_n(_sum_by(zone_profile(t), "city", "customer_count", "customers"),
                 [DESC("customers"), ASC("city")], n)


def top_cities_by_orders(t: T, n: int = 10) -> DataFrame:
    """Q03 clean: cities by delivered-order count of the zone view."""
    return top_n(_sum_by(zone_profile(t), "city", "order_count", "orders"),
                 [DESC("orders"), ASC("city")], n)


# ------------------------------------------------- 3.2 sales and products
def _units_by_category(t: T) -> DataFrame:
    # the product view's unit_count is a row count of the distinct items, so
    # its per-category sum is the distinct items' row count per category
    return unique_items(t).groupBy("category").agg(F.count(F.lit(1)).alias("units"))


def top_categories_by_units(t: T, n: int = 10) -> DataFrame:
    """Q04: categories with most units (null category included)."""
    return top_n(_units_by_category(t), [DESC("units"), ASC("category")], n)


def bottom_categories_by_units(t: T, n: int = 10) -> DataFrame:
    """Q05: categories with fewest units (null category included)."""
    return top_n(_units_by_category(t), [ASC("units"), ASC("category")], n)


def avg_ticket_by_customer(t: T) -> DataFrame:
    """Q06: spend / distinct positions per customer, highest first."""
    g = customer_profile(t).groupBy("customer_id").agg(
        F.sum("total_spent").alias("s"), F.sum("items_bought").alias("n"))
    return g.select("customer_id", ratio("s", "n").alias("avg_ticket")) \
        .orderBy(DESC("avg_ticket"), ASC("customer_id"))


def avg_ticket_by_order(t: T) -> DataFrame:
    """Q07: per order sum(payment) / count(item) over payment x item rows:
    pay_sum * ni / (np * ni_ids), kept as an exact fraction."""
    o = t["orders"].select("order_id")
    j = (payments_per_order(t).join(o, "order_id", "inner")
         .join(items_per_order(t), "order_id", "inner"))
    return j.select("order_id", ratio(F.col("pay_sum") * F.col("ni"),
                                      F.col("np") * F.col("ni_ids")).alias("avg_ticket")) \
        .orderBy(DESC("avg_ticket"), ASC("order_id"))


def top_products_net_of_freight(t: T, n: int = 10) -> DataFrame:
    """Q08: product view rows left-joined to every item of the product.

    Factorised: a product's R view rows each meet its n items, so sales
    count m(n) times and each item's freight R times.
    """
    # a product has one category, so its view rows are its customer places; the view sums each (order, position,
    # price) of a place once
    place = orders_with_customer(t, "left").select("order_id", "customer_city", "customer_state")
    lines = t["order_item"].select("order_id", "order_item_id", "product_id", "price").distinct()
    w4 = (place.join(lines, "order_id", "left").groupBy("product_id", "customer_city", "customer_state")
          .agg(F.sum("price").alias("S")).groupBy("product_id").agg(F.sum("S").alias("S"), F.count(F.lit(1)).alias("R")))
    it = t["order_item"].groupBy("product_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("freight_value").alias("Fr"))
    j = w4.join(it, "product_id", "left")
    sales = (F.col("S") * at_least_one("n")).cast(MONEY_SUM)
    freight = (F.col("Fr") * F.col("R")).cast(FREIGHT_SUM)
    out = j.select("product_id", sales.alias("total_sales"), freight.alias("total_freight"),
                   (sales - freight).cast(FREIGHT_SUM).alias("net_sales"))
    return top_n(out, [DESC("net_sales"), ASC("product_id")], n)


def top_products_net_of_freight_clean(t: T, n: int = 10) -> DataFrame:
    """Q08 clean: per product, item prices minus item freight, once each."""
    it = t["order_item"].join(t["orders"].select("order_id"), "order_id", "left_semi")
    g = it.groupBy("product_id").agg(F.sum("price").alias("s"),
                                     F.sum("freight_value").alias("f"))
    out = g.select("product_id", F.col("s").cast(MONEY_SUM).alias("total_sales"),
                   F.col("f").cast(FREIGHT_SUM).alias("total_freight"),
                   (F.col("s") - F.col("f")).cast(FREIGHT_SUM).alias("net_sales"))
    return top_n(out, [DESC("net_sales"), ASC("product_id")], n)


def _category_share(t: T, swapped: bool) -> DataFrame:
    # per-category sum of the product view's sales = sum of distinct items' prices
    cats = unique_items(t).groupBy("category").agg(F.sum("price").alias("sales"))
    s = share_of_top_n(cats, "sales", 10, [DESC("sales"), ASC("category")])
    top = pct("top_sales", "all_sales")
    rest = pct(F.col("all_sales") - F.col("top_sales"), "all_sales")
    if swapped:
        top, rest = rest, top
    return s.select(top.alias("top10_pct"), rest.alias("rest_pct"))


def top10_category_share(t: T) -> DataFrame:
    """Q09: % of sales in the 10 best-selling categories and in the rest."""
    return _category_share(t, swapped=False)


def top10_category_share_subquery(t: T) -> DataFrame:
    """Q10: the derived-table formulation, labels swapped as in the source."""
    return _category_share(t, swapped=True)


# ------------------------------------------------- 3.3 sellers
def seller_order_rank(t: T, n: int = 10) -> DataFrame:
    """Q11: distinct orders per seller of the order-detail view (null seller
    = orders without a known seller), dense rank, first n by rank."""
    o = t["orders"].select("order_id")
    it = items_enriched(t, product=False).select("order_id", "seller_id")
    pairs = o.join(it, "order_id", "left").select("seller_id", "order_id").distinct()
    g = pairs.groupBy("seller_id").agg(F.count(F.lit(1)).alias("orders"))
    return top_n_ranked(g, [DESC("orders")], [ASC("seller_id")], n, "dense_rank") \
        .orderBy("rank", ASC("seller_id"))


def seller_order_rank_view(t: T, n: int = 10) -> DataFrame:
    """Q12: the same ranking from the seller view."""
    g = seller_profile(t).groupBy("seller_id").agg(
        F.sum("order_count").cast("bigint").alias("orders"))
    return top_n_ranked(g, [DESC("orders")], [ASC("seller_id")], n, "dense_rank") \
        .orderBy("rank", ASC("seller_id"))


def top10_seller_concentration(t: T) -> DataFrame:
    """Q13: % of sales and orders of the 10 best-selling sellers and the rest."""
    g = seller_profile(t).groupBy("seller_id").agg(
        F.sum("total_sales").alias("sales"), F.sum("order_count").alias("orders"))
    s = share_of_top_n(g, "sales", 10, [DESC("sales"), ASC("seller_id")], extra=["orders"])
    return s.select(
        pct("top_sales", "all_sales").alias("top10_pct"),
        F.col("top_orders").cast("bigint").alias("top10_orders"),
        pct(F.col("all_sales") - F.col("top_sales"), "all_sales").alias("rest_pct"),
        (F.col("all_orders") - F.col("top_orders")).cast("bigint").alias("rest_orders"))


def _seller_delivery_days(t: T, int_avg: bool) -> DataFrame:
    """Average days per seller over the order-detail rows of delivered
    items (days > 0); every item row stands for m(np) * m(nr) view rows."""
    d = delivery_days(t).where(F.col("days") > 0).select("order_id", "days")
    it = items_enriched(t, product=False).where(F.col("seller_id").isNotNull()) \
        .select("order_id", "seller_id")
    j = it.join(fanout_weights(t, orders=d), "order_id", "inner")
    g = j.groupBy("seller_id").agg(F.sum(F.col("days") * F.col("w")).alias("s"),
                                   F.sum("w").alias("c"))
    return g.select("seller_id", avg_days("s", "c", int_avg).alias("avg_days"))


def fastest_sellers_row_number(t: T, n: int = 10, int_avg: bool = True) -> DataFrame:
    """Q14: the n sellers with the lowest average delivery days."""
    g = _seller_delivery_days(t, int_avg)
    return top_n_ranked(g, [ASC("avg_days")], [ASC("seller_id")], n, "row_number") \
        .orderBy("rank")


def fastest_sellers_row_number_all(t: T, int_avg: bool = True) -> DataFrame:
    """Q14 without its cut: every seller's number by average delivery days."""
    return rank_by(_seller_delivery_days(t, int_avg), "avg_days", "row_number",
                   tie_breakers=[ASC("seller_id")])


def fastest_sellers_dense_rank(t: T, int_avg: bool = True) -> DataFrame:
    """Q15: every seller with its dense rank by average delivery days."""
    g = _seller_delivery_days(t, int_avg)
    return dense_rank_all(g, "avg_days", ascending=True).orderBy(ASC("avg_days"),
                                                                 ASC("seller_id"))


def fastest_sellers_dense_rank_top(t: T, n: int = 10, int_avg: bool = True) -> DataFrame:
    """Q15 as a report: the first n sellers with their dense rank."""
    g = _seller_delivery_days(t, int_avg)
    return top_n_ranked(g, [ASC("avg_days")], [ASC("seller_id")], n, "dense_rank") \
        .orderBy("rank", ASC("seller_id"))


# ------------------------------------------------- 3.4 logistics
def delivery_days_by_state(t: T, int_avg: bool = True) -> DataFrame:
    """Q16: average over zones of the zone view's average days, per state."""
    z = zone_profile(t, int_avg=int_avg)
    s = F.col("days_avg") if int_avg else fixed("days_avg")
    g = z.groupBy("state").agg(F.sum(s).alias("s"), F.count("days_avg").alias("c"))
    avg = int_div("s", "c") if int_avg else ratio("s", "c")
    return g.select("state", avg.alias("avg_days")).orderBy(ASC("avg_days"), ASC("state"))


def _weighted_days(j: DataFrame, keys: list[str], int_avg: bool) -> DataFrame:
    dw = F.col("days") * F.col("w")
    g = j.groupBy(*keys).agg(
        F.sum(dw).alias("s"), F.sum(F.when(F.col("days").isNotNull(), F.col("w"))).alias("c"))
    return g.select(*keys, avg_days("s", "c", int_avg).alias("avg_days"))


def delivery_days_by_category(t: T, int_avg: bool = True) -> DataFrame:
    """Q17: average days per category over order-detail rows."""
    it = items_enriched(t, seller=False).where(F.col("category").isNotNull()) \
        .select("order_id", "category")
    days = fanout_weights(t, orders=delivery_days(t).select("order_id", "days"))
    return _weighted_days(it.join(days, "order_id", "inner"), ["category"], int_avg)


def delivery_days_by_state_category(t: T, int_avg: bool = True) -> DataFrame:
    """Q18: average days per customer state and category (null kept)."""
    oc = orders_with_customer(t, "left").select(
        "order_id", "customer_state", day_diff("purchased_at", "delivered_at").alias("days"))
    it = items_enriched(t, seller=False).select("order_id", "category")
    j = fanout_weights(t, orders=oc).join(it, "order_id", "left")
    return _weighted_days(j, ["customer_state", "category"], int_avg)


def _with_dates(t: T) -> DataFrame:
    o = t["orders"].where(F.col("order_purchase_timestamp").isNotNull()
                          & F.col("order_delivered_customer_date").isNotNull()
                          & F.col("order_estimated_delivery_date").isNotNull())
    return o.select(
        "order_id", "customer_id",
        day_diff("order_purchase_timestamp", "order_delivered_customer_date").alias("days"),
        day_diff("order_purchase_timestamp", "order_estimated_delivery_date").alias("est"))


def on_time_share(t: T) -> DataFrame:
    """Q19: delivered orders on time (days <= estimated days) and late."""
    d = _with_dates(t)
    return conditional_share(d, F.col("days") <= F.col("est"), total="total_orders",
                             hits="on_time", misses="late", hit_pct="on_time_pct",
                             miss_pct="late_pct")


def _late_share_by_seller(t: T, place: str, alias: str) -> DataFrame:
    it = t["order_item"].select("order_id", "seller_id")
    s = t["sellers"].select("seller_id", F.col(place).alias(alias))
    per = (it.join(_with_dates(t), "order_id", "inner").join(s, "seller_id", "inner")
           .groupBy("order_id", alias).agg(F.min("days").alias("days"),
                                           F.min("est").alias("est")))
    out = conditional_share(per, F.col("days") > F.col("est"), by=[alias],
                            total="total_orders", hits="late", hit_pct="late_pct")
    return out.orderBy(DESC("late_pct"), ASC(alias))


def late_share_by_seller_city(t: T) -> DataFrame:
    """Q20: share of late (order, seller city) pairs per seller city."""
    return _late_share_by_seller(t, "seller_city", "city")


def late_share_by_seller_state(t: T) -> DataFrame:
    """Q21: share of late (order, seller state) pairs per seller state."""
    return _late_share_by_seller(t, "seller_state", "state")


# ------------------------------------------------- 3.5 payments
def payment_method_usage(t: T, clean: bool = False) -> DataFrame:
    """Q22: uses per payment type from the payment view."""
    g = payment_profile(t, clean=clean).groupBy("payment_type").agg(
        F.sum("times_used").cast("bigint").alias("times_used"))
    return g.orderBy(DESC("times_used"), ASC("payment_type"))


def avg_payment_by_type(t: T) -> DataFrame:
    """Q23: average payment value per type (payments of known orders)."""
    p = (t["order_payments"].where(F.col("payment_type").isNotNull()
                                   & F.col("payment_value").isNotNull())
         .join(t["orders"].select("order_id"), "order_id", "left_semi"))
    g = p.groupBy("payment_type").agg(F.sum("payment_value").alias("s"),
                                      F.count("payment_value").alias("c"))
    return g.select("payment_type", ratio("s", "c").alias("avg_value")) \
        .orderBy(DESC("avg_value"), ASC("payment_type"))


def multi_payment_share(t: T) -> DataFrame:
    """Q24: orders paid with several payment rows against a single one."""
    per = t["order_payments"].groupBy("order_id").agg(
        F.count("payment_sequential").alias("n"))
    g = per.agg(
        F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).cast("bigint").alias("multi"),
        F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).cast("bigint").alias("single"),
        F.count("n").alias("total"))
    return g.select(F.col("multi").alias("multi_payment_orders"),
                    pct("multi", "total").alias("multi_payment_pct"),
                    F.col("single").alias("single_payment_orders"),
                    pct("single", "total").alias("single_payment_pct"),
                    F.col("total").alias("total_orders"))


# ------------------------------------------------- 3.6 satisfaction
def review_score_by_state(t: T) -> DataFrame:
    """Q25: average review score per customer state."""
    oc = orders_with_customer(t, "inner").select("order_id", "customer_state")
    r = t["order_reviews"].select("order_id", "review_score")
    g = oc.join(r, "order_id", "inner").groupBy("customer_state").agg(
        F.sum("review_score").alias("s"), F.count("review_score").alias("c"))
    return g.select(F.col("customer_state").alias("state"), ratio("s", "c").alias("avg_score"))


def review_score_by_category(t: T, clean: bool = False) -> DataFrame:
    """Q26: average review score per category with a grade label.

    Faithful: items meet the product view on product, so an item counts once
    per view row of its product (R = the product's customer places); factorised
    as weight R on the product's score sum and count.  ``clean``: weight 1 and
    range grades.  Items are read once, summed by product and place, and the
    category is attached to products.
    """
    scores = t["order_reviews"].where(F.col("review_score").isNotNull()).groupBy("order_id").agg(
        F.sum("review_score").cast("bigint").alias("ss"), F.count(F.lit(1)).alias("sn"))
    it = t["order_item"].select("order_id", "product_id")
    if clean:
        rows = it.join(t["orders"].select("order_id"), "order_id", "left_semi").join(scores, "order_id", "inner")
        products = rows.groupBy("product_id").agg(F.sum("ss").alias("ss"), F.sum("sn").alias("sn"), F.lit(1).alias("R"))
    else:
        place = orders_with_customer(t, "left").select("order_id", "customer_city", "customer_state")
        rows = it.join(place, "order_id", "inner").join(scores, "order_id", "left")
        products = rows.groupBy("product_id", "customer_city", "customer_state").agg(
            F.sum("ss").alias("ss"), F.sum("sn").alias("sn")).groupBy("product_id").agg(
            F.sum("ss").alias("ss"), F.sum("sn").alias("sn"), F.count(F.lit(1)).alias("R"))
    named = products_translated(t).where(F.col("category").isNotNull())
    g = products.join(named, products["product_id"] == named["p_product_id"], "inner").groupBy("category").agg(
        F.sum(F.col("ss") * F.col("R")).alias("s"), F.sum(F.col("sn") * F.col("R")).alias("c")).where("c > 0")
    avg = ratio("s", "c")
    return g.select("category", avg.alias("avg_score"),
                    grade(avg, exact=not clean).alias("grade")) \
        .orderBy(ASC("avg_score"), ASC("category"))


def review_by_delivery_bucket(t: T, int_avg: bool = True, clean: bool = False) -> DataFrame:
    """Q27: review rows by delivery-day bucket: distinct orders, average
    days, average score; sorted by label text as in the source."""
    o = (t["orders"].join(t["customer"].select("customer_id"), "customer_id", "left_semi")
         .select("order_id", day_diff("order_purchase_timestamp",
                                      "order_delivered_customer_date").alias("days"))
         .where(F.col("days").isNotNull()))
    r = t["order_reviews"].where(F.col("review_score").isNotNull()
                                 & (F.col("review_score") > 0)).select("order_id",
                                                                       "review_score")
    j = o.join(r, "order_id", "inner").withColumn(
        "bucket", bucketize("days", invalid=INVALID_BUCKET if clean else None))
    g = j.groupBy("bucket").agg(
        F.countDistinct("order_id").alias("orders"),
        F.sum("days").alias("ds"), F.count("days").alias("dn"),
        F.sum("review_score").alias("ss"), F.count("review_score").alias("sn"))
    return g.select("bucket", "orders", avg_days("ds", "dn", int_avg).alias("avg_days"),
                    ratio("ss", "sn").alias("avg_score")).orderBy("bucket")
