"""The six analytical views (W1-W6), their inner CTEs and sample queries.

Faithful by default: each view reproduces the source SQL, join fan-out
included.  Sums that the source takes over an items x payments x reviews
product are computed *factorised* (per-order aggregates times the row counts
of the other sides, see ``grain``): identical numbers, no materialised
product.  ``*_clean`` variants compute what the source comments promise.

Output names are English; column order follows the source views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.columns import (at_least_one, avg_days, day_diff, fixed,
                                          ratio)
from marketlens.operators.ranking import top_n, top_n_per_group
from marketlens.plans.grain import (items_enriched, per_order_items,
                                    orders_with_customer, payments_per_order,
                                    reviews_per_order)
from marketlens.schema import FREIGHT_SUM, MONEY_SUM

T = dict[str, DataFrame]


def _money(c):
    return (F.col(c) if isinstance(c, str) else c).cast(MONEY_SUM)


def _freight(c):
    return (F.col(c) if isinstance(c, str) else c).cast(FREIGHT_SUM)


# --------------------------------------------------------------------- W1
W1_COLUMNS = [
    "order_id", "order_status", "purchased_at", "approved_at", "handed_to_carrier_at",
    "estimated_delivery_at", "ship_limit_at", "delivered_at", "product_id", "category",
    "order_item_id", "review_score", "payment_type", "payment_value", "price",
    "freight_value", "customer_id", "customer_zip", "customer_city", "customer_state",
    "seller_id", "seller_zip", "seller_city", "seller_state"]


def orders_detail(t: T) -> DataFrame:
    """One row per order x item x payment x review (left joins).

    Dimensions are attached at their own grain first (customer to orders,
    product / category / seller to items); the per-order product is formed
    by the last three joins, all on ``order_id`` and so on one partitioning.
    """
    oc = orders_with_customer(t, "left")
    it = items_enriched(t).drop("item_product_id", "item_seller_id")
    pay = t["order_payments"].select("order_id", "payment_type", "payment_value")
    rev = t["order_reviews"].select("order_id", "review_score")
    j = (oc.join(it, "order_id", "left").join(pay, "order_id", "left")
         .join(rev, "order_id", "left"))
    return j.select(*W1_COLUMNS)


# --------------------------------------------------------------------- W2
def customer_base(t: T) -> DataFrame:
    """W2 CTE: the unaggregated rows under the customer view, one per order x
    item x payment x review of a known customer.  ``customer_profile`` gives the
    sums over these rows without forming them."""
    c = t["customer"].select("customer_id", F.col("customer_zip_code_prefix").alias("customer_zip"),
                             "customer_city", "customer_state")
    j = t["orders"].select("order_id", "customer_id").join(c, "customer_id", "inner")
    for name, cols in (("order_item", ["order_item_id", "freight_value"]), ("order_payments", ["payment_value"]),
                       ("order_reviews", ["review_score"])):
        j = j.join(t[name].select("order_id", *cols), "order_id", "left")
    return j.select("customer_id", "customer_zip", "customer_city", "customer_state", "order_item_id",
                    "payment_value", "freight_value", "review_score")


def customer_profile(t: T, clean: bool = False) -> DataFrame:
    """Per customer with orders: review count, distinct line positions
    bought, spend, freight and ratios.

    Faithful sums run over the item x payment x review rows of each order
    (payments counted once per item and review, ...); ``clean`` counts each
    payment, freight and review once and ``items_bought`` counts item rows.
    """
    o = t["orders"].select("order_id", "customer_id")
    items = per_order_items(t, F.sort_array(F.collect_set("order_item_id")).alias("positions"))
    per_order = (o.join(items, "order_id", "left")
                 .join(payments_per_order(t), "order_id", "left")
                 .join(reviews_per_order(t), "order_id", "left"))
    mi, mp, mr = at_least_one("ni"), at_least_one("np"), at_least_one("nr")
    nrv = F.coalesce(F.col("score_cnt"), F.lit(0))
    if clean:
        spent, freight, reviews = F.col("pay_sum"), F.col("freight_sum"), nrv
    else:
        spent = F.col("pay_sum") * mi * mr
        freight = F.col("freight_sum") * mp * mr
        reviews = nrv * mi * mp
    # orders have few different sets of positions, so the customer's are few too
    bought = (F.sum(F.coalesce(F.col("ni"), F.lit(0))) if clean else
              F.size(F.array_distinct(F.flatten(F.collect_set("positions")))))
    aggs = [F.sum(spent).alias("total_spent"), F.sum(freight).alias("total_freight"),
            F.sum(reviews).cast("bigint").alias("review_count"), bought.cast("bigint").alias("items_bought")]
    per_customer = per_order.groupBy("customer_id").agg(*aggs)
    c = t["customer"].select("customer_id",
                             F.col("customer_zip_code_prefix").alias("customer_zip"),
                             "customer_city", "customer_state")
    j = c.join(per_customer, "customer_id", "inner")
    return j.select(
        "customer_id", "customer_zip", "customer_city", "customer_state",
        "review_count", "items_bought",
        ratio("total_spent", "items_bought").alias("avg_ticket_per_item"),
        _money("total_spent").alias("total_spent"),
        _freight("total_freight").alias("total_freight"),
        ratio("total_freight", "total_spent", 100.0).alias("freight_pct"))


def customer_profile_all(t: T) -> DataFrame:
    """W2s: every row of the customer view."""
    return customer_profile(t)


# --------------------------------------------------------------------- W3
def items_per_seller(t: T) -> DataFrame:
    """W3 CTE: items of known sellers in known orders, with customer place."""
    s = t["sellers"].select("seller_id", F.col("seller_zip_code_prefix").alias("seller_zip"),
                            "seller_city", "seller_state")
    oi = t["order_item"].select("seller_id", "order_id", "order_item_id")
    oc = orders_with_customer(t, "left").select("order_id", "customer_id",
                                                "customer_city", "customer_state")
    return s.join(oi, "seller_id", "inner").join(oc, "order_id", "inner")


def _review_avg():
    return ratio("score_sum", "score_cnt")


def seller_profile(t: T, clean: bool = False) -> DataFrame:
    """Per seller: distinct orders / positions / customers / cities /
    states, sales, ticket, reviews.

    Faithful: the order's payment total and review count are added once per
    *item row* of the seller (the source's pre-aggregation does not prevent
    that), and units are distinct line positions.  ``clean`` takes each
    (seller, order) once and counts item rows as units.

    Plan: item rows are dealt out once by seller and customer city, narrow, and
    lie there by state and customer.  A row that differs from the one before
    begins a city or customer, so these are counted without a copy of the rows
    for each; a seller's (order, customer place) is marked before, where items
    lie by order.  The few states and positions go on as sets.  The seller id is
    the seller table's key, so the place is attached after aggregating.
    """
    pay = payments_per_order(t).select("order_id", "pay_sum")
    rev = reviews_per_order(t).select("order_id", "score_cnt",
                                      _review_avg().alias("avg_score"))
    s = t["sellers"].select("seller_id", F.col("seller_zip_code_prefix").alias("seller_zip"),
                            "seller_city", "seller_state")
    oi = t["order_item"].select("seller_id", "order_id", *([] if clean else ["order_item_id"]))
    # a customer of several places is counted in the first one only
    places = Window.partitionBy("c_customer_id").orderBy("customer_city", "customer_state")
    c = t["customer"].where("customer_id is not null").select(
        F.col("customer_id").alias("c_customer_id"), "customer_city", "customer_state").withColumn(
        "counts", F.rank().over(places) == 1)
    o = t["orders"].select("order_id", "customer_id")
    oc = o.join(c, o["customer_id"] == c["c_customer_id"], "left").drop("customer_id")
    # unknown sellers leave with the join of the place below
    each = Window.partitionBy("order_id", "seller_id", "c_customer_id", "customer_city", "customer_state")
    j = (oi.join(oc, "order_id", "inner").withColumn("new_order", F.row_number().over(each.orderBy("order_id")) == 1)
         .join(pay, "order_id", "left").join(rev, "order_id", "left"))
    lies = Window.partitionBy("seller_id", "customer_city").orderBy("customer_state", "c_customer_id")
    j = j.withColumn("before", F.lag(F.struct("customer_state", "c_customer_id")).over(lies))
    new_city = F.col("before").isNull()
    new_customer = new_city | ~F.col("before").eqNullSafe(F.struct("customer_state", "c_customer_id"))

    def once(col):
        return F.when(F.col("new_order"), F.col(col)) if clean else F.col(col)

    g = j.groupBy("seller_id").agg(
        F.count_if("new_order").alias("order_count"),
        (F.count(F.lit(1)) if clean else F.size(F.collect_set("order_item_id"))).cast("bigint").alias("unit_count"),
        F.count_if(new_customer & F.col("counts")).alias("customer_count"),
        F.count_if(new_city & F.col("customer_city").isNotNull()).alias("city_count"),
        F.size(F.collect_set("customer_state")).cast("bigint").alias("state_count"),
        F.sum(once("pay_sum")).alias("total_sales"), F.sum(once("score_cnt")).cast("bigint").alias("review_total"),
        # a score's average has one digit before the point
        F.sum(once("avg_score").cast("decimal(12,9)")).alias("_rs"), F.count(once("avg_score")).alias("_rn"))
    out = s.join(g, "seller_id", "inner")
    return out.select(
        "seller_id", "seller_zip", "seller_city", "seller_state",
        "order_count", "unit_count",
        "customer_count", "city_count", "state_count",
        _money("total_sales").alias("total_sales"),
        ratio("total_sales", "order_count").alias("avg_ticket"),
        ratio("customer_count", "city_count").alias("customers_per_city"),
        "review_total", ratio("_rs", "_rn").alias("avg_review"))


# --------------------------------------------------------------------- W4
def unique_items(t: T) -> DataFrame:
    """W4 CTE: distinct (order, position, product, category, price, place).

    Items are enriched at item grain and joined to orders on order_id; the
    DISTINCT includes order_id, so it reuses that join's partitioning.
    """
    oc = orders_with_customer(t, "left").select("order_id", "customer_city", "customer_state")
    it = items_enriched(t, seller=False).select("order_id", "order_item_id",
                                                F.col("item_product_id").alias("product_id"),
                                                "category", "price")
    return (oc.join(it, "order_id", "left")
            .select("order_id", "order_item_id", "product_id", "category", "price",
                    "customer_city", "customer_state").distinct())


def product_profile(t: T) -> DataFrame:
    """Per product x category x customer place: price range and average,
    sales, distinct orders, rows (an order without items counts one row in
    the null-product group, as in the source)."""
    g = unique_items(t).groupBy("product_id", "category", "customer_city",
                                "customer_state").agg(
        F.min("price").alias("price_min"), F.max("price").alias("price_max"),
        F.sum("price").alias("_sum"), F.count("price").alias("_cnt"),
        F.countDistinct("order_id").alias("order_count"),
        F.count(F.lit(1)).alias("unit_count"))
    return g.select(
        "product_id", "category", F.col("customer_state").alias("state"),
        F.col("customer_city").alias("city"), "price_min", "price_max",
        ratio("_sum", "_cnt").alias("price_avg"), _money("_sum").alias("sales_total"),
        "order_count", "unit_count")


def top_product_rows(t: T, n: int = 10) -> DataFrame:
    """W4s: top ``n`` product-view rows by sales (ties: product, city, state)."""
    return top_n(product_profile(t),
                 [F.desc_nulls_last("sales_total"), F.asc_nulls_first("product_id"),
                  F.asc_nulls_first("state"), F.asc_nulls_first("city"),
                  F.asc_nulls_first("category")], n)


# --------------------------------------------------------------------- W5
def payment_rows(t: T) -> DataFrame:
    """W5 CTE: the unaggregated rows under the payment view, one per payment x
    item of an order with a known customer."""
    place = orders_with_customer(t, "inner").select("order_id", "customer_state", "customer_city")
    pay = t["order_payments"].select("order_id", "payment_type", "payment_value")
    return (place.join(pay, "order_id", "inner")
            .join(t["order_item"].select("order_id", "order_item_id"), "order_id", "inner")
            .select("order_id", "order_item_id", "payment_type", "payment_value", "customer_state", "customer_city"))


def payment_profile(t: T, clean: bool = False) -> DataFrame:
    """Per payment type x customer state x city: distinct orders, uses,
    amount.  Inner joins: orders need a customer, a payment and an item.

    Faithful: each payment row is repeated once per item of its order;
    ``clean`` counts it once.
    """
    oc = orders_with_customer(t, "inner").select("order_id", "customer_state",
                                                 "customer_city")
    ni = t["order_item"].groupBy("order_id").agg(F.count(F.lit(1)).alias("ni"))
    pt = t["order_payments"].groupBy("order_id", "payment_type").agg(
        F.count(F.lit(1)).alias("np_t"), F.sum("payment_value").alias("pay_t"))
    j = pt.join(ni, "order_id", "inner").join(oc, "order_id", "inner")
    k = F.lit(1) if clean else F.col("ni")
    g = j.groupBy("payment_type", "customer_state", "customer_city").agg(
        F.count(F.lit(1)).alias("order_count"),
        F.sum(F.col("np_t") * k).cast("bigint").alias("times_used"),
        F.sum(F.col("pay_t") * k).alias("total_paid"))
    return g.select("payment_type", "customer_state", "customer_city", "order_count",
                    "times_used", _money("total_paid").alias("total_paid"))


def top_city_by_payment(t: T) -> DataFrame:
    """W5s: per payment type the city with the highest amount paid.

    Row-number filter per type: planned as a WindowGroupLimit, so each type
    ships one candidate row per map partition (ties: city, state)."""
    w5 = payment_profile(t).groupBy("payment_type", "customer_city", "customer_state").agg(
        F.sum("total_paid").alias("total_paid"),
        F.sum("order_count").cast("bigint").alias("order_count"))
    best = top_n_per_group(w5, ["payment_type"],
                           [F.desc_nulls_last("total_paid"), F.asc_nulls_first("customer_city"),
                            F.asc_nulls_first("customer_state")], 1)
    return best.select("payment_type", F.col("customer_city").alias("top_city"),
                       "customer_state", "order_count",
                       _money("total_paid").alias("total_paid")) \
        .orderBy(F.desc_nulls_last("total_paid"))


# --------------------------------------------------------------------- W6
def unique_zips(t: T) -> DataFrame:
    """W6 CTE: distinct (zip, city, state) of the geolocation table."""
    return t["geolocation"].select(
        F.col("geolocation_zip_code_prefix").alias("zip"),
        F.col("geolocation_city").alias("city"),
        F.col("geolocation_state").alias("state")).distinct()


def _delivered_orders_base(t: T) -> DataFrame:
    o = t["orders"]
    days = day_diff("order_purchase_timestamp", "order_delivered_customer_date")
    o = (o.where(F.col("order_delivered_customer_date").isNotNull()
                 & F.col("order_purchase_timestamp").isNotNull() & (days >= 0))
         .select("order_id", "customer_id", days.alias("days")))
    c = t["customer"].select("customer_id", F.col("customer_zip_code_prefix").alias("zip"))
    return o.join(c, "customer_id", "inner")


def delivered_orders(t: T) -> DataFrame:
    """W6 CTE: delivered orders consolidated per (order, zip, customer,
    seller) over their payment x item x review rows (factorised)."""
    pay = payments_per_order(t).select("order_id", "np", "pay_sum")
    its = t["order_item"].groupBy("order_id", "seller_id").agg(
        F.count(F.lit(1)).alias("ni_s"), F.count("order_item_id").alias("nid_s"),
        F.sum("freight_value").alias("fsum_s"), F.count("freight_value").alias("fcnt_s"),
        F.min("freight_value").alias("fmin_s"), F.max("freight_value").alias("fmax_s"))
    rev = reviews_per_order(t)
    j = (_delivered_orders_base(t).join(pay, "order_id", "inner")
         .join(its, "order_id", "inner").join(rev, "order_id", "left"))
    mr = at_least_one("nr")
    k_freight = F.col("np") * mr
    return j.select(
        "order_id", "zip", "customer_id", "seller_id", "days",
        (F.col("pay_sum") * F.col("ni_s") * mr).alias("order_paid"),
        ratio("score_sum", "score_cnt").alias("order_review"),
        ratio(F.col("fsum_s") * k_freight, F.col("fcnt_s") * k_freight).alias("freight_avg"),
        F.col("fmin_s").alias("freight_min"), F.col("fmax_s").alias("freight_max"),
        (F.col("nid_s") * F.col("np") * mr).alias("order_items"))


def zone_profile(t: T, int_avg: bool = True) -> DataFrame:
    """Per (state, city, zip) of the geolocation table: customers,
    sellers, orders, amounts, items, review, delivery days and freight of
    delivered orders.  Zips without delivered orders stay with zero counts.

    Aggregated per zip *before* the join to the zones (every spelling of a
    zip carries the same orders), so the join is zip-grain on both sides and
    a hot zip never becomes a hot join key.
    """
    d = delivered_orders(t)
    per_zip = d.groupBy("zip").agg(
        F.countDistinct("customer_id").alias("customer_count"),
        F.countDistinct("seller_id").alias("seller_count"),
        F.sum("order_paid").alias("total_paid"),
        F.count("order_paid").alias("_paid_n"),
        F.countDistinct("order_id").alias("order_count"),
        F.sum("order_items").cast("bigint").alias("items_sold"),
        F.sum(fixed("order_review")).alias("_rs"), F.count("order_review").alias("_rn"),
        F.min("days").alias("days_min"), F.max("days").alias("days_max"),
        F.sum("days").cast("bigint").alias("_days_sum"), F.count("days").alias("_days_n"),
        F.min("freight_min").alias("freight_min"), F.max("freight_max").alias("freight_max"),
        F.sum(fixed("freight_avg")).alias("_fs"), F.count("freight_avg").alias("_fn"))
    j = unique_zips(t).join(per_zip, "zip", "left")
    zero = F.lit(0).cast("bigint")
    return j.select(
        "state", "city", "zip",
        F.coalesce("customer_count", zero).alias("customer_count"),
        F.coalesce("seller_count", zero).alias("seller_count"),
        _money("total_paid").alias("total_paid"),
        ratio("total_paid", "_paid_n").alias("avg_paid"),
        F.coalesce("order_count", zero).alias("order_count"),
        "items_sold", ratio("_rs", "_rn").alias("avg_review"),
        "days_min", "days_max",
        avg_days("_days_sum", "_days_n", int_avg).alias("days_avg"),
        "freight_min", "freight_max", ratio("_fs", "_fn").alias("freight_avg"))


def zone_profile_clean(t: T) -> DataFrame:
    """W6 clean: one (city, state) per zip (smallest pair) and every
    delivered order counted once: amount once, items = item rows, review and
    freight averaged over the order's own rows, days averaged as a double."""
    its = t["order_item"].groupBy("order_id").agg(
        F.count(F.lit(1)).alias("ni"), F.sum("freight_value").alias("freight_sum"),
        F.count("freight_value").alias("freight_cnt"), F.min("freight_value").alias("fmin"),
        F.max("freight_value").alias("fmax"), F.collect_set("seller_id").alias("sellers"))
    orders = (_delivered_orders_base(t).join(payments_per_order(t).select("order_id", "pay_sum"), "order_id", "inner")
              .join(its, "order_id", "inner").join(reviews_per_order(t), "order_id", "left"))
    # an order's sellers are few; the zip's distinct ones come from the same rows, the order's figures on the first
    rows = orders.select("*", F.posexplode_outer("sellers").alias("at", "seller_id"))
    first = F.coalesce(F.col("at"), F.lit(0)) == 0

    def once(c):
        return F.when(first, c)

    score = ratio("score_sum", "score_cnt")
    per_zip = rows.groupBy("zip").agg(
        F.countDistinct("customer_id").alias("customer_count"),
        F.countDistinct("seller_id").alias("seller_count"),
        F.sum(once(F.col("pay_sum"))).alias("total_paid"), F.count(once(F.col("pay_sum"))).alias("_paid_n"),
        F.count_if(first).alias("order_count"),
        F.sum(once(F.col("ni"))).cast("bigint").alias("items_sold"),
        F.sum(once(fixed(score))).alias("_rs"), F.count(once(score)).alias("_rn"),
        F.min("days").alias("days_min"), F.max("days").alias("days_max"),
        F.sum(once(F.col("days"))).cast("bigint").alias("_days_sum"), F.count(once(F.col("days"))).alias("_days_n"),
        F.min("fmin").alias("freight_min"), F.max("fmax").alias("freight_max"),
        F.sum(once(F.col("freight_sum"))).alias("_fsum"), F.sum(once(F.col("freight_cnt"))).alias("_fcnt"))
    zones = (unique_zips(t).groupBy("zip")
             .agg(F.min(F.struct("city", "state")).alias("_z"))
             .select("zip", F.col("_z.city").alias("city"), F.col("_z.state").alias("state")))
    j = zones.join(per_zip, "zip", "left")
    zero = F.lit(0).cast("bigint")
    return j.select(
        "state", "city", "zip",
        F.coalesce("customer_count", zero).alias("customer_count"),
        F.coalesce("seller_count", zero).alias("seller_count"),
        _money("total_paid").alias("total_paid"),
        ratio("total_paid", "_paid_n").alias("avg_paid"),
        F.coalesce("order_count", zero).alias("order_count"),
        "items_sold", ratio("_rs", "_rn").alias("avg_review"),
        "days_min", "days_max", ratio("_days_sum", "_days_n").alias("days_avg"),
        "freight_min", "freight_max", ratio("_fsum", "_fcnt").alias("freight_avg"))


def top_zones(t: T, n: int = 5) -> DataFrame:
    """W6s: top ``n`` zones by amount paid (ties: zip, city, state)."""
    return top_n(zone_profile(t), [F.desc_nulls_last("total_paid"), F.asc_nulls_first("zip"),
                                   F.asc_nulls_first("city"), F.asc_nulls_first("state")], n)


VIEW_NAMES = {
    "orders_detail": orders_detail, "customer_profile": customer_profile,
    "seller_profile": seller_profile, "product_profile": product_profile,
    "payment_profile": payment_profile, "zone_profile": zone_profile,
}


def publish_views(t: T, prefix: str = "") -> list[str]:
    """Create or replace the six views as session views, so that SQL
    users can query them by name (``spark.sql("select ... from zone_profile")``).
    Views stay unmaterialised plans, as in the source."""
    names = []
    for name, fn in VIEW_NAMES.items():
        fn(t).createOrReplaceTempView(prefix + name)
        names.append(prefix + name)
    return names


__all__ = [
    "publish_views", "VIEW_NAMES", "customer_base", "payment_rows",
    "orders_detail", "customer_profile", "customer_profile_all", "items_per_seller",
    "seller_profile", "unique_items", "product_profile", "top_product_rows",
    "payment_profile", "top_city_by_payment", "unique_zips", "delivered_orders",
    "zone_profile", "zone_profile_clean", "top_zones", "W1_COLUMNS",
]
