"""Measures of the BI layer (K1-K22).  The source documents them only as
figures and prose; each formula here is our stated choice.

Sales = sum of item prices on the item fact (M1).  One-row results are
combined by stacking (union + one aggregate), never by joining.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.columns import day_diff, fixed, pct, ratio
from marketlens.functions.labels import NEGATIVE_SCORE
from marketlens.operators.ranking import top_n
from marketlens.operators.shares import conditional_share, period_growth, share_of_top_n
from marketlens.plans import analysis as A
from marketlens.plans.grain import reviews_per_order
from marketlens.plans.model import fact_order_items, with_calendar
from marketlens.schema import MONEY_SUM
from marketlens.session import materialize

T = dict[str, DataFrame]
ASC, DESC = F.asc_nulls_first, F.desc_nulls_last


def _stack(frames: list[DataFrame], by: list[str] | None = None) -> DataFrame:
    """Union frames carrying disjoint measure columns and fold them per key."""
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    cols = [c for c in u.columns if c not in (by or [])]
    g = u.groupBy(*by) if by else u.groupBy()
    return g.agg(*[F.max(c).alias(c) for c in cols])


def _sales_rows(t: T) -> DataFrame:
    """Item prices with the order's dates and customer."""
    o = t["orders"].select("order_id", "order_purchase_timestamp", "order_approved_at",
                           "order_delivered_customer_date")
    return fact_order_items(t).select("order_id", "customer_id", "product_id", "price") \
        .join(o, "order_id", "inner")


def _unique_first_purchase(t: T) -> DataFrame:
    """First purchase time per unique customer."""
    c = t["customer"].select("customer_id", "customer_unique_id")
    return (t["orders"].join(c, "customer_id", "inner")
            .groupBy("customer_unique_id")
            .agg(F.min("order_purchase_timestamp").alias("first_purchase")))


def kpi_summary(t: T) -> DataFrame:
    """K1: headline figures in one row.

    Items, payments, orders and customers are read once and meet at order grain;
    each order then gives a row for the whole, one for its customer and one
    per item's seller (whose sales are the order's payments, as in the seller
    view).  The rows of a kind are summed by their key, and customers on to their
    number, so what is left is a row per seller and two more.
    """
    items = t["order_item"].groupBy("order_id").agg(
        F.sum("price").alias("sales"), F.count(F.lit(1)).alias("lines"), F.collect_list("seller_id").alias("sellers"))
    pay = t["order_payments"].groupBy("order_id").agg(F.sum("payment_value").alias("paid"))
    buyer = t["customer"].select("customer_id", F.col("customer_unique_id").alias("buyer"))
    start, done, due = (F.col(f"order_{c}") for c in (
        "purchase_timestamp", "delivered_customer_date", "estimated_delivery_date"))
    j = (t["orders"].select("order_id", "customer_id", (day_diff(start, done) <= day_diff(start, due)).alias("on_time"))
         .join(items, "order_id", "left").join(pay, "order_id", "left").join(buyer, "customer_id", "left"))
    blank, sold = F.lit(None).cast("string"), F.col("lines").isNotNull()

    def row(kind, key, amount, n, dated, on_time):
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"), amount.cast(MONEY_SUM).alias("amount"),
                        n.cast("bigint").alias("n"), dated.cast("bigint").alias("dated"), on_time.cast("bigint").alias("on_time"))

    none, zero = F.lit(None), F.lit(0)
    whole = F.array(row("all", blank, F.col("sales"), sold.cast("int"), F.col("on_time").isNotNull().cast("int"),
                        F.coalesce(F.col("on_time"), F.lit(False)).cast("int")))
    buyers = F.filter(F.array(row("buyer", F.col("buyer"), none, zero, zero, zero)), lambda r: sold & F.col("buyer").isNotNull())
    sellers = F.transform(F.coalesce("sellers", F.array().cast("array<string>")),
                          lambda s: row("seller", s, F.col("paid"), zero, zero, zero))
    sums = [F.sum(c).alias(c) for c in ("amount", "n", "dated", "on_time")]
    keyed = (j.select(F.explode(F.concat(whole, buyers, sellers)).alias("r")).select("r.*")
             .groupBy("kind", "key").agg(*sums))
    known = keyed.join(t["sellers"].select(F.lit("seller").alias("kind"), F.col("seller_id").alias("key"), F.lit(True).alias("_known")),
                       ["kind", "key"], "left").where((F.col("kind") != "seller") | F.col("_known"))
    # a row per seller, one for all buyers, one for the whole
    few = materialize(known.groupBy("kind", F.when(F.col("kind") != "buyer", F.col("key")).alias("key")).agg(
        *sums, F.count(F.lit(1)).alias("keys")))
    best = share_of_top_n(few.where("kind = 'seller'"), "amount", 10, [DESC("amount"), ASC("key")]).select(
        pct("top_amount", "all_amount").alias("top10_seller_pct"))
    head = few.agg(*[F.max(F.when(F.col("kind") == "all", F.col(c))).alias(c) for c in ("amount", "n", "dated", "on_time")],
                   F.coalesce(F.max(F.when(F.col("kind") == "buyer", F.col("keys"))), F.lit(0)).alias("unique_customers"))
    head = head.select(F.col("amount").alias("total_sales"), "unique_customers", F.coalesce("n", F.lit(0)).alias("orders"),
                       ratio("amount", "n").alias("avg_ticket"), pct("on_time", "dated").alias("on_time_pct"))
    score = t["order_reviews"].agg(
        ratio(F.sum("review_score"), F.count("review_score")).alias("avg_review_score"))
    return _stack([head, score, best]).select("total_sales", "unique_customers", "orders", "avg_ticket",
                                              "on_time_pct", "avg_review_score", "top10_seller_pct")


def state_customer_share(t: T) -> DataFrame:
    """K2: unique customers per state and their share of the per-state sum."""
    g = t["customer"].groupBy(F.col("customer_state").alias("state")).agg(
        F.countDistinct("customer_unique_id").alias("customers"))
    # the total is a scalar subquery over the per-state rows (run once)
    total = g.agg(F.sum("customers")).scalar()
    return g.select("state", "customers", pct("customers", total).alias("pct"))


def new_customers_yoy(t: T) -> DataFrame:
    """K3: unique customers by year of first purchase and yearly growth."""
    y = _unique_first_purchase(t).groupBy(F.year("first_purchase").alias("year")).agg(
        F.count(F.lit(1)).alias("new_customers"))
    return period_growth(y, ["year"], "new_customers", prev="prev_customers",
                         growth="growth_pct").orderBy(ASC("year"))


def sales_by_city(t: T, n: int = 5) -> DataFrame:
    """K4: the n customer cities with most sales."""
    c = t["customer"].select("customer_id", F.col("customer_city").alias("city"))
    g = fact_order_items(t).join(c, "customer_id", "inner").groupBy("city").agg(
        F.sum("price").cast(MONEY_SUM).alias("sales"))
    return top_n(g, [DESC("sales"), ASC("city")], n)


def units_by_category(t: T) -> DataFrame:
    """K5: the five categories with most units (Q04 with n = 5)."""
    return A.top_categories_by_units(t, n=5)


def sales_by_product(t: T, n: int = 10) -> DataFrame:
    """K6: the n products with most sales."""
    g = fact_order_items(t).groupBy("product_id").agg(
        F.sum("price").cast(MONEY_SUM).alias("sales"))
    return top_n(g, [DESC("sales"), ASC("product_id")], n)


def _by_purchase(t: T, key: F.Column, name: str) -> DataFrame:
    s = _sales_rows(t)
    g = s.groupBy(key.alias(name)).agg(F.sum("price").cast(MONEY_SUM).alias("sales"),
                                       F.countDistinct("order_id").alias("orders"))
    return g.orderBy(ASC(name))


def sales_by_month(t: T) -> DataFrame:
    """K7: seasonality: sales and orders per month of the year."""
    return _by_purchase(t, F.month("order_purchase_timestamp"), "month")


def sales_by_weekday(t: T) -> DataFrame:
    """K8: sales and orders per day of week (1 = Monday)."""
    return _by_purchase(t, F.weekday("order_purchase_timestamp") + 1, "day_of_week")


def _segment(ts: str) -> F.Column:
    d = F.col(ts)
    return F.when((F.month(d) == 11) & (F.weekday(d) == 4), F.lit("november_friday")) \
        .otherwise(F.lit("other_days"))


def november_fridays(t: T) -> DataFrame:
    """K9: November Fridays against all other days: purchase days, sales,
    sales per day, new (unique) customers."""
    s = _sales_rows(t).withColumn("segment", _segment("order_purchase_timestamp"))
    sales = s.groupBy("segment").agg(F.sum("price").alias("sales"))
    days = (t["orders"].select(_segment("order_purchase_timestamp").alias("segment"),
                               F.to_date("order_purchase_timestamp").alias("d"))
            .where(F.col("d").isNotNull())
            .groupBy("segment").agg(F.countDistinct("d").alias("days")))
    new = (_unique_first_purchase(t).where(F.col("first_purchase").isNotNull())
           .groupBy(_segment("first_purchase").alias("segment"))
           .agg(F.count(F.lit(1)).alias("new_customers")))
    out = _stack([sales, days, new], by=["segment"])
    return out.select("segment", "days", F.col("sales").cast(MONEY_SUM).alias("sales"),
                      ratio("sales", "days").alias("sales_per_day"),
                      F.coalesce("new_customers", F.lit(0)).cast("bigint")
                      .alias("new_customers"))


def delivery_days_overall(t: T) -> DataFrame:
    """Average delivery days over delivered orders and the average of
    the ten fastest sellers' averages (fractional, Q14 exact)."""
    o = t["orders"].select(day_diff("order_purchase_timestamp",
                                    "order_delivered_customer_date").alias("days"))
    overall = o.agg(ratio(F.sum("days"), F.count("days")).alias("overall_avg_days"))
    best = A.fastest_sellers_row_number(t, n=10, int_avg=False).agg(
        ratio(F.sum(fixed("avg_days")), F.count("avg_days")).alias("best10_avg_days"))
    return _stack([overall, best])


def _state_days(t: T) -> DataFrame:
    c = t["customer"].select("customer_id", F.col("customer_state").alias("state"))
    o = t["orders"].select("customer_id", day_diff("order_purchase_timestamp",
                                                   "order_delivered_customer_date")
                           .alias("days")).where(F.col("days").isNotNull())
    return o.join(c, "customer_id", "inner").groupBy("state").agg(
        ratio(F.sum("days"), F.count("days")).alias("avg_days"))


def delivery_days_extremes(t: T) -> DataFrame:
    """Customer states with the lowest and the highest average days."""
    s = _state_days(t)
    lo = top_n(s, [ASC("avg_days"), ASC("state")], 1).select(
        F.col("state").alias("fastest_state"), F.col("avg_days").alias("fastest_days"))
    hi = top_n(s, [DESC("avg_days"), ASC("state")], 1).select(
        F.col("state").alias("slowest_state"), F.col("avg_days").alias("slowest_days"))
    return _stack([lo, hi]).select("fastest_state", "fastest_days", "slowest_state",
                                   "slowest_days")


def late_share_by_customer_state(t: T) -> DataFrame:
    """Share of late delivered orders per customer state."""
    c = t["customer"].select("customer_id", F.col("customer_state").alias("state"))
    d = A._with_dates(t).join(c, "customer_id", "inner")
    return conditional_share(d, F.col("days") > F.col("est"), by=["state"],
                             total="total_orders", hits="late", hit_pct="late_pct") \
        .orderBy(DESC("late_pct"), ASC("state"))


def negative_reviews_by_status(t: T) -> DataFrame:
    """Reviews with a score <= 2 per order status: count and share."""
    r = t["order_reviews"].where(F.col("review_score").isNotNull()).select(
        "order_id", "review_score")
    j = r.join(t["orders"].select("order_id", "order_status"), "order_id", "inner")
    return conditional_share(j, F.col("review_score") <= NEGATIVE_SCORE, by=["order_status"],
                             total="reviews", hits="negative", hit_pct="negative_pct") \
        .orderBy(DESC("negative_pct"), ASC("order_status"))


def state_delivery_vs_score(t: T) -> DataFrame:
    """Per customer state: average delivery days and average score, from
    one row per order: its days, and the sum and count of its scores."""
    c = t["customer"].select("customer_id", F.col("customer_state").alias("state"))
    o = t["orders"].select("order_id", "customer_id", day_diff(
        "order_purchase_timestamp", "order_delivered_customer_date").alias("days"))
    j = (o.join(reviews_per_order(t), "order_id", "left").where("days is not null or nr is not null")
         .join(c, "customer_id", "inner"))
    return j.groupBy("state").agg(ratio(F.sum("days"), F.count("days")).alias("avg_days"),
                                  ratio(F.sum("score_sum"), F.sum("score_cnt")).alias("avg_score"))


def five_star_share(t: T) -> DataFrame:
    """% of scores equal to 5, and average score of delivered orders."""
    r = t["order_reviews"].where(F.col("review_score").isNotNull())
    share = r.agg(pct(F.sum((F.col("review_score") == 5).cast("int")), F.count(F.lit(1)))
                  .alias("five_star_pct"))
    d = r.join(t["orders"].where(F.col("order_status") == "delivered").select("order_id"),
               "order_id", "left_semi")
    dav = d.agg(ratio(F.sum("review_score"), F.count("review_score"))
                .alias("delivered_avg_score"))
    return _stack([share, dav])


def sales_ytd_mtd(t: T) -> DataFrame:
    """Daily sales with running year-to-date and month-to-date sums.

    Daily totals first (one row per day), then running windows partitioned
    by year / month: a partition holds at most 366 rows.
    """
    s = _sales_rows(t).groupBy(F.to_date("order_purchase_timestamp").alias("date")).agg(
        F.sum("price").alias("sales")).where(F.col("date").isNotNull())
    upto = Window.unboundedPreceding, Window.currentRow
    ytd = Window.partitionBy(F.year("date")).orderBy("date").rowsBetween(*upto)
    mtd = Window.partitionBy(F.year("date"), F.month("date")).orderBy("date").rowsBetween(*upto)
    return s.select("date", F.col("sales").cast(MONEY_SUM).alias("sales"),
                    F.sum("sales").over(ytd).cast(MONEY_SUM).alias("sales_ytd"),
                    F.sum("sales").over(mtd).cast(MONEY_SUM).alias("sales_mtd"))


def sales_yoy(t: T) -> DataFrame:
    """Monthly sales against the same month one year earlier: a range
    frame over the year of each calendar month, so a month without sales
    leaves a gap and never shifts the comparison."""
    ts = "order_purchase_timestamp"
    m = _sales_rows(t).where(F.col(ts).isNotNull()).groupBy(
        F.year(ts).alias("year"), F.month(ts).alias("month")).agg(
        F.sum("price").alias("sales"))
    year_before = Window.partitionBy("month").orderBy("year").rangeBetween(-1, -1)
    j = m.withColumn("prev_year_sales", F.sum("sales").over(year_before))
    return j.select("year", "month", F.col("sales").cast(MONEY_SUM).alias("sales"),
                    F.col("prev_year_sales").cast(MONEY_SUM).alias("prev_year_sales"),
                    ratio(F.col("sales") - F.col("prev_year_sales"), "prev_year_sales", 100.0)
                    .alias("yoy_pct")).orderBy("year", "month")


def sales_by_role(t: T, role: str = "purchase") -> DataFrame:
    """Monthly sales through the active (purchase) or an inactive
    (delivered, approved) calendar relation.  Sales without a calendar day are
    the blank (null) month, so the months add up to all sales."""
    j = with_calendar(t, _sales_rows(t), role)
    return j.groupBy("year_month").agg(F.sum("price").cast(MONEY_SUM).alias("sales")) \
        .orderBy("year_month")


QUERIES = {
    "kpi_summary": kpi_summary,
    "state_customer_share": state_customer_share,
    "new_customers_yoy": new_customers_yoy,
    "sales_by_city": sales_by_city,
    "units_by_category": units_by_category,
    "sales_by_product": sales_by_product,
    "sales_by_month": sales_by_month,
    "sales_by_weekday": sales_by_weekday,
    "november_fridays": november_fridays,
    "seller_ranking": A.seller_order_rank_view,
    "seller_concentration": A.top10_seller_concentration,
    "delivery_days_overall": delivery_days_overall,
    "delivery_days_extremes": delivery_days_extremes,
    "late_share_by_customer_state": late_share_by_customer_state,
    "avg_ticket_by_payment": A.avg_payment_by_type,
    "single_vs_multi": A.multi_payment_share,
    "negative_reviews_by_status": negative_reviews_by_status,
    "state_delivery_vs_score": state_delivery_vs_score,
    "five_star_share": five_star_share,
    "sales_ytd_mtd": sales_ytd_mtd,
    "sales_yoy": sales_yoy,
    "sales_by_purchase_month": partial(sales_by_role, role="purchase"),
    "sales_by_delivery_month": partial(sales_by_role, role="delivered"),
    "sales_by_approval_month": partial(sales_by_role, role="approved"),
}
