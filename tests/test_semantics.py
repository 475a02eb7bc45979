"""Trap-by-trap expectations on the hand-made tables (values worked out by
hand from the source definitions)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marketlens.plans import analysis as A
from marketlens.plans import model as M
from marketlens.plans import validation as V
from marketlens.plans import views as W
from marketlens.plans.grain import delivery_days


def _rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_midnight_crossing_counts_one_day(handmade):
    t, _ = handmade
    d = {r["order_id"]: r["days"] for r in delivery_days(t).collect()}
    assert d["o1"] == 1          # 23:59 -> 00:01 next day
    assert d["o8"] == 1          # 23:00 -> 01:00 next day
    assert d["o4"] == -1         # delivered before purchase
    assert d["o3"] is None


def test_orphan_and_foreign_keys(handmade):
    t, _ = handmade
    assert _rows(V.orphan_orders(t), "order_id") == [("o7",)]
    assert _rows(V.fk_check(t, "orders_customer"), "value", "n") == [("c9", 1)]
    assert _rows(V.fk_check(t, "item_product"), "value") == [("p9",)]
    assert _rows(V.fk_check(t, "products_category"), "value") == [("untranslated",)]
    assert _rows(V.fk_check(t, "customer_zip"), "value") == [("09999",)]


def test_orphan_orders_not_in_is_null_aware(spark, handmade):
    t, _ = handmade
    from pyspark.sql.types import StructField, StructType
    loose = StructType([StructField(f.name, f.dataType, True) for f in t["customer"].schema])
    with_null = t["customer"].unionByName(
        spark.createDataFrame([(None, "u0", "00000", "z", "ZZ")], loose))
    assert V.orphan_orders({**t, "customer": with_null}).count() == 0
    empty = t["customer"].limit(0)
    assert V.orphan_orders({**t, "customer": empty}).count() == t["orders"].count()


def test_null_seller_audit(handmade):
    t, _ = handmade
    # o5 has no items, o6 has an item of an unknown seller
    assert _rows(V.null_seller_audit(t), "seller_id", "orders", "rank") == [(None, 2, 1)]


def test_detail_row_count_is_the_fanout(handmade):
    t, _ = handmade
    # per order m(ni) * m(np) * m(nr): 3*2*2 + 1*1*1 + 1*1*1 + 1*1*1 + 1*1*1
    #                                 + 3*2*2 + 1*1*1 + 1*1*1
    expected = 12 + 1 + 1 + 1 + 1 + 12 + 1 + 1
    assert W.orders_detail(t).count() == expected
    assert M.null_report(t).first()["rows"] == expected


def test_faithful_sums_dominate_clean(handmade):
    t, _ = handmade
    f = {r["customer_id"]: r for r in W.customer_profile(t).collect()}
    c = {r["customer_id"]: r for r in W.customer_profile(t, clean=True).collect()}
    assert set(f) == set(c) == {"c1", "c2", "c3", "c5"}
    for k in f:
        if c[k]["total_spent"] is not None:
            assert f[k]["total_spent"] >= c[k]["total_spent"]
    # c1: o1 pays 250 once per item (3) and review (2) -> 1500, o2 pays 33
    assert str(f["c1"]["total_spent"]) == "1533.00"
    assert str(c["c1"]["total_spent"]) == "283.00"


def test_zone_with_two_spellings_counts_twice(handmade):
    t, _ = handmade
    z = W.zone_profile(t).where(F.col("zip") == "01001").collect()
    assert sorted(r["city"] for r in z) == ["SAO PAULO", "sao paulo"]
    assert all(r["order_count"] == 3 for r in z)       # o1, o2, o8 delivered to 01001
    clean = W.zone_profile_clean(t).where(F.col("zip") == "01001").collect()
    assert [r["city"] for r in clean] == ["SAO PAULO"]  # smallest (city, state)
    empty = W.zone_profile(t).where(F.col("zip") == "03003").first()
    assert empty["order_count"] == 0 and empty["total_paid"] is None


def test_on_time_invariants(handmade):
    t, _ = handmade
    r = A.on_time_share(t).first()
    assert r["on_time"] + r["late"] == r["total_orders"]
    assert abs(r["on_time_pct"] + r["late_pct"] - 100.0) < 1e-9


def test_top10_share_sums_to_100(t001):
    r = A.top10_category_share(t001).first()
    assert abs(r["top10_pct"] + r["rest_pct"] - 100.0) < 1e-9
    s = A.top10_category_share_subquery(t001).first()
    assert s["top10_pct"] == r["rest_pct"] and s["rest_pct"] == r["top10_pct"]


def test_delivery_buckets(handmade):
    t, _ = handmade
    b = {r["bucket"]: r for r in A.review_by_delivery_bucket(t).collect()}
    assert b["30+ days"]["orders"] == 1            # o6, 44 days
    assert b["0-5 days"]["orders"] == 2            # o1, o8
    assert b["11-20 days"]["orders"] == 1          # o2
    labels = [r["bucket"] for r in A.review_by_delivery_bucket(t).collect()]
    assert labels == sorted(labels)                # text order, as the source


def test_grades_exact_vs_ranges(handmade):
    t, _ = handmade
    faithful = {r["category"]: r for r in A.review_score_by_category(t).collect()}
    clean = {r["category"]: r for r in A.review_score_by_category(t, clean=True).collect()}
    assert set(faithful) <= {"bed", "beauty"}
    for r in faithful.values():
        exact = r["avg_score"] in (5.0, 4.0, 3.0, 2.0)
        assert (r["grade"] != "poor") == exact
    for r in clean.values():
        assert r["grade"] in {"excellent", "very_good", "good", "fair", "poor"}


def test_calendar_week_of_month(spark, handmade):
    t, _ = handmade
    cal = {r["date"].isoformat(): r for r in M.calendar(t).collect()}
    assert [cal[d]["week_of_month"] for d in
            ("2016-11-01", "2016-11-06", "2016-11-07", "2016-11-30")] == [1, 1, 2, 5]
    first = min(cal)
    assert first == "2016-10-04" and max(cal) == "2018-11-02"
    assert cal["2018-11-02"]["day_short"] == "Fri" and cal["2018-11-02"]["day_of_week"] == 5


def test_november_fridays(handmade):
    t, _ = handmade
    seg = {r["segment"]: r for r in __import__("marketlens.plans.kpi", fromlist=["x"])
           .november_fridays(t).collect()}
    assert seg["november_friday"]["days"] == 1
    assert str(seg["november_friday"]["sales"]) == "250.00"


def test_publish_views(spark, handmade):
    t, _ = handmade
    names = W.publish_views(t, prefix="hm_")
    assert len(names) == 6
    n = spark.sql("select count(*) from hm_orders_detail").first()[0]
    assert n == W.orders_detail(t).count()
    z = spark.sql("select sum(order_count) from hm_zone_profile where zip = '02002'").first()[0]
    assert z == 0     # o4 was delivered before purchase: excluded by days >= 0


def test_clean_payment_view_keeps_every_payment_once(handmade):
    t, _ = handmade
    clean = W.payment_profile(t, clean=True).agg(F.sum("total_paid")).first()[0]
    # payments of orders that have items and a known customer
    expect = (t["order_payments"].join(t["order_item"].select("order_id").distinct(), "order_id")
              .join(t["orders"].join(t["customer"].select("customer_id"), "customer_id")
                    .select("order_id"), "order_id")
              .agg(F.sum("payment_value")).first()[0])
    assert clean == expect
    faithful = W.payment_profile(t).agg(F.sum("total_paid")).first()[0]
    assert faithful >= clean


def test_period_growth_gaps_and_zero(spark):
    from marketlens.operators import period_growth
    df = spark.createDataFrame([(2017, 1, 10), (2017, 3, 0), (2017, 4, 5), (2017, 5, 10)],
                               "year int, month int, n bigint")
    out = period_growth(df, ["year", "month"], "n").orderBy("year", "month").collect()
    assert [r.prev for r in out] == [None, 10, 0, 5]       # lag over rows, gaps kept
    assert [r.growth_pct for r in out] == [None, -100.0, None, 100.0]


def test_months_of_any_role_add_up_to_all_sales(handmade):
    from marketlens.plans import kpi
    t, _ = handmade
    total = kpi._sales_rows(t).agg(F.sum("price")).first()[0]
    for role in ("purchase", "delivered", "approved"):
        assert sum(r.sales for r in kpi.sales_by_role(t, role).collect() if r.sales is not None) == total


def test_seller_review_average_keeps_all_digits(spark, handmade):
    from decimal import ROUND_HALF_UP, Decimal

    from marketlens.plans.views import seller_profile
    t, _ = handmade
    reviews = t["order_reviews"]
    order = t["order_item"].select("order_id").first()[0]
    seven = spark.range(7).select(*[
        (F.lit(order) if c == "order_id" else (F.col("id") % 3 + 2) if c == "review_score" else F.lit(None))
        .cast(reviews.schema[c].dataType).alias(c) for c in reviews.columns])
    three = {**t, "order_reviews": reviews.where(F.col("order_id") != order).union(seven)}
    scores = {}
    for r in three["order_reviews"].where("review_score is not null").collect():
        scores.setdefault(r.order_id, []).append(r.review_score)
    known = {r.order_id for r in t["orders"].collect()}
    want = {}
    for r in t["order_item"].collect():
        if r.order_id in scores and r.order_id in known:
            s = scores[r.order_id]
            mean = Decimal(sum(s) / len(s)).quantize(Decimal(10) ** -9, ROUND_HALF_UP)
            want.setdefault(r.seller_id, []).append(mean)
    got = {r.seller_id: r.avg_review for r in seller_profile(three).collect() if r.avg_review is not None}
    assert got and got == {s: float(sum(want[s])) / len(want[s]) for s in got}


def test_views_are_the_sums_over_their_unaggregated_rows(spark, handmade, t001):
    """W2, W5 and W6 never form the rows of their CTEs; summed from those rows they are the same."""
    from marketlens.plans import views as W
    for t in (handmade[0], t001):
        base = W.customer_base(t)
        want = base.groupBy("customer_id").agg(
            F.count("review_score").alias("review_count"), F.countDistinct("order_item_id").alias("items_bought"),
            F.sum("payment_value").cast("decimal(38,2)").alias("total_spent"),
            F.sum("freight_value").cast("decimal(38,4)").alias("total_freight"))
        got = W.customer_profile(t).select(*want.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        rows = W.payment_rows(t)
        want = rows.groupBy("payment_type", "customer_state", "customer_city").agg(
            F.countDistinct("order_id").alias("order_count"), F.count(F.lit(1)).alias("times_used"),
            F.sum("payment_value").cast("decimal(38,2)").alias("total_paid"))
        assert sorted(map(str, W.payment_profile(t).select(*want.columns).collect())) == sorted(map(str, want.collect()))
        d = W.delivered_orders(t)
        want = d.groupBy("zip").agg(F.countDistinct("customer_id").alias("customer_count"),
                                    F.countDistinct("seller_id").alias("seller_count"),
                                    F.countDistinct("order_id").alias("order_count"),
                                    F.sum("order_paid").cast("decimal(38,2)").alias("total_paid"))
        got = W.zone_profile(t).select(*want.columns).where("order_count > 0").distinct()
        zips = {r[0] for r in t["geolocation"].select("geolocation_zip_code_prefix").collect()}
        assert sorted(map(str, got.collect())) == sorted(str(r) for r in want.collect() if r.zip in zips)


def test_null_counts_of_any_frame_and_of_the_detail(spark, handmade):
    from marketlens.operators import null_counts
    from marketlens.plans.model import DETAIL_GRAINS, detail_null_counts
    from marketlens.plans.views import W1_COLUMNS, orders_detail
    t, _ = handmade
    assert sorted(c for of in DETAIL_GRAINS.values() for c in of) == sorted(W1_COLUMNS)
    whole = {r.column_name: (r.rows, r.nulls) for r in null_counts(orders_detail(t)).collect()}
    for cols in (W1_COLUMNS, ["payment_value"], ["customer_city", "price"], ["seller_state"], []):
        row = detail_null_counts(t, cols).first()
        assert {c: (row["rows"], row[f"{c}_nulls"]) for c in cols} == {c: whole[c] for c in cols}
        assert row["rows"] == whole["order_id"][0]
    with pytest.raises(ValueError, match="order_total"):
        detail_null_counts(t, ["order_total"])
    odd = spark.createDataFrame([(1, None), (None, None)], "`a.b` int, c string")
    assert sorted(map(tuple, null_counts(odd).collect())) == [("a.b", 2, 1), ("c", 2, 2)]
    assert [tuple(r) for r in null_counts(odd.limit(0), ["c"]).collect()] == [("c", 0, 0)]


def test_a_zips_point_does_not_depend_on_the_order_of_rows(spark, handmade):
    from marketlens.plans.model import dim_customer
    t, _ = handmade
    rows = [("01001", -23.0 - i / 7, 46.1 * (i % 3) - 1e-9 * i, "x", "SP") for i in range(500)] + [("01001", None, 1.5, "x", "SP")]
    points = set()
    for parts in (1, 3, 7):
        g = spark.createDataFrame(rows[::parts] + [r for i, r in enumerate(rows) if i % parts], t["geolocation"].schema).repartition(parts)
        points.add(tuple(dim_customer({**t, "geolocation": g}).where("customer_id = 'c1'").select(
            "geolocation_lat", "geolocation_lng").first()))
    (point,) = points
    assert point == pytest.approx((-23.0 - 499 / 14, sum(r[2] for r in rows) / 501), abs=1e-9)


def test_sales_yoy_over_a_gap(spark, handmade):
    from marketlens.plans.kpi import sales_yoy
    t, _ = handmade
    rows = {(r.year, r.month): (r.sales, r.prev_year_sales) for r in sales_yoy(t).collect()}
    assert all(prev == (rows[y - 1, m][0] if (y - 1, m) in rows else None) for (y, m), (_, prev) in rows.items())
    assert "Join" not in sales_yoy({**t})._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[0]


def test_seller_counts_with_customers_of_several_places(spark, handmade):
    """Every distinct count of the seller view against sets over its item rows,
    where customers stand in several places, cities in several states and ids repeat."""
    from marketlens.schema import SCHEMAS
    t, _ = handmade
    more = [("c1", "u1", "01001", "rio", "RJ"), ("c1", "u1", "01001", "rio", "SP"), ("c1", "u1", "01001", None, "RJ"),
            ("c2", "u1", "01001", "rio", "RJ"), ("c3", "u3", "02002", "rio", "RJ"), ("c5", "u5", "09999", "rio", None)]
    t = {**t, "customer": t["customer"].union(spark.createDataFrame(more, SCHEMAS["customer"])),
         "orders": t["orders"].union(t["orders"].where("order_id in ('o1', 'o6')").withColumn(
             "customer_id", F.lit("c2"))).union(t["orders"].where("order_id = 'o4'"))}
    rows = W.items_per_seller(t).collect()
    want = {}
    for s in {r["seller_id"] for r in rows}:
        of = [r for r in rows if r["seller_id"] == s]
        known = [len({r[c] for r in of} - {None}) for c in ("order_item_id", "customer_id", "customer_city", "customer_state")]
        orders = len({(r["order_id"], r["customer_id"], r["customer_city"], r["customer_state"]) for r in of})
        want[s] = (orders, len(of), *known)
    for clean in (False, True):
        got = {r["seller_id"]: (r["order_count"], r["unit_count"], r["customer_count"], r["city_count"], r["state_count"])
               for r in W.seller_profile(t, clean).collect()}
        assert got == {s: (o, n if clean else p, *rest) for s, (o, n, p, *rest) in want.items()}
