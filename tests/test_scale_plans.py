"""Plans as they look at scale: with broadcast joins disabled (no table of
the order grain fits a broadcast at 100 TB) and the static plan (AQE off),
every query plans without Cartesian products or nested-loop joins, funnels
data into a single partition only after an aggregate or a top-n, and still
matches its oracle."""

from __future__ import annotations

import re

import pytest

from marketlens.oracle import ORACLE_SQL
from marketlens.plans.registry import QUERIES
from marketlens.testing import compare

REDUCED = re.compile(r"HashAggregate|SortAggregate|TakeOrderedAndProject|Union|"
                     r"GlobalLimit|LocalLimit")


@pytest.fixture
def scale_shape(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_all_keys_at_scale_shape(spark, t001, duck001, scale_shape):
    failures = []
    for key in sorted(QUERIES):
        df = QUERIES[key](t001)
        lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
        plan = "\n".join(lines)
        if "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan:
            failures.append((key, "nested loop"))
            continue
        for i, line in enumerate(lines):
            if "Exchange SinglePartition" in line:
                child = lines[i + 1] if i + 1 < len(lines) else ""
                if not REDUCED.search(child):
                    failures.append((key, "single partition over " + child.strip()[:80]))
        r = compare(key, df, duck001, ORACLE_SQL[key])
        if not (r.columns_match and r.spark_rows == r.oracle_rows and r.values_exact):
            failures.append((key, r.notes))
    assert not failures, failures


# Keys that read a table more often than twice (a table of dates behind the calendar, one aggregate per measure), and how often.
MORE_SCANS = {"november_fridays": 4, "sales_by_purchase_month": 3, "sales_by_delivery_month": 3, "sales_by_approval_month": 3}
# Shuffles by key of the keys that need most, over the raw tables: nothing may be added unseen.
MOST_SHUFFLES = {
    "orders_detail": 13, "customer_profile": 7, "seller_profile": 9, "seller_profile_clean": 9, "product_profile": 10,
    "zone_profile": 11, "zone_profile_clean": 9, "top10_category_share": 11, "top10_seller_concentration": 9,
    "top_products_net_of_freight": 8, "fastest_sellers_row_number": 7, "delivery_days_by_category": 10,
    "delivery_days_by_state_category": 12, "review_score_by_category": 13, "review_score_by_category_clean": 10,
    "null_report_all": 13, "state_delivery_vs_score": 6, "sales_yoy": 6, "orphan_orders": 2, "constraint_report": 5,
}


def test_scans_and_shuffles_per_key(spark, t001, scale_shape):
    from collections import Counter

    from marketlens.plans.storage import QUERIES as WRITTEN
    over = []
    for key in sorted(set(QUERIES) - set(WRITTEN)):
        plan = QUERIES[key](t001)._jdf.queryExecution().executedPlan().toString()
        scans = Counter(re.findall(r"FileScan parquet .*?/(\w+)\.parquet", plan))
        over += [(key, name, n) for name, n in scans.items()
                 if name not in ("nation", "part") and n > MORE_SCANS.get(key, 2) and "constraint_report" not in key]
        shuffles = len(re.findall(r"Exchange (?:hash|range)partitioning", plan))
        if shuffles > MOST_SHUFFLES.get(key, 14):
            over.append((key, "shuffles", shuffles))
    assert not over, over


def test_items_are_never_dealt_out_by_category(spark, t001, scale_shape):
    """A category is one of a few dozen values: only product rows are shuffled by it."""
    for key in sorted(k for k in QUERIES if "categor" in k or k in ("product_profile", "orders_detail")):
        lines = QUERIES[key](t001)._jdf.queryExecution().executedPlan().toString().splitlines()
        for i, line in enumerate(lines):
            if re.search(r"Exchange hashpartitioning\(product_category_name#\d+, \d+\)", line):
                below = "\n".join(x for x in lines[i + 1:i + 8])
                assert "lineitem" not in below and "SortMergeJoin" not in below, key


def test_seller_view_copies_no_rows_for_its_distinct_counts(spark, t001, scale_shape):
    for key in ("seller_profile", "seller_profile_clean"):
        assert "Expand" not in QUERIES[key](t001)._jdf.queryExecution().executedPlan().toString(), key


def test_counting_a_view_leaves_out_what_only_its_columns_need(spark, t001, scale_shape):
    """Payments and reviews make no row of the customer and the seller view."""
    for key in ("customer_profile", "seller_profile"):
        plan = QUERIES[key](t001).groupBy().count()._jdf.queryExecution().executedPlan().toString()
        assert "events.parquet" not in plan and plan.count("lineitem.parquet") == (key == "seller_profile"), key


def test_payments_are_summed_where_orders_lie_and_not_in_the_scan(spark, t001, scale_shape):
    """A table of sums in a scan task would hold every order of its split or row group."""
    for df in (t001["order_payments"], QUERIES["seller_profile_clean"](t001)):
        lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
        scans = [i for i, line in enumerate(lines) if "lineitem.parquet" in line and "l_returnflag" in line]
        assert scans
        for i in scans:
            above = lines[:i][::-1]
            dealt = next(k for k, line in enumerate(above) if "Exchange hashpartitioning(" in line)
            assert "Aggregate" not in "\n".join(above[:dealt])
