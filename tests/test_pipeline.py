"""Entry points A (setup) and C (model refresh) end to end on sf0.001."""

from __future__ import annotations

import tempfile

from marketlens.plans.pipeline import MODEL_TABLES, refresh_model, setup
from marketlens.plans.registry import QUERIES

SF001 = "/root/testdata/sf0.001"


def test_setup_then_questions_then_model(spark, t001):
    res = setup(spark, SF001, database="pipe_test", buckets=2)
    report = {(r.kind, r.name): (r.bad_values, r.bad_rows) for r in res.report.collect()}
    assert len(report) == 16
    assert report[("primary_key", "orders")] == (0, 0)
    # staged tables answer exactly like the lazy adapter tables
    for key in ("top10_seller_concentration", "on_time_share", "payment_method_usage"):
        a = sorted(map(tuple, QUERIES[key](res.tables).collect()))
        b = sorted(map(tuple, QUERIES[key](t001).collect()))
        assert a == b, key
    out = tempfile.mkdtemp(prefix="run-model-", dir="/tmp")
    names = refresh_model(res.tables, out)
    assert names == list(MODEL_TABLES)
    assert spark.read.parquet(f"{out}/fact_order_items").count() == \
        t001["order_item"].join(t001["orders"], "order_id").count()


def test_setup_from_csv_export(spark, t001):
    import os

    from marketlens.schema import CSV_NAMES
    d = tempfile.mkdtemp(prefix="run-csvsetup-", dir="/tmp")
    for name, df in t001.items():
        out = os.path.join(d, "parts", name)
        df.coalesce(1).write.option("header", True).csv(out)
        part = [p for p in os.listdir(out) if p.endswith(".csv")][0]
        os.link(os.path.join(out, part), os.path.join(d, f"{CSV_NAMES[name]}.csv"))
    res = setup(spark, d, fmt="csv", database="pipe_csv", stage=False)
    assert all(q.count() == 0 for q in res.quarantine.values())
    for key in ("top10_seller_concentration", "zone_profile", "review_by_delivery_bucket"):
        a = sorted(map(tuple, QUERIES[key](res.tables).collect()))
        b = sorted(map(tuple, QUERIES[key](t001).collect()))
        assert a == b, key


def test_setup_from_csv_with_newlines_in_review_comments(spark):
    import os

    from marketlens.schema import CSV_NAMES, SCHEMAS
    d = tempfile.mkdtemp(prefix="run-csvlines-", dir="/tmp")
    for name, schema in SCHEMAS.items():
        with open(os.path.join(d, f"{CSV_NAMES[name]}.csv"), "w") as f:
            f.write(",".join(schema.names) + (",comment\n" if name == "order_reviews" else "\n"))
            if name == "order_reviews":
                f.write('r1,o1,5,2018-01-02 00:00:00,"Good,\nand ""fast"""\nr2,o2,1,2018-01-03 00:00:00,late\n')
    res = setup(spark, d, fmt="csv", database="pipe_csv", stage=False, multi_line=frozenset({"order_reviews"}))
    rows = sorted((r["review_id"], r["review_score"]) for r in res.tables["order_reviews"].collect())
    assert rows == [("r1", 5), ("r2", 1)]
    assert res.quarantine["order_reviews"].count() == 0
