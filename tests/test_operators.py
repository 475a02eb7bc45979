"""Reusable operators and column functions on small frames."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from marketlens.functions.columns import (bucketize, day_diff, grade, int_div,
                                          normalize_text, ratio, status_label)
from marketlens.operators import (dense_rank_all, fk_violations, pk_violations,
                                  share_of_top_n, top_n_per_group, top_n_ranked)


def test_int_div_truncates_toward_zero(spark):
    df = spark.createDataFrame([(-3, 2), (7, 2), (5, 0), (None, 3)], "a bigint, b bigint")
    assert [r[0] for r in df.select(int_div("a", "b")).collect()] == [-1, 3, None, None]


def test_ratio_null_on_zero(spark):
    df = spark.createDataFrame([(1, 0), (1, 4), (None, 2)], "a int, b int")
    assert [r[0] for r in df.select(ratio("a", "b", 100.0)).collect()] == [None, 25.0, None]


def test_day_diff_midnight(spark):
    df = spark.sql("select timestamp_ntz'2020-01-01 23:59:00' a, "
                   "timestamp_ntz'2020-01-02 00:01:00' b, timestamp_ntz'2020-01-01 00:01:00' c, "
                   "timestamp_ntz'2020-01-01 23:59:00' d")
    r = df.select(day_diff("a", "b").alias("x"), day_diff("c", "d").alias("y")).first()
    assert (r.x, r.y) == (1, 0)


@pytest.mark.parametrize("days,label,clean", [
    (-1, "30+ days", "invalid"), (0, "0-5 days", None), (5, "0-5 days", None),
    (6, "6-10 days", None), (10, "6-10 days", None), (11, "11-20 days", None),
    (20, "11-20 days", None), (21, "21-30 days", None), (30, "21-30 days", None),
    (31, "30+ days", None), (None, "30+ days", None)])
def test_bucketize(spark, days, label, clean):
    df = spark.createDataFrame([(days,)], "d int")
    assert df.select(bucketize("d")).first()[0] == label
    assert df.select(bucketize("d", invalid="invalid")).first()[0] == (clean or label)


def test_grade(spark):
    df = spark.createDataFrame([(5.0,), (4.2,), (3.0,), (1.4,), (None,)], "s double")
    assert [r[0] for r in df.select(grade("s")).collect()] == \
        ["excellent", "poor", "good", "poor", "poor"]
    assert [r[0] for r in df.select(grade("s", exact=False)).collect()] == \
        ["excellent", "very_good", "good", "poor", "poor"]


def test_normalize_and_status(spark):
    df = spark.createDataFrame([("  São   Paulo ", "delivered"), ("SAO PAULO", "bogus")],
                               "c string, s string")
    out = df.select(normalize_text("c").alias("n"), status_label("s").alias("l")).collect()
    assert [r.n for r in out] == ["sao paulo", "sao paulo"]
    assert [r.l for r in out] == ["Delivered", None]


def test_dense_rank_all_with_bins_matches_window(spark):
    vals = [(i, float((i * 37) % 101) / 3.0) for i in range(400)]
    df = spark.createDataFrame(vals, "k int, v double")
    got = {r.k: r["rank"] for r in dense_rank_all(df, "v", bins=10).collect()}
    want = {r.k: r.r for r in df.select("k", F.dense_rank().over(Window.orderBy("v"))
                                        .alias("r")).collect()}
    assert got == want
    got_desc = {r.k: r["rank"] for r in
                dense_rank_all(df, "v", ascending=False, bins=7).collect()}
    want_desc = {r.k: r.r for r in df.select("k", F.dense_rank().over(
        Window.orderBy(F.desc("v"))).alias("r")).collect()}
    assert got_desc == want_desc


def test_top_n_ranked_dense_matches_full_window(spark):
    df = spark.createDataFrame([(f"s{i}", i % 4) for i in range(20)], "k string, v int")
    got = [(r.k, r["rank"]) for r in
           top_n_ranked(df, [F.desc("v")], [F.asc("k")], 7, "dense_rank").orderBy("rank", "k")
           .collect()]
    full = df.select("k", F.dense_rank().over(Window.orderBy(F.desc("v"))).alias("rank")) \
        .orderBy(F.desc("v"), "k").limit(7).collect()
    assert got == [(r.k, r["rank"]) for r in full]


def test_share_of_top_n_with_ties(spark):
    df = spark.createDataFrame([("a", 5), ("b", 5), ("c", 3), ("d", None)], "k string, v int")
    r = share_of_top_n(df, "v", 1, [F.desc_nulls_last("v"), F.asc("k")]).first()
    assert (r.top_v, r.all_v) == (5, 13)


def test_top_n_per_group(spark):
    df = spark.createDataFrame([("x", "a", 1), ("x", "b", 3), ("y", "c", 2), ("y", "d", 2)],
                               "g string, k string, v int")
    out = top_n_per_group(df, ["g"], [F.desc("v"), F.asc("k")], 1).orderBy("g").collect()
    assert [(r.g, r.k) for r in out] == [("x", "b"), ("y", "c")]


def test_key_checks(spark):
    p = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "id string")
    got = {(r.key, r.n, r.reason) for r in pk_violations(p, ["id"]).collect()}
    assert got == {("a", 2, "duplicate"), (None, 1, "null")}
    c = spark.createDataFrame([("a",), ("z",), ("z",), (None,)], "fk string")
    assert [(r.value, r.n) for r in fk_violations(c, "fk", p, "id").collect()] == [("z", 2)]


@pytest.mark.parametrize("method,fn", [("dense_rank", F.dense_rank), ("rank", F.rank)])
@pytest.mark.parametrize("asc", [True, False])
def test_rank_by_matches_window(spark, method, fn, asc):
    from marketlens.operators import rank_by
    # a hot value (0.0) holds a third of the rows
    vals = [(i, 0.0 if i % 3 == 0 else float((i * 37) % 101) / 3.0) for i in range(300)]
    df = spark.createDataFrame(vals, "k int, v double")
    got = {r.k: r["rank"] for r in rank_by(df, "v", method, asc, bins=9).collect()}
    order = F.col("v") if asc else F.desc("v")
    want = {r.k: r.r for r in df.select("k", fn().over(Window.orderBy(order)).alias("r"))
            .collect()}
    assert got == want


@pytest.mark.parametrize("asc", [True, False])
@pytest.mark.parametrize("bins", [1, 3, 9, 64])
def test_row_numbers_match_window_and_split_a_tied_value(spark, asc, bins):
    from marketlens.operators import rank_by
    # a hot value holds a third of the rows, another tenth is null; ``rank`` is an input column too
    vals = [(i, None if i % 10 == 7 else 0.0 if i % 3 == 0 else float((i * 37) % 101) / 3.0, -i) for i in range(600)]
    df = spark.createDataFrame(vals, "k int, v double, rank int").repartition(5)
    out = rank_by(df, "v", "row_number", asc, bins=bins, tie_breakers=[F.desc("k")])
    assert dict(out.dtypes)["rank"] == "bigint" and sorted(out.columns) == ["k", "rank", "v"]
    order = F.asc_nulls_first("v") if asc else F.desc_nulls_last("v")
    want = {r.k: r.r for r in df.select("k", F.row_number().over(Window.orderBy(order, F.desc("k"))).alias("r")).collect()}
    assert {r.k: r["rank"] for r in out.collect()} == want


def test_row_numbers_deal_a_tied_value_over_tasks_without_a_second_shuffle(spark, monkeypatch):
    from marketlens.operators import ranking
    placed = []
    keep = ranking.materialize
    monkeypatch.setattr(ranking, "materialize", lambda df: placed.append(keep(df)) or placed[-1])
    df = spark.range(4000).select(F.lit(1).alias("v"), "id")
    out = ranking.row_numbers(df, ["v", "id"], bins=8)
    assert [r["rank"] for r in out.orderBy("id").collect()] == list(range(1, 4001))
    sizes = [r["count"] for r in placed[0].groupBy("_bin").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1500
    assert "hashpartitioning(id" not in out._jdf.queryExecution().executedPlan().toString()
    assert ranking.row_numbers(df.limit(0), ["v", "id"], bins=3).collect() == []


def test_key_report_reads_each_table_once_and_shuffles_once(spark):
    from marketlens.operators import key_report
    p = spark.createDataFrame([("a",), ("a",), (None,), (None,), ("b",)], "id string")
    c = spark.createDataFrame([("a", 1), ("z", 2), ("z", None), (None, 4), ("b", 4)], "fk string, n int")
    primary = {"p": ["id"], "zone": ["n"]}
    foreign = {"c_p": ("c", "fk", "p", "id"), "c_zone": ("c", "n", "zone", "n"), "p_c": ("p", "id", "c", "fk")}
    out = key_report({"p": p, "c": c}, primary, foreign, derived={"zone": "c"})
    assert {tuple(r) for r in out.collect()} == {
        ("primary_key", "p", 2, 4), ("primary_key", "zone", 0, 0),        # a derived dimension is sound
        ("foreign_key", "c_p", 1, 2), ("foreign_key", "c_zone", 0, 0), ("foreign_key", "p_c", 0, 0)}
    with pytest.raises(ValueError, match="several"):
        key_report({"p": p}, {"p": ["id", "id2"]}, {})
    empty = key_report({"p": p.limit(0), "c": c.limit(0)}, primary, foreign, derived={"zone": "c"})
    assert {tuple(r)[2:] for r in empty.collect()} == {(0, 0)}


def test_no_machine_local_folder_on_a_cluster():
    from marketlens.session import shared_folder

    class Conf(dict):
        def get(self, key, *default):
            return dict.get(self, key, *default)

    class Session:
        def __init__(self, master, **conf):
            self.sparkContext = type("Context", (), {"master": master, "getCheckpointDir": lambda s: None,
                                                     "setCheckpointDir": lambda s, d: None})()
            self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})
            self.conf.set = self.conf.__setitem__

    for warehouse in ("file:/x", "/x", "spark-warehouse"):
        with pytest.raises(ValueError, match="checkpoint"):
            shared_folder(Session("yarn", spark_sql_warehouse_dir=warehouse))
        assert shared_folder(Session("local[4]", spark_sql_warehouse_dir=warehouse)).startswith(warehouse)
    assert shared_folder(Session("yarn", spark_sql_warehouse_dir="hdfs://n/w")) == "hdfs://n/w/_checkpoints"
    assert shared_folder(Session("yarn", spark_sql_warehouse_dir="/x", spark_checkpoint_dir="s3a://b/c")) == "s3a://b/c"
