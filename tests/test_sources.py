"""Ingest, type repair and staged layout."""

from __future__ import annotations

import os
import tempfile
from decimal import Decimal

import pytest

from pyspark.sql import functions as F

from marketlens.schema import SCHEMAS
from marketlens.sources import ingest_csv, load_csv, retype, stage_tables


def test_csv_ingest_and_quarantine(spark):
    d = tempfile.mkdtemp(prefix="run-csv-", dir="/tmp")
    with open(os.path.join(d, "order_reviews.csv"), "w") as f:
        f.write('review_id,order_id,review_score,review_creation_date\n'
                'r1,o1,5,2018-01-01 10:00:00\n'
                'r2,o2,"four",2018-01-02 10:00:00\n'
                '"r3","o3",,"2018-01-03 10:00:00"\n'
                'r4,o4,3,not a date\n')
    raw = ingest_csv(spark, d, "order_reviews")
    assert raw.count() == 4
    good, bad = retype(raw, SCHEMAS["order_reviews"])
    assert sorted(r.review_id for r in good.collect()) == ["r1", "r3"]
    assert sorted(r.review_id for r in bad.collect()) == ["r2", "r4"]
    assert dict(good.dtypes)["review_score"] == "int"
    assert dict(good.dtypes)["review_creation_date"] == "timestamp_ntz"


def test_csv_multiline_field(spark):
    d = tempfile.mkdtemp(prefix="run-csv-", dir="/tmp")
    with open(os.path.join(d, "sellers.csv"), "w") as f:
        f.write('seller_id,seller_zip_code_prefix,seller_city,seller_state\n'
                's1,01001,"sao\npaulo",SP\ns2,02002,rio,RJ\n')
    good, _ = retype(ingest_csv(spark, d, "sellers", multi_line=True), SCHEMAS["sellers"])
    rows = {r.seller_id: r for r in good.collect()}
    assert rows["s1"].seller_city == "sao\npaulo" and rows["s1"].seller_zip_code_prefix == "01001"


def test_load_csv_all_tables(spark, handmade):
    t, _ = handmade
    d = tempfile.mkdtemp(prefix="run-csvall-", dir="/tmp")
    from marketlens.schema import CSV_NAMES
    for name, df in t.items():
        out = os.path.join(d, "parts", name)
        df.coalesce(1).write.option("header", True).csv(out)
        part = [p for p in os.listdir(out) if p.endswith(".csv")][0]
        os.link(os.path.join(out, part), os.path.join(d, f"{CSV_NAMES[name]}.csv"))
    good, bad = load_csv(spark, d)
    for name in t:
        assert good[name].count() == t[name].count(), name
        assert bad[name].count() == 0, name


def test_staged_order_grain_joins_without_exchange(spark, handmade):
    t, _ = handmade
    staged = stage_tables(spark, t, database="test_stage", buckets=2)
    j = staged["order_item"].join(staged["order_payments"], "order_id").join(
        staged["order_reviews"], "order_id")
    plan = j._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    info = spark.sql("describe formatted test_stage.order_item").collect()
    assert any(r.col_name == "Num Buckets" and r.data_type == "2" for r in info)
    assert staged["orders"].count() == t["orders"].count()
    assert staged["order_item"].agg(F.sum("price")).first()[0] == \
        t["order_item"].agg(F.sum("price")).first()[0]


def test_one_file_per_bucket_and_sort_free_join(spark, handmade):
    import glob
    t, _ = handmade
    staged = stage_tables(spark, t, database="test_stage_files", buckets=2)
    loc = spark.sql("describe formatted test_stage_files.order_item") \
        .where("col_name = 'Location'").first()["data_type"]
    files = glob.glob(loc.replace("file:", "") + "/*.parquet")
    ids = [f.rsplit("_", 1)[-1].split(".")[0] for f in files]
    assert len(ids) == len(set(ids)) <= 2          # at most one file per bucket
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = staged["orders"].join(staged["order_item"], "order_id")
        plan = j._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" in plan
    assert "Exchange" not in plan and "Sort [" not in plan


def test_database_zip_dimension_and_export(spark, handmade):
    from marketlens.sources import create_database, export_model, write_clustered, zip_dimension
    from marketlens.sources.layout import LAYOUTS
    t, _ = handmade
    create_database(spark, "ml_test_db")
    assert spark.catalog.currentDatabase() == "ml_test_db"
    spark.catalog.setCurrentDatabase("default")
    z = sorted(r[0] for r in zip_dimension(t).collect())
    assert z == ["01001", "02002", "03003", "04004"]
    d = tempfile.mkdtemp(prefix="run-export-", dir="/tmp")
    export_model({"dim_seller": t["sellers"]}, d)
    assert spark.read.parquet(f"{d}/dim_seller").count() == 3
    write_clustered(t["customer"], f"{d}/customer", layout=LAYOUTS["customer"], buckets=2)
    back = spark.read.parquet(f"{d}/customer")
    assert back.count() == t["customer"].count()


def test_layout_is_the_callers_choice(spark, handmade):
    t, _ = handmade
    hot = {**t, "order_item": t["order_item"].withColumn("order_id", F.lit("o1"))}
    for buckets, has in ((4, True), (None, False)):
        name = f"test_stage_{buckets}"
        staged = stage_tables(spark, hot, database=name, buckets=buckets)
        info = spark.sql(f"describe formatted {name}.order_item").collect()
        assert any(r.col_name == "Num Buckets" for r in info) == has
        assert staged["order_item"].count() == t["order_item"].count()


def test_union_of_bucketed_tables_aggregates_by_key(spark, handmade):
    t, _ = handmade
    items = stage_tables(spark, t, database="test_stage_union", buckets=3)["order_item"]
    got = items.union(items).groupBy("order_id").agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(got) == len({r.order_id for r in got}) and sum(r.n for r in got) == 2 * items.count()


def _payments_csv(lines):
    import os
    d = tempfile.mkdtemp(prefix="run-csv-", dir="/tmp")
    from marketlens.schema import CSV_NAMES
    with open(os.path.join(d, CSV_NAMES["order_payments"] + ".csv"), "w") as f:
        f.write("\n".join(lines) + "\n")
    return d


def test_csv_binds_by_header_and_quarantines_malformed_rows(spark):
    from marketlens.schema import SCHEMAS
    from marketlens.sources import ingest_csv, retype
    names = [f.name for f in SCHEMAS["order_payments"].fields]
    values = {"order_id": "o1", "payment_sequential": "1", "payment_type": "card",
              "payment_installments": "2", "payment_value": "99.33"}
    row = [values.get(n, "x") for n in names]
    header = ["extra", *reversed(names)]
    good_row = ["8.00", *reversed(row)]
    d = _payments_csv([",".join(header), ",".join(good_row), ",".join(good_row[:-1]), ",".join([*good_row, "more"]),
                       ",".join("zz" if h == "payment_value" else v for h, v in zip(header, good_row))])
    good, bad = retype(ingest_csv(spark, d, "order_payments"), SCHEMAS["order_payments"])
    assert [(r.order_id, str(r.payment_value)) for r in good.collect()] == [("o1", "99.33")]
    assert bad.count() == 3
    d = _payments_csv([",".join(names[:-1]), ",".join(row[:-1])])
    with pytest.raises(ValueError, match=names[-1]):
        ingest_csv(spark, d, "order_payments")
    quoted = ['"a\nb"' if n == "payment_type" else v for n, v in zip(names, row)]
    d = _payments_csv([",".join(names), ",".join(quoted)])
    good, bad = retype(ingest_csv(spark, d, "order_payments", multi_line=True), SCHEMAS["order_payments"])
    assert good.first().payment_type == "a\nb" and bad.count() == 0


def _folder(table, files):
    d = tempfile.mkdtemp(prefix="run-csv-", dir="/tmp")
    from marketlens.schema import CSV_NAMES
    folder = os.path.join(d, CSV_NAMES[table] + ".csv")
    os.mkdir(folder)
    for name, text in files.items():
        if name.endswith(".gz"):
            import gzip
            with gzip.open(os.path.join(folder, name), "wt") as f:
                f.write(text)
        else:
            with open(os.path.join(folder, name), "w") as f:
                f.write(text)
    return d


def test_every_file_of_a_folder_is_bound_by_its_own_header(spark):
    names = [f.name for f in SCHEMAS["customer"].fields]
    other = ["customer_state", "customer_city", "more", "more", *names[:3]]
    d = _folder("customer", {
        "a.csv": ",".join(names) + "\nc1,u1,01001,rio,RJ\n",
        "b.csv": ",".join(other) + "\nSP,sao,x,y,c2,u2,02002\nSP,campinas,x,y,c3,u3\n",
        "c.csv.gz": "\ufeff" + ",".join(reversed(names)) + '\nMG,"belo, h",03003,u4,c4\n',
        "_SUCCESS": "", "empty.csv": "", "d.csv": ",".join(names) + "\n"})
    good, bad = retype(ingest_csv(spark, d, "customer"), SCHEMAS["customer"])
    assert sorted(map(tuple, good.collect())) == [
        ("c1", "u1", "01001", "rio", "RJ"), ("c2", "u2", "02002", "sao", "SP"), ("c4", "u4", "03003", "belo, h", "MG")]
    rows = bad.collect()
    assert [(r["_reason"], os.path.basename(r["_file"])) for r in rows] == [("malformed", "b.csv")]
    d = _folder("customer", {"a.csv": ",".join(names) + "\n", "b.csv": ",".join(names[1:]) + "\nu1,1,c,s\n"})
    with pytest.raises(ValueError, match=r"b\.csv has no column customer_id"):
        ingest_csv(spark, d, "customer")


def test_import_reads_once_and_says_why_rows_were_rejected(spark):
    from marketlens.sources import import_csv
    names = [f.name for f in SCHEMAS["order_payments"].fields]
    d = _folder("order_payments", {
        "a.csv": ",".join(names) + "\no1,1,card,9.50\no2,one,card,ten\no3,,card,\no4,2,card\n",
        "b.csv": ",".join(reversed(names)) + "\n3.25,boleto,x,o5\n 7 ,boleto, 3 ,o6\n"})
    store = tempfile.mkdtemp(prefix="run-import-", dir="/tmp")
    good, bad, counts = import_csv(spark, d, store, tables=("order_payments",))
    assert sorted((r.order_id, r.payment_sequential, r.payment_value) for r in good["order_payments"].collect()) == [
        ("o1", 1, Decimal("9.50")), ("o3", None, None), ("o6", 3, Decimal("7.00"))]
    assert good["order_payments"].schema.names == names
    rows = {r.order_id: r for r in bad["order_payments"].collect()}
    assert {k: r["_reason"] for k, r in rows.items()} == {
        "o2": "payment_sequential,payment_value", "o4": "malformed", "o5": "payment_sequential"}
    assert rows["o2"].payment_value == "ten" and rows["o4"]["_corrupt_record"] == "o4,2,card"
    assert os.path.basename(rows["o5"]["_file"]) == "b.csv"
    assert counts["order_payments"] == {"rows": 6, "rejected": 3, "fault_payment_sequential": 2,
                                        "fault_payment_value": 1, "fault_malformed": 1}


def test_month_layout_prunes_and_a_late_month_rewrites_its_own_folder(spark, t001):
    from marketlens.sources import bought_between, read_months, write_months
    path = tempfile.mkdtemp(prefix="run-months-", dir="/tmp") + "/orders"
    orders = t001["orders"].union(t001["orders"].limit(1).withColumns(
        {"order_id": F.lit("undated"), "order_purchase_timestamp": F.lit(None).cast("timestamp_ntz")}))
    write_months(orders, path, files=6)
    months = read_months(spark, path, orders)
    assert months.count() == orders.count() and months.where("purchase_month is null").count() == 1
    part = bought_between(months, "1996-02-10", "1996-04-05")
    plan = part._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("PartitionFilters"):]
    scan = scan[:scan.index("PushedFilters")]
    assert ">= 1996-02" in scan and "<= 1996-04" in scan
    day = F.to_date("order_purchase_timestamp")
    assert part.count() == orders.where(day.between(F.lit("1996-02-10").cast("date"), F.lit("1996-04-05").cast("date"))).count() > 0
    before = {f: os.stat(f.removeprefix("file://")).st_mtime_ns for f in months.inputFiles()}
    late = orders.where(F.date_format("order_purchase_timestamp", "yyyy-MM") == "1996-03")
    write_months(late.limit(5), path, files=2)
    again = read_months(spark, path, orders)
    after = {f: os.stat(f.removeprefix("file://")).st_mtime_ns for f in again.inputFiles()}
    assert {f for f in before if "=1996-03" not in f} == {f for f in after if "=1996-03" not in f}
    assert all(before[f] == after[f] for f in after if "=1996-03" not in f)
    assert again.where("purchase_month = '1996-03'").count() == 5


def test_a_hot_month_is_several_files(spark, t001):
    from marketlens.sources import read_months, write_months
    path = tempfile.mkdtemp(prefix="run-months-", dir="/tmp") + "/orders"
    hot = t001["orders"].withColumn("order_purchase_timestamp", F.when(
        F.length("order_id") > 2, F.lit("1997-07-07 00:00:00").cast("timestamp_ntz")).otherwise(F.col("order_purchase_timestamp")))
    write_months(hot, path, files=8)
    files = [f for f in read_months(spark, path, hot).inputFiles() if "=1997-07" in f]
    assert len(files) >= 4


def test_payments_of_hot_unknown_and_empty_line_items(spark):
    from decimal import Decimal

    from marketlens.sources.adapter import payments_from_lineitem
    rows = [(1, "A", 0.25)] * 500 + [(1, "R", 2.0), (2, "R", 1.5), (2, "N", None), (3, "N", None), (4, "X", 9.0), (4, None, 9.0),
            (None, "N", 1.0), (None, "N", 2.5)]
    items = spark.createDataFrame(rows, "l_orderkey long, l_returnflag string, l_extendedprice double").repartition(3)
    got = sorted((tuple(r) for r in payments_from_lineitem(items).collect()), key=str)
    assert got == sorted([("1", 1, "credit_card", Decimal("125.00")), ("1", 2, "voucher", Decimal("2.00")),
                          ("2", 1, "voucher", Decimal("1.50")), (None, 1, "boleto", Decimal("3.50"))], key=str)
