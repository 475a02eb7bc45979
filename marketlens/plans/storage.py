"""Queries over what the sinks and sources write: staged catalog tables, the
month layout, CSV folders, published views and the exported model.

Each writes the given tables (or what Spark derives from them) to the session's
shared folder and answers from there, so a fault in a layout, a header binding
or an export shows in the rows.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.plans.grain import payments_per_order
from marketlens.plans.pipeline import MODEL_TABLES, refresh_model
from marketlens.plans.views import VIEW_NAMES, publish_views
from marketlens.schema import MONEY_SUM, SCHEMAS
from marketlens.sources.ingest import create_database, import_csv, ingest_csv, retype
from marketlens.sources.layout import (MONTH, bought_between, new_folder, read_months, stage_tables,
                                       with_month, write_months)

T = dict[str, DataFrame]

DATABASE, BUCKETS = "marketlens_staged", 8

#: The days of the from-to report.
PERIOD = ("1997-03-15", "1998-02-10")


def _spark(t: T):
    return t["orders"].sparkSession


def staged(t: T, table: str) -> DataFrame:
    """A table as it comes back from the catalog in its layout."""
    spark = _spark(t)
    return stage_tables(spark, {table: t[table]}, DATABASE, BUCKETS, new_folder(spark, "staged"))[table]


def staged_order_sums(t: T) -> DataFrame:
    """The four bucketed tables joined bucket to bucket: per status the
    orders, item rows, payments and reviews, each side summed per order first."""
    spark = _spark(t)
    grain = {n: t[n] for n in ("orders", "order_item", "order_payments", "order_reviews")}
    s = stage_tables(spark, grain, DATABASE, BUCKETS, new_folder(spark, "staged"))
    j = s["orders"].select("order_id", "order_status")
    for name, n in (("order_item", "items"), ("order_payments", "payments"), ("order_reviews", "reviews")):
        j = j.join(s[name].groupBy("order_id").agg(F.count(F.lit(1)).alias(n)), "order_id", "left")
    return j.groupBy("order_status").agg(F.count(F.lit(1)).alias("orders"), *[
        F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias(n) for n in ("items", "payments", "reviews")])


def _by_month(t: T) -> tuple[DataFrame, str]:
    path = new_folder(_spark(t), "orders")
    write_months(t["orders"], path)
    return read_months(_spark(t), path, t["orders"]), path


def sales_in_period(t: T, first: str = PERIOD[0], last: str = PERIOD[1]) -> DataFrame:
    """L2: orders and payments per month of a from-to report over the month
    layout; the scan lists the period's folders alone."""
    months, _ = _by_month(t)
    orders = bought_between(months, first, last).select("order_id", MONTH)
    return orders.join(payments_per_order(t), "order_id", "left").groupBy(MONTH).agg(
        F.count(F.lit(1)).alias("orders"), F.sum("pay_sum").cast(MONEY_SUM).alias("total_paid"))


def late_month_refresh(t: T) -> DataFrame:
    """L2: orders per month and status after the last month came again, each of
    its orders with the status ``late``; other months are as they were."""
    months, path = _by_month(t)
    last = months.agg(F.max(MONTH)).scalar()
    write_months(with_month(t["orders"]).where(F.col(MONTH) == last).drop(MONTH).withColumn("order_status", F.lit("late")), path)
    return read_months(_spark(t), path, t["orders"]).groupBy(MONTH, "order_status").agg(F.count(F.lit(1)).alias("orders"))


def csv_folder_customers(t: T) -> DataFrame:
    """The customers from a folder of CSV files of which half have their
    columns in reverse, behind one that nobody asked for."""
    spark, table = _spark(t), "customer"
    path = new_folder(spark, "csv")
    odd = F.expr("ascii(right(customer_id, 1)) % 2 = 1")
    writer = {"header": True, "escape": '"'}
    t[table].where(F.coalesce(odd, F.lit(False))).write.options(**writer).csv(f"{path}/{table}.csv")
    rest = t[table].where(~F.coalesce(odd, F.lit(False)))
    rest.select(F.lit("x,y").alias("extra"), *reversed(rest.columns)).write.options(**writer).mode("append").csv(f"{path}/{table}.csv")
    return retype(ingest_csv(spark, path, table), SCHEMAS[table])[0]


def _import_damaged(t: T):
    spark, path = _spark(t), new_folder(_spark(t), "csv")
    digit = F.expr("ascii(right(order_id, 1)) % 10")
    text = t["order_payments"].select(
        "order_id", F.when((digit == 4) & (F.col("payment_type") == "boleto"), "first").otherwise(
            F.col("payment_sequential").cast("string")).alias("payment_sequential"),
        "payment_type", F.when(digit.isin(4, 6), F.concat(F.lit("R$ "), F.col("payment_value").cast("string"))).otherwise(
            F.col("payment_value").cast("string")).alias("payment_value"))
    text.write.options(header=True, escape='"').csv(f"{path}/order_payments.csv")
    good, bad, counts = import_csv(spark, path, new_folder(spark, "import"), tables=("order_payments",))
    return good["order_payments"], bad["order_payments"], counts["order_payments"]


def csv_quarantine(t: T) -> DataFrame:
    """The payments that a CSV import rejects, with their text and reason,
    from an export whose amounts and numbers are damaged by the order's id."""
    return _import_damaged(t)[1].select("order_id", "payment_sequential", "payment_type", "payment_value",
                                        F.col("_reason").alias("reason"))


def csv_import(t: T) -> DataFrame:
    """The payments that the same import accepts, typed."""
    return _import_damaged(t)[0]


def csv_import_counts(t: T) -> DataFrame:
    """Rows read, rejected and per fault, as observed while writing."""
    counts = _import_damaged(t)[2]
    return _spark(t).createDataFrame([{"count": k, "n": v} for k, v in counts.items()], "count string, n long")


def database_tables(t: T) -> DataFrame:
    """The tables of a database that was dropped, created and staged anew."""
    spark, before = _spark(t), _spark(t).catalog.currentDatabase()
    create_database(spark, f"{DATABASE}_new", drop=True)
    spark.catalog.setCurrentDatabase(before)
    stage_tables(spark, t, f"{DATABASE}_new", BUCKETS, new_folder(spark, "staged"))
    return spark.sql(f"SHOW TABLES IN {DATABASE}_new").where("not isTemporary").select(F.col("tableName").alias("table_name"))


def views_published(t: T) -> DataFrame:
    """Rows of each published view, asked for by name in SQL."""
    names = publish_views(t, "published_")
    rows = [_spark(t).sql(f"SELECT '{n.removeprefix('published_')}' AS view, count(*) AS rows FROM {n}") for n in names]
    return reduce(DataFrame.unionByName, rows)


def model_exported(t: T) -> DataFrame:
    """Rows of each exported model table, read back from its Parquet folder."""
    path = new_folder(_spark(t), "model")
    rows = [_spark(t).read.parquet(f"{path}/{n}").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("model_table"), "rows")
            for n in refresh_model(t, path)]
    return reduce(DataFrame.unionByName, rows)


QUERIES = {
    **{f"staged_{table}": partial(staged, table=table) for table in SCHEMAS},
    "staged_order_sums": staged_order_sums,
    "sales_in_period": sales_in_period,
    "late_month_refresh": late_month_refresh,
    "csv_folder_customers": csv_folder_customers,
    "csv_quarantine": csv_quarantine,
    "csv_import": csv_import,
    "csv_import_counts": csv_import_counts,
    "database_tables": database_tables,
    "views_published": views_published,
    "model_exported": model_exported,
}

#: What the last two report on, for the oracle.
PUBLISHED, EXPORTED = tuple(VIEW_NAMES), tuple(MODEL_TABLES)
