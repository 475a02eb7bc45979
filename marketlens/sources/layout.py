"""Sinks and physical layout (L): what the source's 21 B-tree indexes were for.

An index seek becomes file-layout pruning on Spark:

* the four order-grain tables are bucketed by ``order_id`` with one bucket
  count, so every view's chain of joins on ``order_id`` runs without a shuffle;
* range-sorted columns give Parquet row-group min/max skipping;
* bloom filters serve point lookups on high-cardinality ids;
* ``write_months`` keeps the orders in one folder per purchase month (L2's date
  index): a from-to filter reads those months' folders alone, and late rows
  rewrite only the months they belong to.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.session import shared_folder


@dataclass(frozen=True)
class Layout:
    partition_by: list[str] = field(default_factory=list)
    bucket_by: list[str] = field(default_factory=list)
    sort_by: list[str] = field(default_factory=list)
    bloom: list[str] = field(default_factory=list)


# Index intent of the source, re-aimed at Parquet layout
LAYOUTS: dict[str, Layout] = {
    "customer": Layout(sort_by=["customer_state", "customer_city"]),
    "orders": Layout(bucket_by=["order_id"], sort_by=["order_id"]),
    "order_item": Layout(bucket_by=["order_id"], sort_by=["order_id", "order_item_id"],
                         bloom=["product_id", "seller_id"]),
    "order_payments": Layout(bucket_by=["order_id"], sort_by=["order_id", "payment_type"]),
    "order_reviews": Layout(bucket_by=["order_id"], sort_by=["order_id", "review_score"]),
    "products": Layout(),
    "translation": Layout(),
    "sellers": Layout(sort_by=["seller_state", "seller_city"]),
    "geolocation": Layout(sort_by=["geolocation_zip_code_prefix"]),
}


def write_clustered(df: DataFrame, path: str | None = None, *, table: str | None = None,
                    layout: Layout = Layout(), buckets: int = 8,
                    mode: str = "overwrite") -> None:
    """Write ``df`` with the given layout.

    Bucketing needs a catalog table (``table``); otherwise the frame is range
    partitioned on the sort columns and sorted inside each file so that
    row-group statistics stay tight.
    """
    w = df
    if layout.bucket_by:
        # hash-partition on the bucket columns with the bucket count: the same
        # hash as the bucket id, so every write task emits exactly one file of
        # one bucket (no small files; the scan can report the sort order)
        w = w.repartition(buckets, *layout.bucket_by)
    elif layout.sort_by:
        w = w.repartitionByRange(buckets, *layout.sort_by).sortWithinPartitions(*layout.sort_by)
    writer = w.write.mode(mode).format("parquet")
    for c in layout.bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    if layout.partition_by:
        writer = writer.partitionBy(*layout.partition_by)
    if layout.bucket_by:
        if table is None:
            raise ValueError("bucketed layout needs a table name")
        writer = writer.bucketBy(buckets, *layout.bucket_by)
        if layout.sort_by:
            writer = writer.sortBy(*layout.sort_by)
        if path:
            writer = writer.option("path", path)
        writer.saveAsTable(table)
    elif table is not None:
        if path:
            writer = writer.option("path", path)
        writer.saveAsTable(table)
    else:
        writer.save(path)


def stage_tables(spark: SparkSession, t: dict[str, DataFrame], database: str,
                 buckets: int | None, root: str | None = None) -> dict[str, DataFrame]:
    """Write the canonical tables once with their layouts; return readers.

    With ``buckets``, queries over the staged tables join the order-grain
    tables bucket to bucket (no exchange); without, those tables are sorted by
    range only and their joins shuffle, where AQE can split a hot order.  That
    is the caller's choice, never the data's.  Files of sorted tables follow
    the session's shuffle partitions.
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = {}
    for name, df in t.items():
        lay = LAYOUTS.get(name, Layout())
        if lay.bucket_by and not buckets:
            lay = Layout(partition_by=lay.partition_by, sort_by=lay.sort_by, bloom=lay.bloom)
        fq = f"`{database}`.`{name}`"
        write_clustered(df, f"{root}/{name}" if root else None, table=fq,
                        layout=lay, buckets=buckets if lay.bucket_by else files)
        out[name] = spark.table(fq)
    return out


MONTH = "purchase_month"


def with_month(orders: DataFrame) -> DataFrame:
    """Orders with the month of purchase as ``yyyy-MM``; null without a date."""
    return orders.withColumn(MONTH, F.date_format("order_purchase_timestamp", "yyyy-MM"))


def write_months(orders: DataFrame, path: str, files: int | None = None) -> None:
    """L2 by month: write ``orders`` below ``path``, one folder per purchase
    month.  Months that ``orders`` holds are replaced whole, others stay as they
    are, so a late month is a write of that month's orders.

    Rows are dealt by range of (month, order): a month that holds a third of
    all orders is many files, a small one is one, sorted by ``order_id``.
    """
    files = files or int(orders.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (with_month(orders).repartitionByRange(files, MONTH, "order_id").sortWithinPartitions(MONTH, "order_id")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path))


def read_months(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The orders below ``path`` with their month, of the columns of ``like``."""
    return spark.read.schema(with_month(like).schema).parquet(path)


def bought_between(months: DataFrame, first: str, last: str) -> DataFrame:
    """Orders bought from the day ``first`` up to and with the day ``last``;
    only the folders of those months are listed and read."""
    day = F.to_date("order_purchase_timestamp")
    return months.where(F.col(MONTH).between(first[:7], last[:7])
                        & day.between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the session's shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def export_model(tables: dict[str, DataFrame], path: str) -> None:
    """Hand prepared model tables to a BI tool as Parquet folders."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")

