"""Adapter: TPC-H-like test tables -> the nine canonical marketplace tables.

The column expressions are plain SQL text understood identically by Spark and
DuckDB, so the oracle builds its canonical CTEs from the very same strings
(``marketlens.oracle.adapter_sql``).  Every table is a lazy DataFrame: only
the columns a query needs are read from Parquet.

Fixed values of the mapping (they define the test fixture):
  order status, first match: orderkey % 97 = 0 canceled; % 89 = 0 unavailable;
      o_orderstatus F delivered; O shipped; else processing
  payment type by return flag: A credit_card; N boleto; R voucher
  product category: null when p_size = 50, else p_brand
  translation: every brand but Brand#7, translated to lower case
  review score: null for event_type 'error', else 1 + floor(value) % 5
  geolocation: one point per customer whose zip % 13 <> 0
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Return flags of the line items and the payment type each
# one stands for, in payment_sequential order.
PAYMENT_TYPES = [("A", "credit_card"), ("N", "boleto"), ("R", "voucher")]

HOUR = "interval '1' hour"
DAY = "interval '1' day"

# canonical column -> SQL expression over the raw table (shared with oracle)
CUSTOMER = {
    "customer_id": "cast(c_custkey as string)",
    "customer_unique_id": "cast(c_custkey - c_custkey % 2 as string)",
    "customer_zip_code_prefix":
        "lpad(cast(c_nationkey * 10 + c_custkey % 10 as string), 5, '0')",
    "customer_city":
        "concat('city_', cast(c_nationkey as string), '_', cast(c_custkey % 5 as string))",
    "customer_state": "n_name",
}
SELLERS = {
    "seller_id": "cast(s_suppkey as string)",
    "seller_zip_code_prefix":
        "lpad(cast(s_nationkey * 10 + s_suppkey % 10 as string), 5, '0')",
    "seller_city":
        "concat('city_', cast(s_nationkey as string), '_', cast(s_suppkey % 5 as string))",
    "seller_state": "n_name",
}
PRODUCTS = {
    "product_id": "cast(p_partkey as string)",
    "product_category_name": "case when p_size = 50 then null else p_brand end",
}
ORDERS = {
    "order_id": "cast(o_orderkey as string)",
    "customer_id": "cast(o_custkey as string)",
    "order_status": ("case when o_orderkey % 97 = 0 then 'canceled' "
                     "when o_orderkey % 89 = 0 then 'unavailable' "
                     "when o_orderstatus = 'F' then 'delivered' "
                     "when o_orderstatus = 'O' then 'shipped' "
                     "else 'processing' end"),
    "order_purchase_timestamp": f"o_orderdate + {HOUR} * (o_orderkey % 24)",
    "order_approved_at": (f"case when o_orderkey % 50 = 0 then null "
                          f"else o_orderdate + {HOUR} * (o_orderkey % 24 + 1) end"),
    "order_delivered_carrier_date":
        f"case when o_orderstatus = 'P' then null else o_orderdate + {DAY} end",
    "order_delivered_customer_date": (
        f"case when o_orderstatus = 'P' then null else o_orderdate + {HOUR} * "
        f"(24 * ((o_orderkey * 7) % 41 - 2) + (o_orderkey * 5) % 24) end"),
    "order_estimated_delivery_date": f"o_orderdate + {DAY} * (20 + o_orderkey % 11)",
}
PRICE_EXPR = "cast(l_extendedprice as decimal(12,2))"
ORDER_ITEM = {
    "order_id": "cast(l_orderkey as string)",
    "order_item_id": "l_linenumber",
    "product_id": "cast(l_partkey as string)",
    "seller_id": "cast(l_suppkey as string)",
    "shipping_limit_date": "l_shipdate",
    "price": PRICE_EXPR,
    "freight_value":
        f"cast({PRICE_EXPR} * cast(l_tax as decimal(4,2)) as decimal(18,4))",
}
REVIEWS = {
    "review_id": "cast(event_id as string)",
    "order_id":
        "cast(case when event_id % 10 = 0 then event_id + 1 else event_id end as string)",
    "review_score":
        "case when event_type = 'error' then null else 1 + cast(floor(value) as int) % 5 end",
    "review_creation_date": "ts",
}
GEO_FILTER = "cast(customer_zip_code_prefix as bigint) % 13 <> 0"
GEOLOCATION = {
    "geolocation_zip_code_prefix": "customer_zip_code_prefix",
    "geolocation_lat": "-cast(cast(customer_id as bigint) % 30 as double)",
    "geolocation_lng": "-cast(cast(customer_id as bigint) % 50 as double)",
    "geolocation_city": ("case when cast(customer_id as bigint) % 4 = 0 "
                         "then upper(customer_city) else customer_city end"),
    "geolocation_state": "customer_state",
}

RAW_TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
              "lineitem", "events")


def _sel(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(e).alias(n) for n, e in cols.items()])


def read_raw(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in RAW_TABLES}


def _with_nation(df: DataFrame, nation: DataFrame, key: str) -> DataFrame:
    # nation is the fixed 25-row TPC-H dimension: broadcasting it is bounded
    nat = F.broadcast(nation.select("n_nationkey", "n_name"))
    return df.join(nat, df[key] == nat["n_nationkey"], "inner")


def payments_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """One payment per (order, return flag), numbered in flag order.

    Single shuffle: narrow rows are dealt out by order, then a pivot-style
    aggregate by order and an explode of at most three (flag, sum) pairs per
    order.  Summing before the shuffle too would hold a table of every order
    that a scan split or row group touches; a dealt partition is bounded, and
    an order of many rows takes one entry there.  Equivalent to grouping by
    (order, flag) and numbering with row_number over the order.
    """
    rows = lineitem.where(F.col("l_returnflag").isin([flag for flag, _ in PAYMENT_TYPES])).select(
        F.expr("cast(l_orderkey as string)").alias("order_id"), "l_returnflag",
        F.expr(PRICE_EXPR).alias("price")).repartition("order_id")
    per_order = rows.groupBy("order_id").agg(
        *[F.sum(F.when(F.col("l_returnflag") == flag, F.col("price"))).alias(f"v_{flag}")
          for flag, _ in PAYMENT_TYPES])
    entries = F.filter(
        F.array(*[F.struct(F.lit(ptype).alias("payment_type"),
                           F.col(f"v_{flag}").alias("payment_value"))
                  for flag, ptype in PAYMENT_TYPES]),
        lambda e: e["payment_value"].isNotNull())
    exploded = per_order.select("order_id", F.posexplode(entries).alias("pos", "p"))
    return exploded.select(
        "order_id",
        (F.col("pos") + 1).cast("int").alias("payment_sequential"),
        F.col("p.payment_type").alias("payment_type"),
        F.col("p.payment_value").cast("decimal(18,2)").alias("payment_value"))


def adapt(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    nation = raw["nation"]
    customer = _sel(_with_nation(raw["customer"], nation, "c_nationkey"), CUSTOMER)
    sellers = _sel(_with_nation(raw["supplier"], nation, "s_nationkey"), SELLERS)
    part = raw["part"]
    products = _sel(part, PRODUCTS)
    translation = (part.where("p_brand <> 'Brand#7'")
                   .select(F.col("p_brand").alias("product_category_name"),
                           F.lower("p_brand").alias("product_category_name_english"))
                   .distinct())
    orders = _sel(raw["orders"], ORDERS)
    order_item = _sel(raw["lineitem"], ORDER_ITEM)
    payments = payments_from_lineitem(raw["lineitem"])
    reviews = _sel(raw["events"], REVIEWS)
    geolocation = _sel(customer.where(GEO_FILTER), GEOLOCATION)
    return {
        "orders": orders, "customer": customer, "order_item": order_item,
        "order_payments": payments, "order_reviews": reviews,
        "products": products, "translation": translation, "sellers": sellers,
        "geolocation": geolocation,
    }
