"""Setup checks (V1-V7): key checks and the validation queries.

The source declares six primary keys and ten foreign keys and then runs four
validation queries by hand; here each becomes a query whose expected result
is known (empty for a sound table), so tests can assert it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.operators.quality import fk_violations, pk_violations
from marketlens.operators.ranking import top_n
from marketlens.plans.grain import items_enriched
from marketlens.schema import FOREIGN_KEYS, PRIMARY_KEYS
from marketlens.sources.ingest import with_zip

T = dict[str, DataFrame]


def pk_check(t: T, table: str) -> DataFrame:
    """V1 for one table: null or duplicate key values."""
    return pk_violations(with_zip(t)[table], PRIMARY_KEYS[table])


def fk_check(t: T, relation: str) -> DataFrame:
    """V2 for one relation: child values without parent."""
    child, fk, parent, pk = FOREIGN_KEYS[relation]
    tt = with_zip(t)
    return fk_violations(tt[child], fk, tt[parent], pk)


def count_orders(t: T) -> DataFrame:
    """V3: number of orders."""
    return t["orders"].agg(F.count(F.lit(1)).alias("orders"))


def sample_customers(t: T, n: int = 10) -> DataFrame:
    """V4: n customers (any n are valid; ordered by id for a stable answer)."""
    return top_n(t["customer"], [F.asc("customer_id")], n)


def distinct_status(t: T) -> DataFrame:
    """V5: the order status codes present."""
    return t["orders"].select("order_status").distinct()


def orphan_orders(t: T) -> DataFrame:
    """V6: orders whose customer_id is NOT IN the customer ids (expected empty).

    NOT IN is null-aware: one null customer id empties the result, and a
    null order customer only passes when there are no customers at all.
    The per-key part is an anti join (no broadcast of a large table); the two
    facts about all ids are one scalar subquery.
    """
    o = t["orders"]
    ids = t["customer"].select(F.col("customer_id").alias("_cid"))
    facts = ids.agg(F.struct(F.count(F.lit(1)).alias("n"), F.count("_cid").alias("named")).alias("f")).scalar()
    missing = o.join(ids, o["customer_id"] == F.col("_cid"), "left_anti")
    none, whole = facts["n"] == 0, facts["n"] == facts["named"]
    return missing.where(none | (F.col("customer_id").isNotNull() & whole))


def null_seller_audit(t: T) -> DataFrame:
    """V7: orders of the order-detail view without a seller, with the
    (trivial) dense rank of the audit query."""
    o = t["orders"].select("order_id")
    it = items_enriched(t, product=False).select("order_id", "seller_id")
    rows = o.join(it, "order_id", "left").where(F.col("seller_id").isNull())
    g = rows.groupBy("seller_id").agg(F.countDistinct("order_id").alias("orders"))
    return g.select("seller_id", "orders", F.lit(1).alias("rank"))
