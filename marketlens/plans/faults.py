"""Damaged copies of the given tables, on which every key check finds rows.

The damage follows the key's last character, so Spark and the oracle agree on
it.  Fixed values: the character's code modulo 10 is 1, the row is there twice;
2, its key is null; 3, the row is missing.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.plans.pipeline import constraint_report
from marketlens.plans.validation import fk_check, pk_check
from marketlens.schema import FOREIGN_KEYS, PRIMARY_KEYS
from marketlens.sources.ingest import with_zip

T = dict[str, DataFrame]

TWICE, NULL, MISSING = 1, 2, 3


def code(key: str) -> str:
    return f"coalesce(ascii(right({key}, 1)) % 10, 0)"


def damaged(df: DataFrame, key: str) -> DataFrame:
    marked = df.withColumn("_code", F.expr(code(key))).where(F.col("_code") != MISSING)
    copies = marked.withColumn("_copy", F.explode(F.when(F.col("_code") == TWICE, F.array(F.lit(1), F.lit(2)))
                                                  .otherwise(F.array(F.lit(1)))))
    return copies.withColumn(key, F.when(F.col("_code") != NULL, F.col(key))).select(*df.columns)


def with_faults(t: T) -> T:
    """The tables with damaged parents: children of missing ones are orphans."""
    whole = with_zip(t)
    return {**whole, **{name: damaged(whole[name], key) for name, (key,) in PRIMARY_KEYS.items()}}


def damaged_pk(t: T, table: str) -> DataFrame:
    return pk_check(with_faults(t), table)


def damaged_fk(t: T, relation: str) -> DataFrame:
    return fk_check(with_faults(t), relation)


def damaged_report(t: T) -> DataFrame:
    return constraint_report(with_faults(t))


QUERIES = {
    **{f"damaged_pk_{table}": partial(damaged_pk, table=table) for table in PRIMARY_KEYS},
    **{f"damaged_fk_{relation}": partial(damaged_fk, relation=relation) for relation in FOREIGN_KEYS},
    "damaged_constraint_report": damaged_report,
}
