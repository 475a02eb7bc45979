"""Key and reference checks (V1, V2) replacing enforced constraints.

Both are aggregate-first: the child column is reduced to (value, count)
with map-side partial aggregation before any join, so a value that holds a
third of all rows costs one partial row per map task, not a hot join key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pk_violations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """V1: key values that are null or not unique -> (key, n, reason).

    ``key`` is the key columns joined with '|' (null when any part is null).
    """
    key = F.concat_ws("|", *cols) if len(cols) > 1 else F.col(cols[0]).cast("string")
    any_null = F.greatest(*[F.col(c).isNull() for c in cols]) if len(cols) > 1 \
        else F.col(cols[0]).isNull()
    counted = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    bad = counted.where((F.col("n") > 1) | any_null)
    return bad.select(
        F.when(~any_null, key).alias("key"),
        F.col("n"),
        F.when(any_null, F.lit("null")).otherwise(F.lit("duplicate")).alias("reason"))


def fk_violations(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """V2: non-null child values without a parent -> (value, n).

    A null child value passes, as with a declared foreign key.
    """
    counted = (child.where(F.col(fk).isNotNull())
               .groupBy(F.col(fk).alias("value")).agg(F.count(F.lit(1)).alias("n")))
    keys = parent.select(F.col(pk).alias("value"))
    return counted.join(keys, "value", "left_anti")


def key_report(tables: Mapping[str, DataFrame], primary: Mapping[str, Sequence[str]],
               foreign: Mapping[str, tuple[str, str, str, str]],
               derived: Mapping[str, str] | None = None) -> DataFrame:
    """Every declared key in one pass -> (kind, name, bad_values, bad_rows).

    Each table is read once and gives one row per key column: the referred key
    it belongs to, the part it plays there (0 the parent, from 1 on a
    child) and the value.  One aggregate by (key, value), partial on the map
    side, holds what all checks of that value need: a parent that is null or
    there twice, a child that has no parent.  A second one over 16 names sums
    the verdicts.  Null child values pass.  ``derived`` maps a parent that has no
    table of its own to the table whose column holds its values: each counts
    once there and null not at all.  Keys of several columns raise.
    """
    derived = derived or {}
    wide = [t for t, cols in primary.items() if len(cols) > 1]
    if wide:
        raise ValueError(f"keys of several columns: {', '.join(wide)}")
    parts: dict[tuple[str, str], list[tuple[str, str] | None]] = {}
    for table, (key,) in primary.items():
        parts[table, key] = [("primary_key", table)]
    for name, (_, _, parent, key) in foreign.items():
        parts.setdefault((parent, key), [None]).append(("foreign_key", name))
    roles: dict[str, list[tuple[int, int, str]]] = {}
    for no, (table, key) in enumerate(parts):
        roles.setdefault(derived.get(table, table), []).append((no, 0, key))
        for part, of in enumerate(parts[table, key]):
            if part:
                child, col, _, _ = foreign[of[1]]
                roles.setdefault(child, []).append((no, part, col))

    def stream(table: str) -> DataFrame:
        one = [F.struct(F.lit(no).alias("no"), F.lit(part).alias("part"),
                        F.col(col).cast("string").alias("value")) for no, part, col in roles[table]]
        return tables[table].select(F.explode(F.array(*one)).alias("r")).select("r.*").where(
            "part = 0 or value is not null")

    slots = max(map(len, parts.values()))
    counted = reduce(DataFrame.unionByName, map(stream, roles)).groupBy("no", "value").agg(
        *[F.count_if(F.col("part") == i).alias(f"n{i}") for i in range(slots)])
    once = [no for no, (table, _) in enumerate(parts) if table in derived]
    counted = counted.withColumn("n0", F.when(F.col("no").isin(once), F.when(F.col("value").isNull(), 0)
                                              .otherwise(F.least("n0", F.lit(1)))).otherwise(F.col("n0")))

    def verdict(no: int, part: int):
        bad = (F.col("n0") > 1) | (F.col("value").isNull() & (F.col("n0") > 0)) if part == 0 \
            else (F.col("n0") == 0) & (F.col(f"n{part}") > 0)
        return (F.col("no") == no) & bad, F.col(f"n{part}")

    names = [(no, part, of) for no, key in enumerate(parts) for part, of in enumerate(parts[key]) if of]
    verdicts = [F.when(bad, F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), n.alias("n")))
                for no, part, (kind, name) in names for bad, n in [verdict(no, part)]]
    bad = counted.select(F.explode(F.array_compact(F.array(*verdicts))).alias("v")).select("v.*")
    every = tables[next(iter(roles))].sparkSession.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.lit(0).cast("bigint").alias("n"))
        for _, _, (kind, name) in names])).alias("v")).select("v.*")
    return bad.union(every).groupBy("kind", "name").agg(
        F.count_if(F.col("n") > 0).alias("bad_values"), F.sum("n").alias("bad_rows"))


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """M11 for any frame: a row (column_name, rows, nulls) per column of
    ``cols`` (all by default), from one aggregate."""
    cols = list(cols or df.columns)
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"_{i}") for i, c in enumerate(cols)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("_rows").alias("rows"), F.col(f"_{i}").alias("nulls"))
                                          for i, c in enumerate(cols)])).alias("r")).select("r.*")
