"""Share operators.

One-row results are combined by *stacking then aggregating* (union of tagged
rows + one conditional aggregate), never by joining one-row frames: no
Cartesian product appears in any plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.columns import pct, ratio


def share_of_top_n(df: DataFrame, value: str, n: int, order: Sequence[Column],
                   extra: Sequence[str] = ()) -> DataFrame:
    """O3: sums of ``value`` (and ``extra`` columns) over the first ``n`` rows
    by ``order`` and over all rows, in one row:

    ``top_<c>`` and ``all_<c>`` for ``c`` in ``[value, *extra]``.
    The top-n rows come from a distributed top-k (no global window); the
    totals and the top sums are one aggregate over the stacked rows.
    """
    cols = [value, *extra]
    top = df.orderBy(*order).limit(n).select(*cols, F.lit(True).alias("_top"))
    every = df.select(*cols, F.lit(False).alias("_top"))
    stacked = every.unionByName(top)
    aggs = []
    for c in cols:
        aggs.append(F.sum(F.when(F.col("_top"), F.col(c))).alias(f"top_{c}"))
        aggs.append(F.sum(F.when(~F.col("_top"), F.col(c))).alias(f"all_{c}"))
    return stacked.agg(*aggs)


def conditional_share(df: DataFrame, predicate: Column, by: Sequence[str] = (),
                      total: str = "total", hits: str = "hits", misses: str | None = None,
                      hit_pct: str | None = None, miss_pct: str | None = None) -> DataFrame:
    """Per group (or globally) row count, rows meeting ``predicate``,
    optionally rows failing it, and both shares in percent (null on 0 rows).

    A null predicate counts in neither hits nor misses, like CASE WHEN.
    """
    hit = F.sum(F.when(predicate, F.lit(1)).otherwise(F.lit(0)))
    miss = F.sum(F.when(~predicate, F.lit(1)).otherwise(F.lit(0)))
    g = df.groupBy(*by) if by else df.groupBy()
    out = g.agg(F.count(F.lit(1)).alias(total), hit.cast("bigint").alias(hits),
                miss.cast("bigint").alias("_miss"))
    sel = [*[F.col(b) for b in by], F.col(total), F.col(hits)]
    if misses:
        sel.append(F.col("_miss").alias(misses))
    if hit_pct:
        sel.append(pct(hits, total).alias(hit_pct))
    if miss_pct:
        sel.append(pct("_miss", total).alias(miss_pct))
    return out.select(*sel)


def period_growth(df: DataFrame, periods: Sequence[str], value: str,
                  prev: str = "prev", growth: str = "growth_pct") -> DataFrame:
    """Previous period's value (lag 1 over the period order) and growth
    in percent; null when the previous value is null or 0.

    Input is already aggregated to one row per period (months, years), a
    calendar-bounded row count, so the ordered window is small.
    """
    w = Window.orderBy(*[F.col(p).asc_nulls_first() for p in periods])
    out = df.withColumn(prev, F.lag(F.col(value), 1).over(w))
    return out.withColumn(growth, ratio(F.col(value) - F.col(prev), F.col(prev), 100.0))
