"""Top-n and ranking operators (O4, O5, O6) that never funnel a whole table
through one task.

* ``top_n``           – ``orderBy(...).limit(n)``: TakeOrderedAndProject keeps
                        n rows per partition, so the final merge sees
                        ``n * partitions`` rows at most.
* ``top_n_ranked``    – row_number / dense_rank of the top n rows.  Every row
                        ranked strictly better than a top-n row is itself in
                        the top n, so ranking the n survivors is exact.
* ``top_n_per_group`` – partitioned window with a rank filter; Spark plans a
                        WindowGroupLimit before the shuffle, so each group
                        sends at most n rows per map partition.
* ``rank_by``         – rank / dense rank of every row.  Ranks the distinct
                        values in range partitions with one offset each, then
                        joins back: no global single-partition window.  Its
                        ``row_number`` is ``row_numbers``.
* ``row_numbers``     – number of every row in a total order: rows are dealt by
                        range of the whole order, so one tied value is split
                        too; one shuffle and one offset per range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.session import materialize

OrderSpec = Sequence[Column | str]


def _cols(spec: OrderSpec) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in spec]


def top_n(df: DataFrame, order: OrderSpec, n: int) -> DataFrame:
    """First ``n`` rows by ``order`` (include a unique tie-breaker)."""
    return df.orderBy(*_cols(order)).limit(n)


def top_n_ranked(df: DataFrame, rank_order: OrderSpec, tie_breakers: OrderSpec, n: int,
                 method: str = "row_number", rank_col: str = "rank") -> DataFrame:
    """O6 for a top-n report: the first ``n`` rows and their global rank.

    ``rank_order`` is the window order of the source query; ``tie_breakers``
    make the cut deterministic.  The window runs over n rows only.
    """
    top = df.orderBy(*_cols(rank_order), *_cols(tie_breakers)).limit(n)
    if method == "row_number":
        fn = F.row_number().over(Window.orderBy(*_cols(rank_order), *_cols(tie_breakers)))
    elif method == "dense_rank":
        fn = F.dense_rank().over(Window.orderBy(*_cols(rank_order)))
    elif method == "rank":
        fn = F.rank().over(Window.orderBy(*_cols(rank_order)))
    else:
        raise ValueError(method)
    return top.withColumn(rank_col, fn.cast("int"))


def top_n_per_group(df: DataFrame, group: Sequence[str], order: OrderSpec, n: int,
                    rank_col: str | None = None) -> DataFrame:
    """First ``n`` rows of every group (row_number <= n)."""
    rn = F.row_number().over(Window.partitionBy(*group).orderBy(*_cols(order)))
    out = df.withColumn("_rn", rn).where(F.col("_rn") <= n)
    return out.withColumnRenamed("_rn", rank_col) if rank_col else out.drop("_rn")


def _offsets(placed: DataFrame, weight: Column) -> DataFrame:
    """(_bin, _off): per range partition the weight of those before it.  One
    row per partition, so the window is as small as the partitions are few."""
    before = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    return placed.groupBy("_bin").agg(F.sum(weight).alias("_n")).select(
        "_bin", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))


def row_numbers(df: DataFrame, order: OrderSpec, rank_col: str = "rank",
                bins: int | None = None) -> DataFrame:
    """SQL ``row_number() over (order by ...)`` of every row, as a bigint.

    Rows are range-partitioned by all of ``order`` and sorted, numbered from
    the partition's start, written once to the shared folder, and moved by the
    number of rows before their partition.  ``order`` should be total: rows
    equal in it keep together and are numbered in any order, as in SQL.  An
    input column of the name ``rank_col`` is replaced.
    """
    bins = bins or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = _cols(order)
    in_partition = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = materialize(df.repartitionByRange(bins, *cols).sortWithinPartitions(*cols)
                         .withColumns({"_bin": F.spark_partition_id(), "_pos": in_partition}))
    off = F.broadcast(_offsets(placed, F.lit(1)))        # at most ``bins`` rows
    return placed.join(off, "_bin").withColumn(rank_col, F.col("_off") + F.col("_pos") + 1).drop(
        "_bin", "_pos", "_off")


def rank_by(df: DataFrame, value: str, method: str = "dense_rank", ascending: bool = True,
            rank_col: str = "rank", bins: int | None = None,
            tie_breakers: OrderSpec = ()) -> DataFrame:
    """O6 over all rows: SQL ``dense_rank`` or ``rank`` of non-null ``value``,
    or ``row_number`` by value and ``tie_breakers``, as a bigint, without a
    global single-partition window; one path for every size.

    ``row_number`` numbers rows with a null value too, first when ascending,
    last when not; see ``row_numbers``.  The other two:

    1. distinct values with their row counts (partial aggregation: a value
       holding a third of all rows is still one row here);
    2. range partitioning of the values, each with its partition's number,
       written once to the shared folder (the bounds are drawn once);
    3. inside each partition ``row_number`` (dense rank) or a running row count
       (rank), plus the sum over the partitions before it: one row each;
    4. join back on the value.
    ``value`` must be deterministic (computed from exact sums) for the join
    back; rows with a null value get a null rank.  ``bins`` is the number of
    range partitions, by default the session's shuffle partitions.
    """
    if method == "row_number":
        first = F.col(value).asc_nulls_first() if ascending else F.col(value).desc_nulls_last()
        return row_numbers(df, [first, *tie_breakers], rank_col, bins)
    if method not in ("dense_rank", "rank"):
        raise ValueError(method)
    bins = bins or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("_v").asc() if ascending else F.col("_v").desc()
    vals = (df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v"))
            .agg(F.count(F.lit(1)).alias("_c")))
    placed = materialize(vals.repartitionByRange(bins, order).withColumn("_bin", F.spark_partition_id()))
    weight = F.lit(1) if method == "dense_rank" else F.col("_c")
    offsets = _offsets(placed, weight)
    within = Window.partitionBy("_bin").orderBy(order)
    if method == "dense_rank":
        pos = F.row_number().over(within)
    else:  # rows with a strictly better value, plus one
        pos = F.sum("_c").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_c") + 1
    ranked = placed.withColumn("_pos", pos).join(offsets, "_bin").select(
        "_v", (F.col("_off") + F.col("_pos")).cast("bigint").alias(rank_col))
    return df.join(ranked, df[value] == ranked["_v"], "left").drop("_v")


def dense_rank_all(df: DataFrame, value: str, ascending: bool = True,
                   rank_col: str = "rank", bins: int | None = None) -> DataFrame:
    """Dense rank of every row (``rank_by`` with ``method="dense_rank"``)."""
    return rank_by(df, value, "dense_rank", ascending, rank_col, bins)
