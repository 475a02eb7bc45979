"""Exact top-k search by inner product: a ball tree per shard.

Components are scaled to integers, so scores are exact.  Rows are dealt over
shards by hash; each shard builds a ball tree and walks it for a block of
queries at once, children in the order of their upper bound of the inner
product, cutting nodes that can't beat a query's k-th result so far.  One shard
goes first: its k-th results are the bar that all other shards start from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

_NONE = np.iinfo(np.int64).max
_LEAF = 64


def scaled(x: np.ndarray, scale: int = 256) -> np.ndarray:
    return np.floor(scale * x.astype(np.float64))


class BallTree:
    """Nodes over rows sorted so that each node is a slice."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.nodes: list[tuple] = []
        self.root = self._build(0, len(ids))

    def _build(self, a: int, b: int) -> int:
        part = self.rows[a:b]
        centre = part.mean(axis=0)
        radius = float(np.sqrt(((part - centre) ** 2).sum(axis=1).max(initial=0.0)))
        at = len(self.nodes)
        self.nodes.append(None)
        children = None
        if b - a > _LEAF:
            far = part[((part - centre) ** 2).sum(axis=1).argmax()]
            other = part[((part - far) ** 2).sum(axis=1).argmax()]
            side = np.argsort(part @ (other - far), kind="stable")
            self.rows[a:b], self.ids[a:b] = part[side], self.ids[a:b][side]
            mid = (a + b) // 2
            children = self._build(a, mid), self._build(mid, b)
        self.nodes[at] = (a, b, centre, radius, int(self.ids[a:b].min()), children)
        return at

    def search(self, qids: np.ndarray, queries: np.ndarray, k: int, bar_score: np.ndarray, bar_id: np.ndarray):
        """(scores, ids), each len(queries) x k, best first; places without a
        result have score -inf.  ``bar_*``: a known k-th result per query; what
        doesn't come before or with it may be missing."""
        m = len(queries)
        best = np.full((m, k), -np.inf)
        best_id = np.full((m, k), _NONE)
        norm = np.sqrt((queries**2).sum(axis=1))

        def bound(node: int, at: np.ndarray) -> np.ndarray:
            _, _, centre, radius, _, _ = self.nodes[node]
            ub = queries[at] @ centre + norm[at] * radius
            return np.floor(ub + 1e-9 * (1 + np.abs(ub)) + 1e-6)          # scores are integers

        def visit(node: int, at: np.ndarray, ub: np.ndarray) -> None:
            a, b, _, _, low_id, children = self.nodes[node]
            kth, kth_id = best[at, -1], best_id[at, -1]
            first = (bar_score[at] > kth) | ((bar_score[at] == kth) & (bar_id[at] < kth_id))
            kth, kth_id = np.where(first, bar_score[at], kth), np.where(first, bar_id[at], kth_id)
            open_ = (ub > kth) | ((ub == kth) & (low_id <= kth_id))
            at, kth = at[open_], kth[open_]
            if not len(at):
                return
            if children is None:
                s = queries[at] @ self.rows[a:b].T
                s[qids[at][:, None] == self.ids[a:b][None, :]] = -np.inf     # a query's own row
                some = np.flatnonzero((s >= np.maximum(kth, -1e300)[:, None]).any(axis=1))
                if len(some):
                    rows = at[some]
                    score = np.concatenate([best[rows], s[some]], axis=1)
                    ids = np.concatenate([best_id[rows], np.broadcast_to(self.ids[a:b], (len(some), b - a))], axis=1)
                    top = np.lexsort((ids, -score), axis=-1)[:, :k]
                    best[rows] = np.take_along_axis(score, top, 1)
                    best_id[rows] = np.take_along_axis(ids, top, 1)
                return
            left, right = children
            ul, ur = bound(left, at), bound(right, at)
            by_left = ul >= ur
            visit(left, at[by_left], ul[by_left])
            visit(right, at, ur)
            visit(left, at[~by_left], ul[~by_left])

        if len(self.ids) and m:
            at = np.arange(m)
            visit(self.root, at, bound(self.root, at))
        return best, best_id


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = [c.flatten().to_numpy() for c in column.chunks]
    return np.concatenate([np.empty(0), *flat]).reshape(len(column), dim)


def _search(k: int):
    schema = pa.schema([("q", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(key, rows, queries):
        dim = key[0].as_py()
        qids = queries.column("q_vec_id").to_numpy()
        if not len(qids) or not rows.num_rows:
            return schema.empty_table()
        tree = BallTree(rows.column("vec_id").to_numpy().copy(), _matrix(rows.column("v"), dim))
        bar = queries.column("q_bar_score").to_numpy(zero_copy_only=False).astype(np.float64)
        bar_id = queries.column("q_bar_id").fill_null(_NONE).to_numpy()
        bar = np.where(np.isnan(bar), -np.inf, bar)
        score, ids = tree.search(qids, _matrix(queries.column("q_v"), dim), k, bar, bar_id)
        keep = np.isfinite(score)
        asked = [pa.array(np.repeat(x, k)[keep.ravel()]) for x in (queries.column("q_q").to_numpy(), qids)]
        return pa.table([*asked, pa.array(ids[keep]),
                         pa.array(score[keep].astype(np.int64))], schema=schema)
    return run


def exact_topk(rows: DataFrame, is_query, k: int = 5, vector: str = "embedding", scale: int = 256,
               shard_rows: int = 2048, query_rows: int = 50_000) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``rows(vec_id,
    <vector>)`` that ``is_query`` holds for, the k best other rows by inner
    product of ``floor(scale * x)``, ties to the smaller vec_id.

    Rows with a null vec_id, a null vector or a null or non-finite component
    take no part.  Rows of the query's own vec_id are never results.  Any other
    row counts, equal ones too: a vec_id that is there three times can take three
    places.  Query rows of equal vec_id and vector are one query; a vec_id with
    several vectors is a query for each, with k rows for each.  Vectors meet
    those of their own length only; empty ones score 0.  Scores are exact below
    2^53."""
    parts = F.col("vec_id").isNotNull() & F.col(vector).isNotNull() & F.forall(
        F.col(vector), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    v = rows.where(parts).select(
        F.col("vec_id").cast("long").alias("vec_id"), is_query.alias("is_query"), F.size(vector).alias("dim"),
        F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))
    v = written(v, "vectors")
    # a query's number is fixed by being written
    asked = written(v.where("is_query").select("vec_id", "dim", "v").distinct().withColumn("q", F.monotonically_increasing_id()), "asked")
    n, m = v.count(), asked.count()
    shards, blocks = max(2, -(-n // shard_rows)), max(1, -(-m // query_rows))
    data = (v.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)))
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    ask = asked.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int"))
    no_bar = ask.withColumns({"bar_score": F.lit(None).cast("double"), "bar_id": F.lit(None).cast("long")})
    keys = ["dim", "shard", "block"]
    out = "q long, query_id long, vec_id long, score long"

    def met(data: DataFrame, queries: DataFrame) -> DataFrame:
        asking = queries.select(*[F.col(c).alias(f"q_{c}") for c in ("q", "vec_id", "v", "bar_score", "bar_id", *keys)])
        return data.select("vec_id", "v", *keys).groupBy(*keys).cogroup(
            asking.groupBy(*[f"q_{c}" for c in keys])).applyInArrow(_search(k), out)

    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    first = written(met(data.where("shard = 0"), no_bar.withColumn("shard", F.lit(0).cast("long"))), "first_shard")
    bars = first.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select(
        "q", F.col("score").cast("double").alias("bar_score"), F.col("vec_id").alias("bar_id"))
    rest = (ask.join(bars, "q", "left")
            .withColumn("shard", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(shards - 1).cast("long")))))
    found = first.union(met(data.where("shard > 0"), rest))
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
