"""Embedding whitening by shifted CholeskyQR.

The centred rows A of all vectors are orthogonalised by passes over the table.
Each pass sums the Gram matrix of the rows so far, A applied to the inverses of
the triangular factors found before, and factors it; the first time, and
whenever the matrix is not safely positive, with a shift of the diagonal, so
that no direction is lost to rounding.  The factors' product R has A = Q R with
Q as good as orthonormal, so R's singular vectors and values are A's: they give
the components and scales, never squaring A's condition.

Per task a Gram matrix is summed over blocks of rows centred before they are
multiplied; Spark sums these matrices cell by cell.  Only matrices of the
vectors' width squared reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices, written

_BLOCK = 4096
_EPS = float(np.finfo(np.float64).eps)


def _rows_of(part: pa.RecordBatch, column: int) -> np.ndarray:
    lists = part.column(column)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for part in (p for b in batches for p in slices(b, column)):
        for at in range(0, part.num_rows, _BLOCK):
            block = part.slice(at, _BLOCK)
            yield block, _rows_of(block, column)


def _solved(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """``rows`` times the inverse of each upper triangular factor in turn."""
    for r in factors:
        rows = np.linalg.solve(r.T, rows.T).T
    return rows


def _totals(x: DataFrame) -> list:
    """Per entry the exact sum, the least and the greatest number, and the count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = low = high = None
        n = 0
        for _, rows in _blocks(batches, 0):
            small = np.abs(rows).max() < 2 ** 50          # a block's sum is below 2^62
            part = np.array((rows if small else rows.astype(object)).sum(axis=0).tolist(), object)
            s = part if s is None else s + part
            low = rows.min(axis=0) if low is None else np.minimum(low, rows.min(axis=0))
            high = rows.max(axis=0) if high is None else np.maximum(high, rows.max(axis=0))
            n += len(rows)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(s)), pa.int32()), pa.array([Decimal(t) for t in s.tolist()], pa.decimal128(38, 0)),
                 pa.array(low), pa.array(high), pa.array([n] * len(s), pa.int64())], ["i", "s", "low", "high", "n"])

    return (x.mapInArrow(run, "i int, s decimal(38,0), low long, high long, n long").groupBy("i")
            .agg(F.sum("s").alias("s"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
            .orderBy("i").collect())


def gram(x: DataFrame, of) -> np.ndarray:
    """Sum over all rows ``v`` of ``x(x)`` of the outer products of ``of(v)``,
    with one more column of ones: its cells hold the sums and the count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, rows in _blocks(batches, 0):
            rows = of(rows)
            rows = np.hstack([rows, np.ones((len(rows), 1))])
            total = rows.T @ rows if total is None else total + rows.T @ rows
        if total is not None:
            at = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(total[at])],
                                             ["i", "j", "v"])

    cells = x.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    width = cells["i"].max() + 1
    out = np.zeros((width, width))
    out[cells["i"], cells["j"]] = out[cells["j"], cells["i"]] = cells["v"]
    return out


def shifted_cholesky_qr(x: DataFrame, mean: np.ndarray, max_passes: int = 12) -> tuple[np.ndarray, int]:
    """(R, rank) of the centred rows A of ``x``: ``A = Q R``, R with ``rank`` rows.

    Passes end when Q's Gram matrix is the identity but for rounding, or, where
    rows span less than all dimensions, a projector: its eigenvalues are all
    near 1 or near 0.  Directions with a spread of less than about 1e-9 of the
    widest one's are the latter."""
    dim, factors = len(mean), []
    for _ in range(max_passes):
        done = list(factors)
        g = gram(x, lambda rows: _solved(rows - mean, done))[:dim, :dim]
        low, axes = np.linalg.eigh(g)
        if factors and ((np.abs(low - 1) < 1e-6) | (np.abs(low) < 1e-9)).all():
            break
        scale = max(low[-1], np.finfo(np.float64).tiny)
        shift = 11 * (_BLOCK + dim + 1) * dim * _EPS * scale
        if factors and low[0] > shift:
            shift = 0.0
        factors.append(np.linalg.cholesky(g + shift * np.eye(dim)).T)
    spanned = low > 0.5
    return (np.sqrt(low[spanned])[:, None] * axes[:, spanned].T) @ reduce(lambda r, f: f @ r, factors), int(spanned.sum())


def whiten(rows: DataFrame, vector: str = "embedding", components: int = 8, scale: int = 1024, offset: int = 100_000) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error)
    for each vector of ``rows(vec_id, <vector>)`` and principal component.

    An entry c becomes the whole number ``floor(scale c) + offset``.  Rows whose
    vector is null, empty or holds a null or non-finite entry are dropped; the
    rest must have one length (ValueError else), entries of less than 2^52 /
    ``scale``, and are all fitted, equal rows
    and ids as often as they occur.  Components fall by eigenvalue; those
    without any variance have no whitened value and no row.  With no row, or no
    variance at all, there is no result row.  A deviation that a long can't hold
    is an error."""
    spark = rows.sparkSession
    whole = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(
        F.col(vector), lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    x = written(rows.where(whole).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * scale) + offset).alias("x")), "vectors")
    schema = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    lengths = x.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if lengths[0] is None:
        return spark.createDataFrame([], schema)
    if lengths[0] != lengths[1]:
        raise ValueError(f"vectors of {lengths[0]} to {lengths[1]} entries")
    per = _totals(x.select("x"))
    n, dim, total = int(per[0]["n"]), len(per), [int(r["s"]) for r in per]
    widest = max(max(abs(n * r["low"] - t), abs(n * r["high"] - t)) for r, t in zip(per, total))
    mean = np.array([float(s // n) + float(s % n) / n for s in total])

    if not widest:
        return spark.createDataFrame([], schema)
    r, rank = shifted_cholesky_qr(x.select("x"), mean)
    _, sigma, vt = np.linalg.svd(r)
    take = min(components, rank)
    value = sigma ** 2 / n
    explained = value[:take] / value.sum()
    onto = vt[:take].T / np.sqrt(value[:take])

    g = gram(x.select("x"), lambda v: (v - mean) @ onto)
    covariance = g[:take, :take] / n - np.outer(g[:take, take], g[:take, take]) / n ** 2
    error = float(np.abs(covariance - np.eye(take)).max())
    small = dim * widest ** 2 < 2 ** 63

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, v in _blocks(batches, 1):
            whole = v if small else v.astype(object)
            away = n * whole - np.array(total, np.int64 if small else object)
            deviation = pa.array((away * away).sum(axis=1).tolist(), pa.int64())
            m = len(v)
            one = np.repeat(np.arange(m), take)
            yield pa.RecordBatch.from_arrays(
                [block.column(0).take(pa.array(one)), pa.array(np.tile(np.arange(1, take + 1), m), pa.int32()),
                 pa.array(np.full(m * take, n), pa.int64()), deviation.take(pa.array(one)),
                 pa.array(((v - mean) @ onto).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * take, error))],
                [c.split()[0] for c in schema.split(", ")])

    return x.mapInArrow(run, schema)
