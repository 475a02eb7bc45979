"""Whitening against a dense eigendecomposition, with exact sums in Python."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from marketlens.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, components=8, kind=np.float32):
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * float(kind(c))) + 100_000 for c in v] for _, v in kept]
    n, d = len(x), len(x[0])
    s = [sum(v[j] for v in x) for j in range(d)]
    away = [sum((n * v[j] - s[j]) ** 2 for j in range(d)) for v in x]
    a = np.array([[(n * v[j] - s[j]) / n for j in range(d)] for v in x])
    value, onto = np.linalg.eigh(a.T @ a / n)
    value, onto = value[::-1][:components], onto[:, ::-1][:, :components]
    return kept, n, away, a @ onto, value, np.trace(a.T @ a / n)


def check(spark, rows, rank, schema=SCHEMA):
    out = whitening.whiten(spark.createDataFrame(rows, schema))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = out.collect()
    kept, n, away, along, value, trace = brute([r[:2] for r in rows], kind=np.float64 if "double" in schema else np.float32)
    rank = min(rank, 8)
    assert len(got) == len(kept) * rank
    assert {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1
    assert got[0]["identity_error"] < 1e-8
    key = lambda t: (t[0] is None, t[0] or 0, t[1])      # noqa: E731
    for c in range(rank):
        mine = sorted([(r["vec_id"], r["deviation"], r["whitened"]) for r in got if r["component"] == c + 1], key=key)
        z = along[:, c] / math.sqrt(value[c])
        want = sorted([(i, w, v) for (i, _), w, v in zip(kept, away, z)], key=key)
        assert [m[:2] for m in mine] == [w[:2] for w in want]
        sign = np.sign(sum(m[2] * w[2] for m, w in zip(mine, want)))
        assert np.allclose([sign * m[2] for m in mine], [w[2] for w in want], atol=1e-7)
        assert all(r["explained"] == pytest.approx(value[c] / trace, rel=1e-9) for r in got if r["component"] == c + 1)
    return got


def vectors(seed, n, scales):
    rng = np.random.default_rng(seed)
    turn = np.linalg.qr(rng.normal(size=(len(scales), len(scales))))[0]
    return [(i, [float(c) for c in row]) for i, row in enumerate((rng.normal(size=(n, len(scales))) * scales) @ turn)]


def test_against_dense_eigenvectors(spark):
    rows = vectors(1, 700, [8, 5, 3, 2, 1.4, 1, 0.7, 0.5, 0.3, 0.1])
    check(spark, rows, 10)
    check(spark, rows + rows[:50] + [(None, rows[0][1])], 10)           # rows and ids that repeat, a null id


def test_wide_range_of_spreads(spark):
    check(spark, vectors(2, 90, [3e3, 2e2, 10, 1, 0.2, 0.05]), 6, "vec_id long, embedding array<double>")


def test_factors_of_a_condition_beyond_a_squared_double(spark):
    rng = np.random.default_rng(4)
    turn = np.linalg.qr(rng.normal(size=(4, 4)))[0]
    spread = np.array([1e13, 1e10, 1e7, 1e5])
    x = np.rint((rng.normal(size=(500, 4)) * spread) @ turn).astype(np.int64)
    frame = spark.createDataFrame([(row.tolist(),) for row in x], "x array<long>")
    mean = x.mean(axis=0)
    r, rank = whitening.shifted_cholesky_qr(frame, mean)
    assert rank == 4
    assert np.allclose(np.linalg.svd(r)[1] / np.linalg.svd(x - mean)[1], 1, rtol=1e-6)


def test_rows_that_span_less(spark):
    rng = random.Random(3)
    rows = []
    for i in range(200):
        a, b = rng.randrange(-512, 512) / 64, rng.randrange(-64, 64) / 64
        rows.append((i, [a, b, a, 0.25, a + b]))
    check(spark, rows, 2)
    check(spark, [(1, [0.5, 2.0]), (2, [0.75, 2.0])], 1)


def test_dropped_rows_and_no_variance(spark):
    bad = [(90, None), (91, []), (92, [1.0, None]), (93, [float("nan"), 1.0]), (94, [1.0, float("inf")]), (95, [-float("inf"), 0.0])]
    check(spark, [(i, [math.sin(i), math.cos(3 * i)]) for i in range(40)] + bad, 2)
    of = lambda rows: whitening.whiten(spark.createDataFrame(rows, SCHEMA))          # noqa: E731
    assert of([]).collect() == of(bad).collect() == of([(1, [2.0, 3.0])] * 5).collect() == []
    assert of([]).columns == of([(1, [2.0]), (2, [4.0])]).columns
    with pytest.raises(ValueError):
        of([(1, [1.0]), (2, [1.0, 2.0])])


def test_deviation_beyond_fast_sums(spark):
    rows = [(i, [43_000.0 * (i % 3 - 1), float(i % 7)]) for i in range(60)]
    got = check(spark, rows, 2, "vec_id long, embedding array<double>")
    assert max(r["deviation"] for r in got) > 2**62


def test_other_columns(spark):
    rows = [(i, [math.sin(i), math.cos(3 * i)], "s", i, 0.5) for i in range(30)]
    check(spark, rows, 2, SCHEMA + ", component string, n int, whitened double")
