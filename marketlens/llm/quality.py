"""Quality classifier: naive Bayes support vectors.

A document's features are indicators of hashed word 1-grams and 2-grams, and of
how often 1-grams and 2-grams of word shapes occur (in steps of a factor of
two).  Each indicator is scaled by its class log-count ratio; a linear
hinge-loss model is fitted on the scaled indicators by dual coordinate descent,
and a logistic curve turns its margin into a score.

The fit uses at most ``max_rows`` labelled documents (a parameter); scoring
reads the whole text of every document in the tasks, with two weight arrays of
fixed size broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import mix, slices
from .training import id_remainder, labelled_sample, prior

BITS = 18
SIZE = 1 << BITS
_SHAPES = 12


def shape(word: str) -> int:
    """Class of a word by letter case and what it ends with."""
    core = word if word.isalpha() else word.strip(".,;:!?\"'()[]")
    if core.isalpha():
        kind = (6 if core.islower() else 5 if core[0].isupper() and (len(core) == 1 or core[1:].islower())
                else 4 if core.isupper() else 7)
    elif not core:
        kind = 1
    else:
        kind = 2 if any(map(str.isdigit, core)) else 3
    end = word[-1]
    return 8 if end in "!?" and kind == 4 else 9 if end in ".!?" and kind == 6 else 10 if end in ".!?" and kind == 5 else kind


class WordTable(dict):
    """Word -> row of its hash and shape, remembered up to a bound."""

    def __init__(self, bound: int = 150_000):
        super().__init__()
        self.bound = bound
        self.hashes, self.shapes = np.empty(bound, np.uint64), np.empty(bound, np.int64)

    def __missing__(self, word: str) -> int:
        i = len(self)
        if i == len(self.hashes):                          # one text with more new words than the bound
            self.hashes, self.shapes = np.resize(self.hashes, 2 * i), np.resize(self.shapes, 2 * i)
        self[word] = i
        self.hashes[i] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        self.shapes[i] = shape(word)
        return i

    def rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) + len(words) > self.bound:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.hashes[at], self.shapes[at]


_STEP = np.uint64(0x9E3779B97F4A7C15)


def _levels(kinds: np.ndarray, total: int, salt: int) -> np.ndarray:
    counts = np.bincount(kinds)
    at = np.flatnonzero(counts)
    level = np.ceil(np.log2(total / counts[at])).astype(np.uint64)          # 0: nearly all, 1: half, ...
    level = np.minimum(level, np.uint64(7))
    return mix((at.astype(np.uint64) * np.uint64(64) + level) * _STEP + np.uint64(salt))


def features(text: str | None, table: WordTable) -> np.ndarray:
    """Sorted distinct feature numbers below SIZE; 0 is in every document."""
    words = (text or "").split()
    out = [np.zeros(1, np.uint64)]
    if words:
        h, s = table.rows(words)
        out += [mix(h), _levels(s, len(s), 1)]
        if len(words) > 1:
            out.append(mix(h[:-1] * _STEP + h[1:]))
            same = (h[1:] == h[:-1]).astype(np.int64)
            out += [_levels(s[:-1] * _SHAPES + s[1:], len(s), 2), _levels(same, len(s), 3)]
            distinct = len(np.unique(h))
            out.append(mix(np.array([int(np.log2(len(h) / distinct) * 2)], np.uint64) * _STEP + np.uint64(4)))
    ids = np.concatenate(out)
    ids[1:] = ids[1:] % np.uint64(SIZE - 1) + np.uint64(1)
    return np.unique(ids.astype(np.int64))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    p = np.full(SIZE, alpha)
    q = np.full(SIZE, alpha)
    for ids, label in zip(rows, y):
        (p if label else q)[ids] += 1
    r = np.log((p / p.sum()) / (q / q.sum()))
    r[0] = 1.0                                             # the constant feature carries the bias
    return r


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray,
                 epochs: int = 12, seed: int = 3) -> np.ndarray:
    """Weights of a linear hinge-loss model, by dual coordinate descent."""
    w, alpha = np.zeros(SIZE), np.zeros(len(rows))
    q = np.array([float(v @ v) for v in values])
    sign = np.where(y > 0, 1.0, -1.0)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            g = sign[i] * float(w[rows[i]] @ values[i]) - 1.0
            a = min(max(alpha[i] - g / max(q[i], 1e-12), 0.0), cost[i])
            if a != alpha[i]:
                w[rows[i]] += (a - alpha[i]) * sign[i] * values[i]
                alpha[i] = a
    return w


def logistic_curve(margin: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 400) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a m + b))) by Newton steps on weighted log loss."""
    a, b = 1.0, 0.0
    n1, n0 = weight[y > 0].sum(), weight[y <= 0].sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        d, h = weight * (p - target), weight * np.maximum(p * (1 - p), 1e-6)
        g = np.array([d @ margin, d.sum()])
        m = np.array([[h @ margin**2 + 1e-6, h @ margin], [h @ margin, h.sum() + 1e-6]])
        step = np.linalg.solve(m, g)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
        if np.abs(step).max() < 1e-7:
            break
    return max(a, 1e-3), b


class QualityModel:
    """Weights over scaled indicators, and the curve of the score."""

    def __init__(self, weights: np.ndarray, ratios: np.ndarray, a: float, b: float):
        self.weights, self.ratios, self.a, self.b = weights, ratios, a, b

    def margin(self, ids: np.ndarray) -> float:
        v = self.ratios[ids]
        return float(self.weights[ids] @ v) / max(float(np.sqrt(v @ v)), 1e-12)

    def score(self, margin):
        return 1 / (1 + np.exp(-np.clip(self.a * np.asarray(margin) + self.b, -30, 30)))


def parts_of(flat: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """``flat`` in parts of these sizes, views of it: as arrays of their own, the
    driver would keep the memory of thousands of them after they are gone."""
    ends = np.cumsum(sizes, dtype=np.int64).tolist()
    return [flat[start:end] for start, end in zip([0, *ends], ends)]


def number_lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of a column as int64 numbers."""
    lists = column.combine_chunks()
    return parts_of(lists.flatten().to_numpy().astype(np.int64), np.diff(lists.offsets.to_numpy()))


def fit_rows(rows: list[np.ndarray], y: np.ndarray, ones_per_zero: float = 1.0, cost: float = 1.0) -> QualityModel:
    """Fit on feature rows; a fifth of them only sets the curve.  With one
    label or none in the sample, every score is that label's share."""
    y = np.asarray(y, np.int64)
    if len(y) == 0 or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1)
        return QualityModel(np.zeros(SIZE), np.ones(SIZE), 1.0, float(np.log(p / (1 - p))))
    fifth = np.arange(len(y)) % 5 == 4
    fit = ~fifth if len(set(y[~fifth])) == 2 and fifth.sum() >= 20 else np.ones(len(y), bool)
    at = np.flatnonzero(fit)
    r = log_count_ratios([rows[i] for i in at], y[at])
    sizes = [len(x) for x in rows]
    values = parts_of(np.empty(sum(sizes)), sizes)
    for x, v in zip(rows, values):
        v[:] = r[x] / np.sqrt(r[x] @ r[x])
    balance = np.where(y > 0, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, (1 - y).sum())))
    w = dual_descent([rows[i] for i in at], [values[i] for i in at], y[at], cost * balance[at])
    margins = np.array([float(w[x] @ v) for x, v in zip(rows, values)])
    curve = fifth if fit.sum() < len(y) else fit
    a, b = logistic_curve(margins[curve], y[curve], np.where(y[curve] > 0, ones_per_zero, 1.0))
    return QualityModel(w, r, a, b)


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, parts: int = 3, held_out: int = 1) -> QualityModel:
    """Fit on at most ``max_rows`` labelled documents outside the held-out
    part; each label's weight in the curve follows its share of all labels."""
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable()
        for b in (part for batch in batches for part in slices(batch, 0)):
            ids = [features(t, table).astype(np.int32) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(ids, pa.list_(pa.int32()))], ["y", "ids"])

    sample = labelled_sample(docs, labels, "quality", parts, held_out, max_rows)
    got = sample.mapInArrow(extract, "y int, ids array<int>").toArrow()
    rows = number_lists(got.column("ids"))
    y = got.column("y").to_numpy()
    order = sorted(range(len(rows)), key=lambda i: (xxhash.xxh3_64_intdigest(rows[i].tobytes()), y[i]))
    zeros, ones = prior(labels, "quality", parts, held_out)
    n1 = max(1, int(y.sum()))
    n0 = max(1, len(y) - int(y.sum()))
    return fit_rows([rows[i] for i in order], y[order] if len(y) else y, (max(ones, 1) / n1) / (max(zeros, 1) / n0))


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """All columns of ``docs(text, ...)`` plus ``quality_score``, from 0 to 1.
    Null and empty texts score by the constant feature alone.  An input column
    of that name is replaced."""
    docs = docs.drop("quality_score")
    shared = docs.sparkSession.sparkContext.broadcast(
        (model.weights.astype(np.float32), model.ratios.astype(np.float32), model.a, model.b))
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("quality_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, r, a, b = shared.value
        own = QualityModel(w.astype(np.float64), r.astype(np.float64), a, b)
        table = WordTable()
        for batch in (part for whole in batches for part in slices(whole, at)):
            margins = [own.margin(features(t, table)) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.asarray(own.score(margins), np.float64).reshape(-1))],
                [*batch.schema.names, "quality_score"])

    return docs.mapInArrow(run, schema)


def held_out_column(parts: int, held_out: int):
    return F.coalesce(id_remainder(F.col("doc_id"), parts) == held_out, F.lit(False))
