"""Toxicity: counterfactual-regularised classifier.

Features are indicators of a text's lower-cased words, their prefixes and the
byte groups inside them.  In the labelled texts of the fit, sentences that name a
group are written anew with another group's term of the same kind; a penalty on
the squared change of the score between a text and its counterfactual keeps
the mere mention of a group from moving the score.  The model is logistic
regression with that penalty, over features that tell the labels apart.

The fit uses at most ``max_rows`` labelled documents (a parameter).  Whole
texts are scored in the tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import slices
from .training import labelled_sample, prior

# Groups of interchangeable identity terms.
IDENTITY_TERMS = [
    ["women", "men"], ["woman", "man"], ["girls", "boys"], ["girl", "boy"], ["female", "male"],
    ["christian", "muslim", "jewish", "hindu", "buddhist", "atheist"],
    ["christians", "muslims", "jews", "hindus", "buddhists", "atheists"],
    ["black", "white", "asian", "latino", "arab"],
    ["gay", "straight", "lesbian", "bisexual", "transgender"],
    ["immigrant", "refugee", "citizen"], ["immigrants", "refugees", "citizens"],
    ["frauen", "männer"], ["frau", "mann"], ["christen", "muslime", "juden"],
    ["femmes", "hommes"], ["femme", "homme"], ["chrétiens", "musulmans", "juifs"],
    ["mujeres", "hombres"], ["mujer", "hombre"], ["cristianos", "musulmanes", "judíos"],
]

BITS = 20
SIZE = 1 << BITS
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]*")


def identity_swaps(groups: list[list[str]]) -> dict[str, str]:
    """Each term's counterfactual: the next of its group."""
    return {t: g[(i + 1) % len(g)] for g in groups for i, t in enumerate(g)}


def counterfactual(text: str, swaps: dict[str, str]) -> str | None:
    """The text with the identity terms of its sentences swapped; None where
    no sentence has one."""
    changed = False

    def swap(m: re.Match) -> str:
        nonlocal changed
        other = swaps.get(m[0].lower())
        if other is None:
            return m[0]
        changed = True
        return other.upper() if m[0].isupper() and len(m[0]) > 1 else other.capitalize() if m[0][0].isupper() else other

    def sentence(m: re.Match) -> str:
        s = m[0]
        low = s.lower()
        return _WORD.sub(swap, s) if any(t in low for t in swaps) else s

    out = _SENTENCE.sub(sentence, text)
    return out if changed else None


def word_features(word: str) -> list[int]:
    """Feature numbers of one lower-cased word: itself, its first 4 and 5
    bytes, and its groups of 5 bytes between markers of its ends."""
    b = word.encode("utf-8", "surrogatepass")
    marked = b"<" + b + b">"
    found = [crc32(marked, 1)]
    if len(b) > 5:
        found += [crc32(b[:4], 2), crc32(b[:5], 2)]
        found += [crc32(marked[i:i + 5], 3) for i in range(len(marked) - 4)]
    return [x % (SIZE - 1) + 1 for x in found]


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


class _Words(dict):
    """Word -> its features, all or those in ``kept``; remembered up to a bound."""

    def __init__(self, kept: np.ndarray | None = None):
        super().__init__()
        self.kept = None if kept is None else set(kept.tolist())

    def __missing__(self, word: str) -> list[int]:
        if len(self) > (50_000 if self.kept is None else 200_000):
            self.clear()
        f = word_features(word)
        f = self[word] = f if self.kept is None else tuple(x for x in f if x in self.kept)
        return f


def features(text: str | None, words: _Words) -> list[int]:
    found: set[int] = set()
    for w in words_of(text):
        if f := words[w]:
            found.update(f)
    return sorted(found)


class ToxicityModel:
    """Sparse weights; score = logistic of their sum over a text's features."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, bias: float):
        self.ids, self.weights, self.bias = ids, weights, bias

    def scorer(self):
        weight = dict(zip(self.ids.tolist(), self.weights.tolist()))
        words = _Words(self.ids)

        def score(text: str | None) -> float:
            z = self.bias + sum(weight[f] for f in features(text, words))
            return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))
        return score


def fit_rows(rows: list[np.ndarray], y: np.ndarray, others: list[np.ndarray | None], ones_per_zero: float = 1.0,
             max_features: int = 4000, l2: float = 0.3, swap_cost: float = 1.0, steps: int = 300) -> ToxicityModel:
    """``others[i]``: the features of row i's counterfactual, or None."""
    y = np.asarray(y, np.float64)
    if len(y) == 0 or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1)
        return ToxicityModel(np.empty(0, np.int64), np.empty(0), float(np.log(p / (1 - p))))
    n1, n0 = y.sum(), len(y) - y.sum()
    ones, zeros = np.zeros(SIZE), np.zeros(SIZE)
    for x, label in zip(rows, y):
        (ones if label else zeros)[x] += 1
    a, b = ones / n1, zeros / n0
    pooled = (ones + zeros) / len(y)
    z = (a - b) / np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / n1 + 1 / n0))
    # a sign of label 1 is far likelier there: topics and length move common features, not these
    sign = (ones >= 4) & (z > 4) & (a > 3 * b)
    order = np.argsort(-np.where(sign, z, -1), kind="stable")[:max_features]
    kept = np.sort(order[sign[order]])
    place = np.full(SIZE, -1)
    place[kept] = np.arange(len(kept))
    pick = lambda x: (p := place[x])[p >= 0]
    cols = [pick(x) for x in rows]
    own = np.repeat(np.arange(len(rows)), [len(c) for c in cols])
    col = np.concatenate(cols) if cols else np.empty(0, np.int64)
    pairs = [(c, pick(o)) for c, o in zip(cols, others) if o is not None]
    p_own = np.repeat(np.arange(len(pairs)), [len(c) + len(o) for c, o in pairs])
    p_col = np.concatenate([np.r_[c, o] for c, o in pairs]) if pairs else np.empty(0, np.int64)
    p_val = np.concatenate([np.r_[np.ones(len(c)), -np.ones(len(o))] for c, o in pairs]) if pairs else np.empty(0)
    weight = np.where(y > 0, ones_per_zero, 1.0)
    weight = weight / weight.sum()
    w, bias = np.zeros(len(kept)), float(np.log(weight[y > 0].sum() / weight[y <= 0].sum()))
    m, v = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for t in range(1, steps + 1):
        s = np.bincount(own, w[col], len(rows)) + bias
        d = weight * (1 / (1 + np.exp(-np.clip(s, -30, 30))) - y)
        g = np.bincount(col, d[own], len(kept)) + l2 / len(rows) * w
        if pairs:
            change = np.bincount(p_own, w[p_col] * p_val, len(pairs))
            g = g + 2 * swap_cost / len(pairs) * np.bincount(p_col, (change[p_own] * p_val), len(kept))
        g = np.r_[g, d.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, bias = w - step[:-1], bias - float(step[-1])
    return ToxicityModel(kept, w, bias)


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, parts: int = 5, held_out: int = 0,
                 groups: list[list[str]] = IDENTITY_TERMS) -> ToxicityModel:
    """Fit on at most ``max_rows`` labelled documents outside the held-out part."""
    swaps = identity_swaps(groups)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        kind = pa.list_(pa.int32())
        for b in (part for batch in batches for part in slices(batch, 0)):
            texts = b.column(0).to_pylist()
            other = [counterfactual(t, swaps) if t else None for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(1), pa.array([features(t, words) for t in texts], kind),
                 pa.array([None if o is None else features(o, words) for o in other], kind)], ["y", "ids", "other"])

    got = labelled_sample(docs, labels, "toxic", parts, held_out, max_rows).mapInArrow(
        extract, "y int, ids array<int>, other array<int>").toArrow()
    y = got.column("y").to_numpy()
    lists = [[None if not x.is_valid else x.values.to_numpy().astype(np.int64) for c in got.column(k).chunks for x in c]
             for k in ("ids", "other")]
    order = sorted(range(len(y)), key=lambda i: (xxhash.xxh3_64_intdigest(lists[0][i].tobytes()), y[i]))
    zeros, ones = prior(labels, "toxic", parts, held_out)
    n1, n0 = max(1, int(y.sum())), max(1, len(y) - int(y.sum()))
    return fit_rows([lists[0][i] for i in order], y[order] if len(y) else y, [lists[1][i] for i in order],
                    (max(ones, 1) / n1) / (max(zeros, 1) / n0))


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """All columns of ``docs(text, ...)`` plus ``toxicity_score``, from 0 to 1.
    Null, empty and wordless texts score by the bias alone.  An input column of
    that name is replaced."""
    docs = docs.drop("toxicity_score")
    shared = docs.sparkSession.sparkContext.broadcast((model.ids, model.weights, model.bias))   # max_features at most
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = ToxicityModel(*shared.value).scorer()
        for b in (part for batch in batches for part in slices(batch, at)):
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([score(t) for t in b.column(at).to_pylist()], pa.float64())],
                [*b.schema.names, "toxicity_score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("toxicity_score", T.DoubleType())]))
