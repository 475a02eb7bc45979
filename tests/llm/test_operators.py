"""Corpus operators against brute force on small hand-made tables: nulls, empty
and very long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.llm import (decontaminate, licenses, line_dedup, mixing, ngram_join, quality, shared, token_scan, topk,
                            toxicity, warc)

DOCS = "doc_id long, text string"


def docs_of(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


# ------------------------------------------------------------------ shared

def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 300) if i % 37] + [(1000, x) for x in range(2000, 2400)]
    edges += [(rng.randrange(5000, 5200), rng.randrange(5000, 5200)) for _ in range(120)] + [(7, 7)]
    rng.shuffle(edges)
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r[0]: r[1] for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in got}
    assert set(got) == {x for a, b in edges if a != b for x in (a, b)}
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hash_filter(spark):
    keys = list(range(0, 50_000, 7)) + [-5, 2**62]
    bits = shared.hash_filter(spark.createDataFrame([(k,) for k in keys] + [(None,)], "k long"))
    assert bits.nbytes == 1 << (shared.FILTER_BITS - 3)
    assert shared.may_hold(bits, np.array(keys)).all()
    assert shared.may_hold(bits, np.arange(10**9, 10**9 + 10_000)).mean() < 0.01


def test_filter_size_follows_the_keys_up_to_its_bound(spark, monkeypatch):
    keys = [k * 7919 - 10**6 for k in range(20_000)]
    small = shared.hash_filter(spark.createDataFrame([(k,) for k in keys] + [(None,)], "k long"), shared.filter_bits(len(keys)))
    assert small.nbytes == 1 << 18
    assert shared.may_hold(small, np.array(keys)).all()
    assert shared.may_hold(small, np.arange(10**9, 10**9 + 10_000)).mean() < 0.01
    assert shared.filter_bits(0) == 20 and shared.filter_bits(2**21) == shared.filter_bits(10**12) == shared.FILTER_BITS
    # what the driver gathers and sends out for a few rows is small too
    made = []

    def sized(*args):
        made.append(shared.hash_filter(*args))
        return made[-1]

    monkeypatch.setattr(ngram_join, "hash_filter", sized)
    monkeypatch.setattr(decontaminate, "hash_filter", sized)
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, "another one"), (4, None)], "doc_id long, text string")
    assert {r[0]: r[2] for r in ngram_join.jaccard_components(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    items = spark.createDataFrame([(9, text)], "item_id long, text string")
    assert [r[0] for r in decontaminate.drop_contaminated(docs, items).orderBy("doc_id").collect()] == [3, 4]
    assert len(made) == 4 and all(x.nbytes < 1 << 20 for x in made)


def test_fit_rows_lie_in_one_array():
    import pyarrow as pa
    lists = [[0, 5, 7], [], [0], [1, 2]]
    column = pa.chunked_array([pa.array(lists[:1], pa.list_(pa.int32())), pa.array([[3], *lists[1:]], pa.list_(pa.int32())).slice(1)])
    got = quality.number_lists(column)
    assert [x.tolist() for x in got] == lists and all(x.dtype == np.int64 for x in got)
    assert len({id(x.base) for x in got}) == 1 and got[0].base is not None
    assert quality.number_lists(pa.chunked_array([], pa.list_(pa.int32()))) == []


# --------------------------------------------------------- 1 n-gram join

def brute_components(rows, percent, n=5):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j:j + n]) for j in range(max(1, len(w) - n + 1))} if w else set()
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("limits", [{}, {"block_sets": 8, "rounds": 0}, {"block_sets": 8, "rounds": 1, "percent": 60},
                                    {"block_sets": 5, "rounds": 2}])
def test_ngram_join(spark, limits):
    rng = random.Random(5)
    base = [f"w{rng.randrange(50)}" for _ in range(60)]
    rows = []
    for i in range(120):                                   # a group of near copies, larger than a block
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            w[rng.randrange(60)] = f"e{rng.randrange(1000)}"
        rows.append((i, " ".join(w)))
    for i in range(200, 260):                              # share a passage, but aren't near copies
        rows.append((i, " ".join(base[:45] + [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(3, 14))])))
    rows += [(900, None), (901, ""), (902, "a b"), (903, "A  B"), (904, "x"), (905, " \n\t"), (906, "é É"), (907, "É é")]
    rows.append((908, " ".join(f"long{i}" for i in range(30_000))))
    rows.append((909, rows[-1][1] + " end"))
    got = {r[0]: (r[1], r[2]) for r in ngram_join.jaccard_components(docs_of(spark, rows), **limits).collect()}
    assert got == brute_components(rows, limits.get("percent", 80))


def test_ngram_join_sends_small_batches(spark):
    """Every Python worker and its task hold a batch or two outside the heap."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key)
    try:
        spark.conf.set(key, str(64 << 20))
        assert ngram_join.jaccard_components(docs_of(spark, [(1, "a b"), (2, "A  B")])).count() == 2
        assert int(spark.conf.get(key)) <= 2 << 20
    finally:
        spark.conf.set(key, old)


def test_ngram_join_remembers_few_words():
    known = ngram_join.WordHashes()
    for i in range(120_000):
        known[b"w%d" % i]
        assert len(known) <= 50_000


def test_ngram_join_of_shared_sentences(spark, monkeypatch):
    """Sets of one n-gram meet, not all that hang together over others: what is
    walked grows with the documents, not with their square."""
    dealt = {}
    for n in (150, 600):
        rng = random.Random(9)
        pool = [" ".join(f"s{p}w{i}" for i in range(9)) for p in range(n)]
        rows = [(d, " ".join(rng.sample(pool, 8))) for d in range(n)]
        rows += [(1000 + d, rows[d][1] + " and more") for d in range(0, n, 10)]
        sizes = []
        keep = ngram_join.written
        monkeypatch.setattr(ngram_join, "written", lambda df, name, keep=keep, sizes=sizes: (
            sizes.append((name, out.count())) or out if (out := keep(df, name)) is not None and name == "probes" else out))
        got = {r[0]: (r[1], r[2]) for r in ngram_join.jaccard_components(docs_of(spark, rows), block_sets=16).collect()}
        monkeypatch.setattr(ngram_join, "written", keep)
        dealt[n] = sum(c for _, c in sizes)
        if n == 150:
            assert got == brute_components(rows, 80)
        assert all(got[1000 + d][1] == d for d in range(0, n, 10))
    assert dealt[600] < 8 * max(dealt[150], 1)


def test_ngram_join_odd_rows(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (None, "a b c d e f", "z"), (2, "a b c d e f", None)]
    got = ngram_join.jaccard_components(docs_of(spark, rows, DOCS + ", component_id string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in got) == [
        (0, 2, None), (1, 2, 1), (1, 2, 1), (2, 2, 1)]
    assert ngram_join.jaccard_components(docs_of(spark, [])).count() == 0


def test_walk_compares_by_threshold():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 14, rng.integers(1, 12))) for _ in range(60)]
    freq = np.bincount(np.concatenate(sets), minlength=14)
    ordered = [s[np.lexsort((s, freq[s]))] for s in sets]
    links = ngram_join.walk(ordered, [freq[s] for s in ordered], [len(s) for s in sets], list(range(60)), 70)
    up = list(range(60))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    for a, b in links:
        assert 100 * len(set(sets[a]) & set(sets[b])) >= 70 * len(set(sets[a]) | set(sets[b]))
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    for a in range(60):
        for b in range(a):
            if 100 * len(set(sets[a]) & set(sets[b])) >= 70 * len(set(sets[a]) | set(sets[b])):
                assert find(a) == find(b)


# --------------------------------------------------------- 2 token counts

def test_token_counts(spark):
    rows = [(1, "hello world"), (2, None), (3, ""), (4, "é" * 500), (5, "word " * 20_000), (1, "hello world"), (None, "x y")]
    enc = token_scan.load_encoder(token_scan.TOKENIZER)
    want = sorted((i or 0, len(enc.encode_ordinary(t or ""))) for i, t in rows)
    for block in (64, 1 << 22):                            # documents spanning many blocks, and none
        got = token_scan.token_counts(docs_of(spark, rows).repartition(3), block_bytes=block).collect()
        assert sorted((r[0] or 0, r[1]) for r in got) == want
    assert token_scan.token_counts(docs_of(spark, [])).count() == 0


def test_separator_scan_of_a_foreign_file(spark, tmp_path):
    ids = np.array([9, 0, 5, 6, 7, 0, 0, 3, 4], "<u4")
    ids.tofile(tmp_path / "a.bin")
    np.array([0, 0], "<u4").tofile(tmp_path / "b.bin")
    (tmp_path / "c.bin").write_bytes(b"")
    files = spark.createDataFrame([(f"{tmp_path}/{n}.bin", s) for n, s in (("a", ids.nbytes), ("b", 8), ("c", 0))],
                                  "file string, bytes long")
    got = sorted((r[0][-5], r[1], r[2]) for r in token_scan.scan_separators(files, 0, "<u4", block_bytes=8).collect())
    assert got == [("a", 0, 1), ("a", 1, 3), ("a", 2, 0), ("a", 3, 2), ("b", 0, 0), ("b", 1, 0)]


# --------------------------------------------------------- 3 line dedup

def test_line_dedup(spark):
    rows = [(i, f"Common Line\nown {i}\n\n  COMMON line\t\nrare {i % 6}\né{i}") for i in range(12)]
    rows += [(50, None), (51, ""), (52, "common line"), (53, "\n\n"), (54, "x\ny"), (54, "x\ny"), (None, "common line\nz")]
    frame = docs_of(spark, [(*r, "k") for r in rows], DOCS + ", kept string")
    keys = [[x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)}) for x in (t or "").split("\n")]
            for _, t in rows]
    for least, fanout in ((10, 2), (3, 3)):
        found = {}
        for ks in keys:
            for k in set(ks) - {""}:
                found[k] = found.get(k, 0) + 1
        want = []
        for (i, t), ks in zip(rows, keys):
            stay = [x for x, k in zip((t or "").split("\n"), ks) if found.get(k, 0) < least]
            want.append((-1 if i is None else i, len(ks), len(ks) - len(stay), "\n".join(stay)))
        got = line_dedup.drop_frequent_lines(frame, least, batches=5, fanout=fanout)
        assert got.columns == ["doc_id", "text", "n_lines", "n_dropped", "kept"]
        assert sorted((-1 if r[0] is None else r[0], *r[2:]) for r in got.collect()) == sorted(want)
    assert line_dedup.drop_frequent_lines(docs_of(spark, [])).count() == 0


def test_line_runs_settle(spark):
    runs = line_dedup.LineRuns(spark, limit=3, fanout=2, buckets=2)
    for batch in ([("a", 2), ("b", 1)], [("a", 1), ("c", 1)], [("a", 9), ("b", 1)], [("b", 1)]):
        runs.add(spark.createDataFrame([(k.encode(), n) for k, n in batch], "key binary, n long"))
    assert sorted(bytes(r[0]) for r in runs.settled[0].select("key").collect()) == [b"a", b"b"]
    assert sorted(bytes(r[0]) for r in runs.frequent().collect()) == [b"a", b"b"]


# --------------------------------------------------------- 4 and 7 classifiers

def labelled(spark, n=400):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randrange(20, 80))]
        bad, toxic = i % 4 == 0, i % 5 == 0
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["idiotic", "scummy"])
        if i % 3 == 0:
            w[rng.randrange(len(w))] = rng.choice(["women", "men"])
        docs.append((i, (" ".join(w).upper().replace(" ", "!! ") if bad else " ".join(w).capitalize() + ".")))
        labels.append((i, 0 if bad else 1, int(toxic)))
    docs += [(n, None), (n + 1, ""), (n + 2, "...")]
    labels += [(n, None, None), (None, 1, 1), (10**9, 1, 0)]
    return docs_of(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


@pytest.mark.parametrize("fit, score, column, at", [
    (quality.fit_quality, quality.score_quality, "quality_score", 1),
    (toxicity.fit_toxicity, toxicity.score_toxicity, "toxicity_score", 2)])
def test_classifiers(spark, fit, score, column, at):
    docs, labels, rows = labelled(spark)
    model = fit(docs, labels)
    held = {r[0]: r[1] for r in docs.select("doc_id", quality.held_out_column(5 if at == 2 else 3, 0 if at == 2 else 1)).collect()}
    got = {r["doc_id"]: r[column] for r in score(docs.withColumn(column, F.lit("old")), model).collect()}
    assert len(got) == 403 and all(0 <= s <= 1 for s in got.values())
    want = {r[0]: r[at] for r in rows if r[0] is not None and r[0] < 400 and held[r[0]]}
    assert len(want) > 40
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, y in want.items()]) > 0.95
    assert score(docs.limit(0), model).count() == 0
    one_label = fit(docs, labels.where("quality = 1 and toxic = 1"))
    assert all(0 <= r[0] <= 1 for r in score(docs, one_label).select(column).collect())
    assert 0 <= score(docs, fit(docs, labels.limit(0))).first()[column] <= 1


def test_counterfactual_penalty_frees_identity_terms():
    swaps = toxicity.identity_swaps([["women", "men"]])
    assert toxicity.counterfactual("Women left. WOMEN and men.", swaps) == "Men left. MEN and women."
    assert toxicity.counterfactual("Nobody left.", swaps) is None
    rng = random.Random(4)
    words, rows, y, others = toxicity._Words(), [], [], []
    for i in range(400):
        toxic = i % 2
        text = " ".join(f"w{rng.randrange(40)}x" for _ in range(8)) + (" idiotic" if toxic else "")
        if rng.random() < (0.6 if toxic else 0.1):         # the sample names one group mostly in toxic texts
            text += " women"
        other = toxicity.counterfactual(text, swaps)
        rows.append(np.array(toxicity.features(text, words)))
        others.append(None if other is None else np.array(toxicity.features(other, words)))
        y.append(toxic)
    plain = toxicity.fit_rows(rows, np.array(y), others, swap_cost=0.0).scorer()
    fair = toxicity.fit_rows(rows, np.array(y), others, swap_cost=20.0).scorer()
    change = lambda f: abs(f("the women spoke") - f("the men spoke"))
    assert change(fair) < 0.25 * change(plain) and change(fair) < 0.02
    assert fair("an idiotic thing") > 0.5 > fair("the women spoke")


def test_log_count_ratio_and_dual_descent():
    rows = [np.array([0, 5]), np.array([0, 5, 9]), np.array([0, 7]), np.array([0, 7, 9])]
    y = np.array([1, 1, 0, 0])
    r = quality.log_count_ratios(rows, y)
    assert r[5] > 0 > r[7] and abs(r[9]) < 1e-9 and r[5] == pytest.approx(np.log(3))
    values = [r[x] / np.sqrt(r[x] @ r[x]) for x in rows]
    w = quality.dual_descent(rows, values, y, np.full(4, 1.0), epochs=200)
    margins = np.array([w[x] @ v for x, v in zip(rows, values)])
    assert (np.sign(margins) == np.where(y > 0, 1, -1)).all()
    # primal and dual values meet at the optimum of 0.5 |w|^2 + sum of hinge losses
    primal = 0.5 * w @ w + np.maximum(0, 1 - np.where(y > 0, 1, -1) * margins).sum()
    nearby = [0.5 * (w + d) @ (w + d) + np.maximum(0, 1 - np.where(y > 0, 1, -1) * np.array(
        [(w + d)[x] @ v for x, v in zip(rows, values)])).sum()
        for s in (0.05, -0.05) for f in (0, 5, 7, 9) for d in [np.where(np.arange(quality.SIZE) == f, s, 0.0)]]
    assert primal <= min(nearby) + 1e-6


# --------------------------------------------------------- 5 mixing

def test_period_keeps_every_share_within_one_block():
    for shares in ({"a": 1}, {"a": 3, "b": 2, "c": 1}, {"a": 7, "b": 7, "c": 1, "d": 5}, {f"s{i}": i + 1 for i in range(9)}):
        total, plan = sum(shares.values()), mixing.period(shares)
        assert len(plan) == total
        for t in range(1, total + 1):
            for s, a in shares.items():
                assert abs(sum(x == s for x, _ in plan[:t]) - a * t / total) < 1


def test_mix_sources(spark):
    rng = random.Random(6)
    rows = [(i, "x" * rng.randrange(0, 60), rng.choice(["a", "a", "a", "b", "c", None]), "old") for i in range(600)]
    rows += [(601, None, "b", "old"), (602, "y" * 5000, "c", "old"), (603, "z", "a", "o"), (603, "z", "a", "o")]
    docs = docs_of(spark, rows, DOCS + ", source string, slot string")
    shares = {"a": 3, "b": 2}
    out = mixing.mix_sources(docs, shares, other_share=1, block_chars=200, buckets=8).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in out) == sorted((r[0], r[1] or "") for r in rows)
    by = {}
    for r in out:
        assert r["mix_class"] == (r["source"] if r["source"] in shares else "*")
        by.setdefault(r["mix_class"], []).append((r["offset"], len(r["text"] or ""), r["block"], r["slot"]))
    slots = {}
    for s, placed in by.items():
        placed.sort()
        at = 0
        for offset, size, block, slot in placed:
            assert offset == at or (size == 0 and offset <= at) and block == offset // 200
            at = max(at, offset + size)
            assert slots.setdefault(slot, (s, block)) == (s, block)           # one block fills a slot
    # brute force: earliest deadline first over whole phases, block by block
    blocks = {s: max(o for o, *_ in p) for s, p in by.items()}
    totals = {s: sum(x[1] for x in p) // 200 + 1 for s, p in by.items()}
    assert all(blocks[s] // 200 < totals[s] for s in blocks)
    plan = mixing.schedule({**shares, "*": 1}, totals)
    for s, phase, start, end, slot0, a, total, at in plan:
        for i in range(end - start):
            t = slot0 + i // a * total + at[i % a]
            if t in slots:
                assert slots[t] == (s, start + i)
    first = [x for x in plan if x[1] == 0]
    length = min(x[4] for x in plan if x[1] == 1)
    for s, _, start, end, _, a, total, at in first:                           # all sources active: share kept to a block
        taken = sorted(i // a * total + at[i % a] for i in range(end - start))
        for t in range(1, length + 1):
            assert abs(sum(x < t for x in taken) - a * t / total) < 1
    assert mixing.mix_sources(docs.limit(0), shares).count() == 0


def pfair(shares, blocks):
    """Slot by slot: of the sources whose next block is released, the one with the earliest deadline; when a source has
    given its last block, the others begin anew."""
    out, left, done = [], {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0)
    while left:
        total, taken, t = sum(shares[s] for s in left), dict.fromkeys(left, 0), 0
        while all(left.values()):
            due = {s: -((taken[s] + 1) * total // -shares[s]) for s in left if taken[s] * total // shares[s] <= t}
            s = min(due, key=lambda s: (due[s], s))
            out.append((s, done[s]))
            taken[s], done[s], left[s], t = taken[s] + 1, done[s] + 1, left[s] - 1, t + 1
        left = {s: n for s, n in left.items() if n}
    return out


def test_mix_against_a_schedule_made_slot_by_slot(spark):
    rng = random.Random(16)
    shares, other = {"a": 5, "b": 3, "c": 2, "d": 1}, 2
    rows = [(i, "x" * rng.randrange(0, 80), rng.choice(["a", "a", "b", "c", "d", "zz", None])) for i in range(900)]
    docs = docs_of(spark, rows, DOCS + ", source string")
    blocks = {}
    for _, t, s in rows:
        s = s if s in shares else "*"
        blocks[s] = blocks.get(s, 0) + len(t)
    want = pfair({**shares, "*": other}, {s: n // 100 + 1 for s, n in blocks.items()})
    out = mixing.mix_sources(docs, shares, other, block_chars=100, bucket_chars=700).collect()
    assert len(out) == 900 and {(r["mix_class"], r["block"]) for r in out} == {want[r["slot"]] for r in out}
    assert all(want[r["slot"]] == (r["mix_class"], r["block"]) for r in out)
    for bad in ({"a": 0}, {"a": -1}):
        with pytest.raises(ValueError, match="a"):
            mixing.mix_sources(docs, bad)


def test_training_rows_stay_within_their_bound(spark):
    from marketlens.llm.training import labelled_sample
    docs = docs_of(spark, [(i % 4, f"text {i}") for i in range(400)] + [(5, None)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)] * 2 + [(None, 1), (2, None)], "doc_id long, toxic int")
    rows = labelled_sample(docs, labels, "toxic", 5, 9, 6).collect()
    assert sorted((r["text"] or "", r["y"]) for r in rows) == [("", 1), ("text 0", 0), ("text 1", 1), ("text 10", 0), ("text 103", 1)]


# --------------------------------------------------------- 6 decontamination

ITEM = "In spring Tom bought 12 apples and 7 pears for 30 dollars then gave 5 apples to Anna before the market closed at noon"


def test_decontamination(spark):
    changed = ITEM.replace("Tom", "Maria").replace("Anna", "Lee").replace("12", "1,250").replace("30", "4.5").replace("dollars", "euros")
    muddled = "In spring Tom bought 12 apples and 12 pears for 12 dollars then gave 12 apples to Tom before the market closed at noon"
    filler = " ".join(f"plain{i} words{i} only{i}." for i in range(300))
    rows = [(1, f"Intro words. {ITEM}. More text."), (2, filler + "\n" + changed + "\n" + filler), (3, muddled), (4, filler),
            (5, None), (6, ""), (7, " ".join(ITEM.split()[:9])), (8, "Two words here"), (9, "short item only"),
            (10, ITEM.lower()), (10, ITEM.lower()), (None, ITEM)]
    bench = spark.createDataFrame([(100, ITEM, 1), (101, "short item only", 2), (102, None, 3), (103, "", 4), (104, "Hi", 5),
                                   (None, ITEM, 6)], "item_id long, text string, doc_id int")
    docs = docs_of(spark, rows)
    hits = decontaminate.contaminated(docs, bench).collect()
    found = {(r["doc_id"], r["item_id"]): r for r in hits}
    assert set(found) == {(1, 100), (2, 100), (9, 101), (10, 100), (None, 100)}
    assert found[1, 100]["same_slots"] and found[1, 100]["consistency"] == 1.0
    assert not found[2, 100]["same_slots"] and found[2, 100]["consistency"] == 1.0 and found[2, 100]["cover"] > 0.9
    left = {r[0] for r in decontaminate.drop_contaminated(docs.where("doc_id is not null"), bench).select("doc_id").collect()}
    assert {3, 4, 5, 6, 7, 8} <= left and not left & {1, 2, 9}
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0


def _covers(spark, items, texts):
    """Cover by (doc, item) where document i is ``texts[i]`` within other words."""
    docs = docs_of(spark, [(i, f"Some words before it.\n{t}\nand other words after") for i, t in enumerate(texts)])
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r["cover"] for r in decontaminate.contaminated(docs, bench).collect()}


def test_decontamination_of_items_dense_in_numbers(spark):
    items = ["Alice Smith paid 3 dollars 20 cents", "Convert 5 feet 11 inches to cm", "Find the next term: 2 3 5 8 13 21 34",
             "Add 2 hours 45 minutes 10 seconds and 3 hours 20 minutes 55 seconds."]
    other = ["Add 7 hours 5 minutes 1 seconds or 9 days 2 minutes 5 seconds.", "12 13 14 15 16 17 18 19 20 21 22 23"]
    assert _covers(spark, items, items + other) == {(i, i): 1.0 for i in range(4)}


def test_decontamination_of_items_in_title_case(spark):
    items = ["The Old Man And The Sea Nobel Prize", "Martin Luther King Junior Memorial Library", "War And Peace"]
    assert _covers(spark, items, items + ["The Old Man", "Peace And War"]) == {(i, i): 1.0 for i in range(3)}


def test_decontamination_in_other_case_and_without_punctuation(spark):
    items = ["Welche Stadt ist die Hauptstadt der Schweiz und liegt am Fluss Aare, nicht an der Hauptstraße?",
             "Don't stop. Tom, the baker's son, said: Anna went to Rome. Then Eve left Paris!", ITEM]
    bare = [re.sub(r"[^\w\s]", "", t) for t in items]
    for texts in ([t.lower() for t in items], [t.upper() for t in items], [t.title() for t in items], bare, [t.lower() for t in bare]):
        assert _covers(spark, items, texts) == {(i, i): 1.0 for i in range(3)}


# --------------------------------------------------------- 8 licences

def test_license_scan(spark):
    text = dict((n, t) for n, t in reversed(licenses.TEMPLATES))
    wrapped = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 200).replace("without restriction", "without\nrestriction")
    rows = [(1, "Intro\nlicensed under the APACHE license -- version 2.0\nbody"), (2, "Licensed under CC BY-NC 4.0."), (3, None),
            (4, ""), (5, "word " * 5000), (6, "x\n\n" + wrapped + "\n\ny"), (7, "MIT"), (2, "Licensed under CC BY-NC 4.0."),
            (8, "This is licensed under nothing at all, and no version of it."), (None, "Released under the MIT License.")]
    got = {(r["doc_id"], r["license"]): r for r in licenses.scan_licenses(docs_of(spark, rows)).collect()}

    def grams(t):
        w = re.findall(r"[^\W_]+", t.lower())
        return set(zip(w, w[1:]))
    want = {}
    for i, t in rows:
        parts = (t or "").split("\n") + [p for p in re.split(r"\n[ \t\r]*\n", t or "") if "\n" in p.strip(" ")]
        for p in parts:
            for name, body in licenses.TEMPLATES:
                a, b = grams(p), grams(body)
                if a and b and 200 * len(a & b) >= 80 * (len(a) + len(b)):
                    want[i, name] = max(want.get((i, name), 0), 2 * len(a & b) / (len(a) + len(b)))
    assert {k: r["dice"] for k, r in got.items()} == pytest.approx(want)
    assert {(1, "Apache-2.0"), (2, "CC-BY-NC-4.0"), (6, "MIT"), (None, "MIT")} <= set(want) and text
    assert licenses.scan_licenses(docs_of(spark, [])).count() == 0
    assert licenses.scan_licenses(docs_of(spark, rows), []).count() == 0


def test_license_scan_of_notices_within_other_text(spark):
    long = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 200)
    bsd = next(t for n, t in licenses.TEMPLATES if n == "BSD-3-Clause" and len(t) > 100)
    block = lambda mark, t: "\n".join([mark] + [f"{mark} {' '.join(t.split()[i:i + 9])}" for i in range(0, len(t.split()), 9)] + [mark])
    filler = " ".join(f"Some{i} other{i} words of a page that nobody{i} has licensed." for i in range(40))
    rows = [(1, f"{filler} Released under the MIT License. Contact us for details, please. {filler}"),
            (2, block("#", "Copyright 2020 by the authors of this file") + "\n" + block("#", long) + "\n#\n" + block("#", filler)),
            (3, f"/*\n{block(' *', bsd)}\n * \n{block(' *', filler)}\n */"), (4, filler),
            (5, f"Released under the MIT License.\n\n{filler} Licensed under the MIT License. {filler}"),
            (None, f"{filler} Licensed under CC BY-NC 4.0. {filler}")]
    rows += rows[:1]
    got = {(r["doc_id"], r["license"]): (r["n_units"], r["dice"]) for r in licenses.scan_licenses(docs_of(spark, rows)).collect()}
    assert got == {(1, "MIT"): (1, 1.0), (2, "MIT"): (1, 1.0), (3, "BSD-3-Clause"): (1, 1.0), (5, "MIT"): (2, 1.0),
                   (None, "CC-BY-NC-4.0"): (1, 1.0)}


# --------------------------------------------------------- 9 WARC

def test_warc_round_trip(spark, tmp_path):
    page = ('<html><head><title>A &amp; B</title><style>p{}</style></head><body><!-- no --><p>One <b>two</b></p>'
            '<a href="/x?a=1&amp;b=2">go</a><script>var t="</p>";</script><a href=\'y\'>y</a> <a href=y>again</a> 3 &lt; 4</body>')
    rows = [(1, "http://e.org/d/", page), (2, None, None), (3, "http://[bad", "no tags\r\n\r\nhere"), (4, "u", "<p>" * 50_000),
            (1, "http://e.org/d/", page)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, block string")
    sources = warc.page_responses(pages).drop("page_id")
    made = warc.build_derivatives(sources)
    source = {r["record_id"]: r for r in sources.collect()}
    out = made.collect()
    assert len(out) == 10 and len({r["record_id"] for r in out}) == 8
    for r in out:
        s = source[r["refers_to"]]
        assert (r["payload_digest"], r["headers"], r["target_uri"], r["date"]) == (
            s["payload_digest"], s["headers"], s["target_uri"], s["date"])
        assert r["block_digest"] == warc.sha1(bytes(r["block"]))
    facts = next(json.loads(bytes(r["block"])) for r in out if r["warc_type"] == "metadata" and r["target_uri"] == "http://e.org/d/")
    assert facts["title"] == "A & B" and facts["links"] == ["http://e.org/x?a=1&b=2", "http://e.org/d/y"]
    assert facts["headers"][0] == ["Content-Type", "text/html; charset=utf-8"]
    text = next(bytes(r["block"]).decode() for r in out if r["warc_type"] == "conversion" and r["target_uri"] == "http://e.org/d/")
    assert text == "A & B\nOne two\ngo y again 3 < 4"
    everything = sources.union(made)
    back = warc.read_warc(spark, warc.write_warc(everything, f"{tmp_path}/warc")).collect()
    key = lambda r: (r["record_id"], r["warc_type"])
    names = ["record_id", "warc_type", "refers_to", "target_uri", "date", "content_type", "block_digest", "payload_digest", "block"]
    assert [[r[n] for n in names] for r in sorted(back, key=key)] == [[r[n] for n in names] for r in sorted(everything.collect(), key=key)]
    again = warc.build_derivatives(spark.createDataFrame(back, sources.schema)).collect()
    assert sorted((r["record_id"], r["block_digest"]) for r in again) == sorted((r["record_id"], r["block_digest"]) for r in out)
    assert warc.build_derivatives(sources.limit(0)).count() == 0


# --------------------------------------------------------- 10 exact top-k

def test_exact_topk(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(700)] + [(i, [0.5] * 6) for i in range(700, 900)]
    rows += [(1000, None), (1001, [None] * 6), (1002, [float("nan")] * 6), (1003, [float("inf")] * 6), (None, [0.1] * 6),
             (1050, []), (1051, []), (1100, [1.0, 2.0]), (1101, [0.5, -2.0])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    ok = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows
          if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, a in ok:
        if q % 50 == 0:
            best = sorted((-int(a @ b), i) for i, b in ok if i != q and len(a) == len(b))[:5]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    for shard_rows, query_rows in ((100, 7), (10_000, 50_000)):
        got = topk.exact_topk(frame, F.col("vec_id") % 50 == 0, 5, shard_rows=shard_rows, query_rows=query_rows)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert topk.exact_topk(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("percent", [50, 67, 80, 95, 100])
def test_no_licence_match_without_an_anchor_word(percent):
    sets = []
    for _, body in licenses.TEMPLATES:
        w = body.lower().split()
        sets.append(sorted({f"{a} {b}" for a, b in zip(w, w[1:])}))
    sets.append(["a b"])
    for grams in sets:
        rare = set(licenses.anchors([grams], percent))
        without = sum(not rare & set(g.split(" ")) for g in grams)
        # all bigrams without an anchor, and nothing else: the best a text without one can reach
        assert 200 * without < percent * (without + len(grams))


def test_topk_with_repeated_rows(spark, tmp_path):
    from marketlens.llm.queries import ORACLE_SQL, op10_exact_topk
    rng = random.Random(8)
    vector = lambda: [rng.randrange(-512, 512) / 256 for _ in range(4)]      # noqa: E731
    hot, rows = [2.0] * 4, [(50, [1.0] * 4)] * 3 + [(100, vector()), (100, vector())]
    rows += [(1, hot)] * 6 + [(i, hot) for i in range(2, 7)] + [(i, vector()) for i in range(7, 160) if i != 50]
    rows += [(7, hot), (None, hot), (8, None), (9, [1.0, None, 0.0, 0.0]), (150, [float("nan")] * 4), (200, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    first = [tuple(r) for r in topk.exact_topk(frame, F.col("vec_id") == 50, 5, shard_rows=20).orderBy("rank").collect()]
    assert [r[2] for r in first] == [1] * 5
    few = frame.where("vec_id <> 1 or vec_id is null").union(frame.where("vec_id = 1").limit(2))
    assert [r[2] for r in topk.exact_topk(few, F.col("vec_id") == 50, 5, shard_rows=20).orderBy("rank").collect()] == [1, 1, 2, 3, 4]
    import duckdb
    frame.write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = [tuple(r) for r in op10_exact_topk(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect()]
    want = c.sql(ORACLE_SQL["op10_exact_topk"]).project("query_id, rank, vec_id, score").fetchall()
    assert sorted(got) == sorted(want) and len(got) == 5 * (1 + 3 + 1)       # 50 once, 100 with three vectors, 150


def test_line_dedup_counts_rows_as_its_sql_does(spark, tmp_path):
    import duckdb

    from marketlens.llm.queries import ORACLE_SQL, op3_line_dedup
    rows = [(i // 2, f"again and again\nown {i}") for i in range(11)] + [(90, "again and again"), (90, "again and again"), (91, None)]
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = [tuple(r) for r in op3_line_dedup(spark, str(tmp_path)).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()]
    assert sorted(got) == sorted(c.sql(ORACLE_SQL["op3_line_dedup"]).fetchall()) and len(got) == 14
    assert sum(r[2] for r in got) == 13


def test_line_dedup_of_a_long_text_with_many_frequent_lines(spark):
    lines = [f"line {i}" for i in range(3000)]
    rows = [(d, "\n".join(lines)) for d in range(9)] + [(9, "\n".join(lines * 8 + ["its own"])), (10, "line 7\nline 8 \nother")]
    out = {r["doc_id"]: r for r in line_dedup.drop_frequent_lines(docs_of(spark, rows), 10).collect()}
    assert (out[9]["n_lines"], out[9]["n_dropped"], out[9]["kept"]) == (24_001, 24_000, "its own")
    assert (out[10]["n_dropped"], out[10]["kept"]) == (2, "other") and out[3]["kept"] == ""


def test_a_long_run_of_a_long_item_is_found(spark):
    words = [f"w{i}x" for i in range(400)]
    item, other = " ".join(words), " ".join(f"filler{i}q" for i in range(60))
    docs = docs_of(spark, [(1, f"{other} {' '.join(words[100:300])} {other}"), (2, f"{other} {' '.join(words[100:140])} {other}"),
                           (3, " ".join(f"{w} {o}" for w, o in zip(words, other.split() * 7)))])
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()} == {(1, 7)}
    runs = decontaminate._longest_run
    assert (runs([]), runs([(0, 5), (5, 9), (11, 12)]), runs([(3, 8), (0, 4), (2, 3)])) == (0, 9, 8)


def test_windows_of_several_sizes_are_those_of_each():
    rng = np.random.default_rng(3)
    codes, value = rng.integers(0, 2**63, (2, 40), dtype=np.uint64)
    slot = rng.random(40) < 0.5
    for at, (several, size) in enumerate(zip(decontaminate.windows(codes, slot, value, [3, 4, 5]), (3, 4, 5))):
        assert (several == next(decontaminate.windows(codes, slot, value, [size]))).all() and len(several) == 41 - size
    assert [len(h) for h in decontaminate.windows(codes[:2], slot[:2], value[:2], [1, 2, 3])] == [2, 1, 0]


@pytest.mark.parametrize("page", ["<a " * 350_000, "<title>" * 150_000, "<script " * 130_000, "<p " * 350_000, "<title " * 150_000,
                                  "<a href=\"" * 110_000, "<a href='" * 110_000 + "\"", "<!--" * 250_000, "</script   " * 90_000,
                                  "<script></scr" * 80_000, "<a href = x " * 80_000, "<a" + " " * 1_000_000])
def test_hostile_pages_take_time_in_proportion(page):
    import time
    t = time.perf_counter()
    warc.page_facts(page, "http://a.b/c")
    warc.plain_text(page)
    assert time.perf_counter() - t < 5


def _response(headers, body):
    return {"block": b"HTTP/1.1 200 OK\r\n" + headers + b"\r\n\r\n" + body, "target_uri": "http://a.b/c", "record_id": "<r>",
            "date": None, "payload_digest": None, "headers": "{}"}


def test_encoded_payloads():
    import gzip
    import zlib
    page = "<title>Größe</title><p>Ein schöner Tag</p><a href='x'>y</a>"
    latin, utf = page.encode("latin-1"), page.encode()
    chunks = b"".join(b"%x;q=1\r\n%b\r\n" % (len(c), c) for c in (utf[:9], utf[9:])) + b"0\r\n\r\n"
    raw = zlib.compressobj(wbits=-15)
    for headers, body in ((b"Content-Type: text/html; charset=ISO-8859-1", latin), (b"Content-Encoding: gzip", gzip.compress(utf)),
                          (b"Content-Encoding: deflate", zlib.compress(utf)), (b"Content-Encoding: deflate", raw.compress(utf) + raw.flush()),
                          (b"Transfer-Encoding: chunked", chunks),
                          (b"transfer-encoding: chunked\r\nX-A: 1\r\nX-A: 2\r\nCONTENT-ENCODING: gzip", b"%x\r\n%b\r\n0\r\n\r\n" % (
                              len(gzip.compress(utf)), gzip.compress(utf))),
                          (b"A: b", b"<meta charset='latin1'>" + latin), (b"Content-Type: text/html; charset=none-such", utf)):
        facts, text = warc.derivatives(_response(headers, body))
        assert text["block"].decode() == "Größe\nEin schöner Tag\ny", headers
        assert json.loads(facts["block"])["title"] == "Größe" and facts["payload_digest"] == warc.sha1(body)
    for headers, body in ((b"Content-Encoding: gzip", b"no gzip"), (b"Transfer-Encoding: chunked", b"zz\r\nabc"), (b"Content-Encoding: br", b"plain")):
        assert warc.derivatives(_response(headers, body))[1]["block"] == body.strip().replace(b"\r\n", b"\n")
    assert json.loads(warc.derivatives(_response(b"X-A: 1\r\nX-A: 2", b""))[0]["block"])["headers"] == [["X-A", "1"], ["X-A", "2"]]


def test_line_ends_stay_out_of_record_headers():
    row = {c: None for c in warc._COLUMNS} | {"warc_type": "response", "record_id": "<r>", "target_uri": "http://a/\r\nX-Evil: 1", "block": b"b"}
    (back,) = warc.unpack(__import__("io").BytesIO(__import__("gzip").decompress(warc.pack(row))))
    assert back["target_uri"] == "http://a/ X-Evil: 1" and "X-Evil" not in json.loads(back["headers"])
