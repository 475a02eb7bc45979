"""Personal data: base spans against the plain patterns, the bootstrapped graph
against a version in dictionaries, and planted identifiers of unseen form."""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections import defaultdict

import pytest

from marketlens.llm import pii, queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    out = []
    for k, (kind, form) in enumerate(PLAIN.items()):
        for m in re.finditer(form, text):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            if kind == "card":
                twice = [d * 2 - 9 * (d > 4) if i % 2 else d for i, d in enumerate(digits[::-1])]
                if not 14 <= len(digits) <= 19 or sum(twice) % 10:
                    continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def luhn_number(rng, n):
    d = [rng.randrange(10) for _ in range(n - 1)]
    return next("".join(map(str, d)) + c for c in "0123456789" if pii.luhn("".join(map(str, d)) + c))


def test_base_against_the_plain_patterns():
    rng = random.Random(11)
    bits = ["a", "B9", "@", "@", ".", ".", "-", "+", " ", " ", "(", ")", "%", "1", "25", "255", "256", "007", "\n", "é", "：",
            "x@y.z", "1.2.3.4", "+1 (234) 555-7788", "4", "4111 1111 1111 1111", "4111-1111-1111-1111", "４", "_"]
    for _ in range(20_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14)))
        assert pii.base_spans(text) == plain_base(text), text
    for n in range(12, 22):
        text = f"on {luhn_number(rng, n)}."
        assert pii.base_spans(text) == plain_base(text)
    assert [k for _, k, _ in pii.base_spans("a@b.cé 1.2.3.4 +49 (0) 30 1234567; 4111111111111111")] == [0, 1, 3, 2]


@pytest.mark.parametrize("text", ["1" * 400_000, "1." * 200_000, "1 " * 200_000 + "x", "a" * 400_000, "a@" * 200_000, "@a" * 200_000,
                                  "a." * 200_000 + "@", "+1" + " " * 400_000, "+1 " * 130_000, "f:" * 200_000, "[at]" * 100_000,
                                  " at a" * 80_000, "x@a dot b" * 40_000, "(" * 400_000, "1-(" * 130_000])
def test_time_in_proportion(text):
    t = time.perf_counter()
    base = pii.base_spans(text)
    pii.candidate_spans(text, base)
    assert time.perf_counter() - t < 5


def names(spans):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def brute(texts, rounds=4, least_known=5, least_confidence=0.8, least_score=0.9):
    marks, edges, known = {}, defaultdict(set), set()
    for text in {t or "" for t in texts}:
        base = plain_base(text)
        marks[text] = [(s, e, (k,), True) for s, k, e in base] + [(*c, False) for c in pii.candidate_spans(text, base)]
        for s, e, kinds, seed in marks[text]:
            for k in kinds:
                value = k, pii.value_of(text[s:e], k)
                for p in pii.contexts(text, s, e):
                    edges[p].add(value)
                if seed and pii.contexts(text, s, e):
                    known.add(value)
    seeds, good = set(known), {}
    for _ in range(rounds):
        good = {}
        for p, values in edges.items():
            for k in range(4):
                n, of = sum(v in known for v in values if v[0] == k), len({v for _, v in values})
                if n >= least_known and n / (of + 1) >= least_confidence:
                    good[p, k] = n / (of + 1)
        miss = defaultdict(lambda: 1.0)
        for p, values in edges.items():
            for v in values - known:
                miss[v] *= 1 - good.get((p, v[0]), 0)
        new = {v for v, m in miss.items() if round(1 - m, 9) >= least_score}
        if not new:
            break
        known |= new
    out = {}
    for text, ms in marks.items():
        spans = plain_base(text)
        for s, e, kinds, seed in ms:
            weight = []
            for k in kinds:
                if not seed and (v := (k, pii.value_of(text[s:e], k))) in known:
                    best = 1.0 if v in seeds else max((good.get((p, k), 0) for p in pii.contexts(text, s, e)), default=0)
                    weight += [(best, -k)] if best else []
            if weight:
                spans.append((s, -max(weight)[1], e))
        out[text] = names(sorted(spans))
    return out


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(3)
    texts = []
    for i in range(40):
        texts += [f"Please reach me at u{i}.x@mail{i}.example.com or later",
                  f"my card number: {luhn_number(rng, 16)} thanks",
                  f"call me on +1 ({200 + i}) 555-{1000 + i} today",
                  f"the order 2024{i:03d}55{i:02d} has shipped, ref 77{i:02d}123456789{i:02d}",
                  f"server address {i}.10.20.{i} is down"]
    seen = ["Please reach me at jane [at] site [dot] org or later", "call me on 0711-555-2233 today",
            "server address 2001:db8:0:1:1:1:1:1 is down", "my card number: 4111 1111 1111 1112 thanks",
            "Please reach me at root@localhost or later",
            # the second round: a context that only instances of the first are in
            *[f"call me on 0{i}11-555-22{i:02d} today" for i in range(10, 18)],
            *[f"home line then 0{i}11-555-22{i:02d} ok" for i in range(10, 18)], "home line then 0999-555-1234 ok"]
    clean = ["we met at noon dot com was young", "the order 2024999 55 99 has shipped", "in 2024-05-06 10:11:12 we left", None, "",
             "x" * 5_000, "1234567 1234567"]
    return texts, seen, clean


def test_unseen_identifiers_are_found_and_clean_texts_left(spark, planted):
    texts, seen, clean = planted
    rows = [(i, t) for i, t in enumerate(texts + seen + clean)] + [(3, texts[0]), (3, texts[0]), (None, seen[0]), (0, seen[1])]
    out = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).select(
        "doc_id", pii.span_list(pii.F.col("spans")).alias("spans")).collect()
    want = brute([t for _, t in rows])
    assert sorted(((r[0] is None, r[0] or 0, r[1]) for r in out)) == sorted((i is None, i or 0, want[t or ""]) for i, t in rows)
    assert all(want[t] for t in seen)
    assert not any(want[t or ""] for t in clean)
    assert want[seen[0]] == "email:19:43" and want[seen[2]].startswith("ip:15:") and want[seen[-1]].startswith("phone:15:")


def test_clashing_columns_and_empty_tables(spark, planted):
    texts, seen, clean = planted
    rows = [(i, t, "q", 1, "b") for i, t in enumerate(texts + seen + clean)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, marks int, base string")
    out = pii.personal_data(docs)
    assert sorted(out.columns) == ["base", "doc_id", "spans"] and out.count() == len(rows)
    assert pii.personal_data(docs.limit(0)).collect() == []


def test_registered_query(spark, tmp_path):
    texts = ["a@b.cd 1.2.3.4", None, "+49 30 1234567 x 4111111111111111", "nothing"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op12_pii(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        base = plain_base(t or "")
        counts = [sum(k == c for _, k, _ in base) for c in range(4)]
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == counts
        assert got[i]["spans"] == names(base)
        assert got[i]["base_sha256"] == hashlib.sha256(names(base).encode()).hexdigest()
