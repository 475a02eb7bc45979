"""Phrase collocations against a plain count of every phrase."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from marketlens.llm import phrases

SCHEMA = "text string, lang string"


def brute(rows, least, longest, top, percent):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, counts in f.items():
        several = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        inside = {q[i:i + m] for q, c in several.items() for m in range(2, len(q)) for i in range(len(q) - m + 1)
                  if 100 * c >= percent * counts[q[i:i + m]]}
        rows = []
        for p, a in several.items():
            if p not in inside:
                score, cut = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), counts[p[:cut]], counts[p[cut:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return out


def result(spark, rows, least, longest=5, top=2000, percent=100):
    got = phrases.collocations(spark.createDataFrame(rows, SCHEMA), least, longest, top, percent)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = ["the", "of", "New", "York", "city", "Élan", "über", "x", "和", "nbsp word", "-", "the"]
    rows = []
    for i in range(300):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", " ; "])
                       for _ in range(rng.randrange(0, 60)))
        rows.append((text, rng.choice(["en", "de", None, "und"])))
    return rows + [("new york city hall opens", "en")] * 9 + [(None, "en"), ("", None), (" \t.,", "fr"), ("alone", "fr")]


@pytest.mark.parametrize("least, longest, top, percent", [(3, 5, 2000, 100), (9, 5, 7, 100), (4, 3, 50, 60), (2, 2, 10, 100)])
def test_against_every_phrase(spark, corpus, least, longest, top, percent):
    got = result(spark, corpus, least, longest, top, percent)
    assert got and got == brute(corpus, least, longest, top, percent)


def test_limits_above_a_byte(spark):
    rows = [("go on", "en")] * 299 + [("go off", "en")] * 300 + [("on off", "en")] * 700
    assert result(spark, rows, 300) == brute(rows, 300, 5, 2000, 100) != set()


def test_a_pass_that_prunes_nothing_gives_the_same(spark, corpus, monkeypatch):
    want = result(spark, corpus, 3)
    monkeypatch.setattr(phrases, "_enough", lambda texts, longest, least: phrases.np.full((longest, 1 << 19), 255, "uint8"))
    assert result(spark, corpus, 3) == want


def test_equal_windows_leave_the_pass_summed(spark):
    texts = spark.createDataFrame([("en", "p q r. " * 200)] * 50 + [("de", "p q")] * 5, "lang string, text string")
    for some in (phrases._enough(texts, 3, 6), phrases.np.full((3, 1 << 14), 255, "uint8")):
        bits = spark.sparkContext.broadcast(some)
        rows = [tuple(r.asDict().values()) for r in phrases.window_counts(texts, bits, 3).collect()]
        assert len(rows) == len({r[:-1] for r in rows}) <= 5             # a row each, not one per word
        assert sum(r[-1] for r in rows) == 3 * 10_000 + 10


def test_tables_follow_the_words(spark):
    most = [8 * 10**9, 16 * 10**8, 10**8]                # words, and words a place at the limit of 100
    assert all(n / 2**phrases._table_bits(n, 100) < 100 * 2 / 3 for n in most)
    assert phrases._table_bits(0, 100) == phrases._LEAST_BITS and phrases._table_bits(10**15, 2) == phrases._MOST_BITS
    texts = spark.range(400).selectExpr("'en' lang", "concat_ws(' ', transform(sequence(1, 500), i -> hex(500 * id + i))) text")
    some = phrases.np.unpackbits(phrases._enough(texts, 2, 4))
    assert some.mean() < 0.02                            # 200,000 words, each there once


def test_blocks_of_any_size_give_the_same(spark, corpus, monkeypatch):
    corpus = corpus + [("new york city hall", "a\nb"), ("b new york city hall", "a")] * 9
    want = result(spark, corpus, 3)
    assert want == brute(corpus, 3, 5, 2000, 100)
    monkeypatch.setattr(phrases, "_HELD_PLACES", 50)
    monkeypatch.setattr(phrases, "_HELD_WINDOWS", 20)
    monkeypatch.setattr(phrases, "_PART", 100)
    monkeypatch.setattr(phrases, "_words_in", lambda texts: 1 << 29)
    assert result(spark, corpus, 3) == want


def test_long_texts_empty_tables_and_other_columns(spark):
    long = "a b c d e f g, " * 30_000
    assert result(spark, [(long, "en")], 100) == brute([(long, "en")], 100, 5, 2000, 100) != set()
    assert result(spark, [], 2) == set() == result(spark, [(None, None), ("", "en")], 2)
    rows = spark.createDataFrame([("p q", "en", 1, "z")] * 4, SCHEMA + ", n int, w1 string")
    assert [tuple(r) for r in phrases.collocations(rows, 4).collect()] == [("en", 1, "p q", 4, 4, 4, 8, 2000)]


def test_products_beyond_64_bits():
    a, n = 9 * 10**15, 10**18 - 1
    assert 1000 * a * n > 2**64                          # within the decimals of the score
    assert len(str(1000 * a * n)) <= 38
