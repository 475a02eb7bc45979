"""The registered queries on the smallest tables, against SQL and brute force."""

from __future__ import annotations

import zlib

import duckdb
import pytest

import corpus_pipeline
from marketlens.llm import decontaminate, mixing, quality
from marketlens.llm.queries import ORACLE_SQL, OTHER_SHARE, QUERIES, SOURCE_SHARES, table

from .test_operators import brute_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_thirteen_queries():
    assert [k.split("_")[0] for k in QUERIES] == [f"op{n}" for n in range(1, 14)]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, sql, name):
    got = QUERIES[name](spark, SF)
    want = sql.sql(ORACLE_SQL[name])
    assert set(got.columns) == set(want.columns)
    rows = sorted(map(str, want.project(", ".join(got.columns)).fetchall()))
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == rows


def test_ngram_join_query(spark):
    rows = [(r[0], r[1]) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = {r[0]: (r[1], r[2]) for r in QUERIES["op1_ngram_join"](spark, SF).collect()}
    assert got == brute_components(rows, 80)


@pytest.mark.parametrize("name, parts, held", [("op4_toxicity", 5, 0), ("op7_quality", 3, 1)])
def test_classifier_queries(spark, name, parts, held):
    rows = QUERIES[name](spark, SF).collect()
    assert len(rows) == table(spark, SF, "documents").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % parts == held)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_every_known_source_has_its_own_class(spark):
    rows = QUERIES["op5_mixing"](spark, SF).select("source", "mix_class", "phase", "slot").distinct().collect()
    known = {f"src{i}" for i in range(20)}
    assert {r["source"] for r in rows} & known - {f"src{i}" for i in range(9)}
    assert all(r["mix_class"] == (r["source"] if r["source"] in known else mixing.OTHER) for r in rows)


def test_planted_passages_are_found(spark, sql):
    got = {(r[0], r[1]) for r in QUERIES["op6_decontaminate"](spark, SF).select("doc_id", "item_id").collect()}
    want = set(sql.sql("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)").fetchall())
    assert want and want <= got
    assert len({d for d, _ in got} - {d for d, _ in want}) <= 2


def test_pipeline_against_brute_force(spark):
    docs = {r["doc_id"]: r for r in table(spark, SF, "documents").collect()}
    model = quality.fit_quality(table(spark, SF, "documents"), table(spark, SF, "labels"))
    words = quality.WordTable()
    kept = {i: r["text"] for i, r in docs.items() if model.score(model.margin(quality.features(r["text"], words))) >= 0.5}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    seen = {}
    for t in kept.values():
        for k in {key(x) for x in (t or "").split("\n")} - {""}:
            seen[k] = seen.get(k, 0) + 1
    for i, t in list(kept.items()):
        lines = (t or "").split("\n")
        stay = [x for x in lines if seen.get(key(x), 0) < 10]
        if len(stay) < len(lines):
            kept[i] = "\n".join(stay)
            if not kept[i].strip():
                del kept[i]
    kept = {i: kept[i] for i, (_, c) in brute_components(list(kept.items()), 80).items() if c == i}
    bench = [(r["item_id"], decontaminate.template(r["text"], decontaminate._Words())) for r in table(spark, SF, "benchmark").collect()]
    leaks = {i for i, t in kept.items() if any(r["text"] in (t or "") for r in table(spark, SF, "benchmark").collect())}
    out = corpus_pipeline.run(spark, SF).collect()
    got = {r["doc_id"]: r for r in out}
    assert len(got) == len(out) and bench
    assert not set(got) & leaks and set(got) <= set(kept) and len(set(kept) - set(got) - leaks) <= 2
    assert all((r["text"] or "") == (kept[i] or "") and r["source"] == docs[i]["source"] for i, r in got.items())
    placed = mixing.mix_sources(spark.createDataFrame([tuple(docs[i])[:1] + (r["text"],) + tuple(docs[i])[2:] for i, r in got.items()],
                                                      table(spark, SF, "documents").schema), SOURCE_SHARES, OTHER_SHARE).collect()
    assert {(r["doc_id"], r["slot"]) for r in placed} == {(r["doc_id"], r["slot"]) for r in out}
