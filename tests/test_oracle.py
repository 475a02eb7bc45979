"""Every registered query against its independent DuckDB oracle."""

from __future__ import annotations

import pytest

from marketlens.oracle import ORACLE_SQL
from marketlens.oracle.ctes import sql_over_tables
from marketlens.plans.registry import QUERIES
from marketlens.testing import compare

KEYS = sorted(QUERIES)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("key", KEYS)
def test_sf0001_matches_oracle(key, t001, duck001):
    r = compare(key, QUERIES[key](t001), duck001, ORACLE_SQL[key])
    assert r.columns_match, r.notes
    assert r.types_match, r.notes
    assert r.spark_rows == r.oracle_rows, r.notes
    assert r.values_exact, r.notes


@pytest.mark.parametrize("key", KEYS)
def test_handmade_traps_match_oracle(key, handmade):
    t, con = handmade
    r = compare(key, QUERIES[key](t), con, sql_over_tables(key))
    assert r.columns_match, r.notes
    assert r.spark_rows == r.oracle_rows, r.notes
    assert r.values_exact, r.notes
