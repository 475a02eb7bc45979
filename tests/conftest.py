from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from marketlens.session import build_session  # noqa: E402

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session(master="local[4]", shuffle_partitions=8,
                      scratch=tempfile.mkdtemp(prefix="run-tests-", dir="/tmp"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def t001(spark):
    from marketlens.sources import load
    return load(spark, SF001)


@pytest.fixture(scope="session")
def duck001():
    from marketlens.testing import duck_connect
    return duck_connect(SF001)


@pytest.fixture(scope="session")
def handmade(spark):
    """Hand-made canonical tables (Spark) and a DuckDB holding the same rows."""
    import duckdb

    from tests.fixtures import handmade_tables
    t = handmade_tables(spark)
    folder = tempfile.mkdtemp(prefix="run-handmade-", dir="/tmp")
    con = duckdb.connect()
    for name, df in t.items():
        path = f"{folder}/{name}"
        df.write.mode("overwrite").parquet(path)
        con.execute(f"CREATE TABLE k_{name} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    return t, con
