"""Side-by-side check of a Spark query against its DuckDB oracle.

Compares column names, a coarse type per column, row count and the sorted
rows (decimals by value, doubles exactly and within 1e-9 relative).
"""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass, field
from decimal import Decimal

RAW_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
              "events", "documents", "embeddings", "pages", "benchmark", "labels",
              "conversations")


def duck_connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in RAW_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _spark_type(dt_) -> str:
    s = dt_.simpleString()
    return {"bigint": "bigint", "int": "int", "double": "double", "string": "string",
            "timestamp_ntz": "timestamp", "timestamp": "timestamp", "date": "date",
            "boolean": "boolean", "smallint": "smallint", "float": "float"}.get(s, s)


def _duck_type(t: str) -> str:
    t = str(t).lower()
    if t.startswith("decimal"):
        return t.replace(" ", "")
    return {"bigint": "bigint", "integer": "int", "double": "double", "varchar": "string",
            "timestamp": "timestamp", "date": "date", "boolean": "boolean",
            "hugeint": "hugeint", "smallint": "smallint", "float": "float"}.get(t, t)


def _norm(v):
    if isinstance(v, Decimal):
        return ("n", v)
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("n", Decimal(v))
    if isinstance(v, float):
        return ("f", v)
    if isinstance(v, (dt.datetime, dt.date)):
        return ("t", v)
    return ("s", v)


def _sort_key(row):
    return tuple((v is None, str(v[1]) if v is not None else "") for v in row)


def _close(a, b) -> bool:
    if a is None or b is None:
        return a is None and b is None
    if a[0] == "f" or b[0] == "f":
        x, y = float(a[1]), float(b[1])
        if math.isnan(x) and math.isnan(y):
            return True
        return x == y or abs(x - y) <= 1e-9 * max(1.0, abs(x), abs(y))
    return a[1] == b[1]


def _exact(a, b) -> bool:
    if a is None or b is None:
        return a is None and b is None
    return a[1] == b[1]


@dataclass
class Result:
    key: str
    spark_rows: int = 0
    oracle_rows: int = 0
    columns_match: bool = False
    types_match: bool = False
    values_exact: bool = False
    values_close: bool = False
    notes: list[str] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return (self.columns_match and self.spark_rows == self.oracle_rows
                and self.values_exact)


def compare(key: str, sdf, con, sql: str) -> Result:
    r = Result(key)
    s_cols = sdf.columns
    s_types = {f.name: _spark_type(f.dataType) for f in sdf.schema.fields}
    s_rows = sdf.collect()
    cur = con.execute(sql)
    o_cols = [d[0] for d in cur.description]
    o_types = {d[0]: _duck_type(d[1]) for d in cur.description}
    o_rows = cur.fetchall()
    r.spark_rows, r.oracle_rows = len(s_rows), len(o_rows)
    r.columns_match = sorted(s_cols) == sorted(o_cols)
    if not r.columns_match:
        r.notes.append(f"columns spark={sorted(s_cols)} oracle={sorted(o_cols)}")
        return r
    bad_types = [(c, s_types[c], o_types[c]) for c in s_cols if s_types[c] != o_types[c]]
    r.types_match = not bad_types
    if bad_types:
        r.notes.append(f"types {bad_types}")
    idx = [o_cols.index(c) for c in s_cols]
    sp = sorted([tuple(_norm(v) if v is not None else None for v in row) for row in s_rows],
                key=_sort_key)
    orc = sorted([tuple(_norm(row[i]) if row[i] is not None else None for i in idx)
                  for row in o_rows], key=_sort_key)
    if len(sp) != len(orc):
        r.notes.append(f"rows spark={len(sp)} oracle={len(orc)}")
        return r
    exact = close = True
    shown = 0
    for a, b in zip(sp, orc):
        for c, x, y in zip(s_cols, a, b):
            if not _exact(x, y):
                exact = False
                if not _close(x, y):
                    close = False
                    if shown < 3:
                        r.notes.append(f"{c}: spark={x} oracle={y}")
                        shown += 1
    r.values_exact, r.values_close = exact, close
    return r
