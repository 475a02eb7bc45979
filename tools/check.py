"""Run registered queries in Spark and their DuckDB oracle side by side.

    python tools/check.py [--sf /root/testdata/sf0.01] [key ...]
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from marketlens.oracle import ORACLE_SQL  # noqa: E402
from marketlens.plans.registry import QUERIES  # noqa: E402
from marketlens.session import build_session  # noqa: E402
from marketlens.sources import load  # noqa: E402
from marketlens.testing import compare, duck_connect  # noqa: E402


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--json", default=None)
    ap.add_argument("keys", nargs="*")
    a = ap.parse_args()
    spark = build_session(scratch=tempfile.mkdtemp(prefix="run-check-", dir="/tmp"))
    con = duck_connect(a.sf)
    t = load(spark, a.sf)
    keys = a.keys or list(QUERIES)
    out, failed = {}, 0
    for k in keys:
        t0 = time.time()
        try:
            if k not in ORACLE_SQL:
                n = QUERIES[k](t).count()
                print(f"{k:45s} NO-ORACLE rows={n}")
                continue
            r = compare(k, QUERIES[k](t), con, ORACLE_SQL[k])
        except Exception as e:  # report and continue with the next key
            failed += 1
            print(f"{k:45s} ERROR {type(e).__name__}: {str(e)[:400]}")
            out[k] = {"ok": False, "error": str(e)[:400]}
            continue
        status = "OK" if r.ok else ("CLOSE" if r.values_close and r.columns_match
                                    and r.spark_rows == r.oracle_rows else "FAIL")
        failed += status == "FAIL"
        print(f"{k:45s} {status:5s} rows={r.spark_rows}/{r.oracle_rows} "
              f"types={'ok' if r.types_match else 'DIFF'} {time.time() - t0:.1f}s "
              + "; ".join(r.notes))
        out[k] = {"ok": r.ok, "status": status, "rows": r.spark_rows,
                  "types": r.types_match, "notes": r.notes}
    if a.json:
        with open(a.json, "w") as f:
            json.dump(out, f, indent=1)
    print(f"failed: {failed} of {len(keys)}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
