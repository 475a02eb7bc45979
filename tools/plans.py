"""Print physical-plan facts per query: exchanges, sorts, windows, broadcasts.

    python tools/plans.py [--raw] [--full] [--sf DIR] [key ...]

By default the canonical tables are staged first (bucketed order-grain
tables, as in bench.py); ``--raw`` plans over the adapter instead.
"""

from __future__ import annotations

import argparse
import os
import re
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from marketlens.plans.registry import QUERIES  # noqa: E402
from marketlens.session import build_session  # noqa: E402
from marketlens.sources import load, stage_tables  # noqa: E402

PATTERNS = {
    "exchange": r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition",
    "single_partition": r"Exchange SinglePartition",
    "broadcast": r"BroadcastExchange",
    "smj": r"SortMergeJoin",
    "bhj": r"BroadcastHashJoin",
    "cartesian": r"CartesianProduct|BroadcastNestedLoopJoin",
    "window": r"Window \[",
    "expand": r"Expand \[",
    "python": r"ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas|MapInPandas",
}


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--raw", action="store_true")
    ap.add_argument("--full", action="store_true")
    ap.add_argument("--no-broadcast", action="store_true",
                    help="plan as at scale: no table fits a broadcast")
    ap.add_argument("keys", nargs="*")
    a = ap.parse_args()
    extra = {"spark.sql.adaptive.enabled": "false"}
    if a.no_broadcast:
        extra["spark.sql.autoBroadcastJoinThreshold"] = "-1"
    spark = build_session(scratch=tempfile.mkdtemp(prefix="run-plans-", dir="/tmp"),
                          extra=extra)
    t = load(spark, a.sf)
    if not a.raw:
        t = stage_tables(spark, t, database="plans", buckets=8)
    for k in a.keys or list(QUERIES):
        df = QUERIES[k](t)
        plan = df._jdf.queryExecution().executedPlan().toString()
        counts = {n: len(re.findall(p, plan)) for n, p in PATTERNS.items()}
        print(f"{k:42s} " + " ".join(f"{n}={c}" for n, c in counts.items() if c))
        if a.full:
            df.explain("formatted")


if __name__ == "__main__":
    main()
