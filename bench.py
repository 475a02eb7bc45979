"""Benchmark: every registered query at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Flow of a real deployment: the canonical tables are staged once (adapter ->
Parquet tables, order-grain tables bucketed by ``order_id``), then every
query runs over the staged tables.  Each query is executed in full with the
``noop`` sink (no rows shipped to the driver).  Prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 [BENCH_REPEAT=2] python bench.py [key ...]

``queries`` holds the first (cold) run of each key and ``value`` their sum;
with ``BENCH_REPEAT`` > 1 the best repeated (warm) run is added as ``warm``.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from marketlens.plans.registry import QUERIES  # noqa: E402
from marketlens.session import build_session  # noqa: E402
from marketlens.sources import load, stage_tables  # noqa: E402


def _run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    keys = sys.argv[1:] or list(QUERIES)
    scratch = tempfile.mkdtemp(prefix="run-bench-", dir="/tmp")
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus),
                          scratch=scratch, app="marketlens-bench")
    times: dict[str, float] = {}

    t0 = time.time()
    staged = stage_tables(spark, load(spark, sf_dir), database="bench",
                          buckets=max(8, 2 * cpus))
    times["_stage_tables"] = round(time.time() - t0, 3)

    # warm-up: JIT and the first-scan path, not counted
    _run(QUERIES["count_orders"](staged))

    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    warm: dict[str, float] = {}
    for k in keys:
        t1 = time.time()
        _run(QUERIES[k](staged))
        times[k] = round(time.time() - t1, 3)
        for _ in range(repeat - 1):        # optional warm runs (same plan again)
            t1 = time.time()
            _run(QUERIES[k](staged))
            warm[k] = min(warm.get(k, 1e9), round(time.time() - t1, 3))

    query_total = sum(v for k, v in times.items() if not k.startswith("_"))
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "total_query_seconds", "value": round(query_total, 3),
           "unit": "sec", "queries": times, "sf": sf, "cpus": cpus, "n_queries": len(keys)}
    if warm:
        out["warm"] = warm
        out["warm_total"] = round(sum(warm.values()), 3)
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
