"""Plan shape of every registered query: no Cartesian product, no nested
loop join, no Python evaluation."""

from __future__ import annotations

import pytest

from marketlens.plans.registry import QUERIES

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
             "ArrowEvalPython")


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_plan_shape(key, t001):
    plan = QUERIES[key](t001)._jdf.queryExecution().executedPlan().toString()
    for bad in FORBIDDEN:
        assert bad not in plan, f"{key}: {bad}"


def test_a_query_bounds_the_partitions_of_its_session(spark):
    """A task's memory must not follow the size of the tables."""
    from marketlens.session import FINE_PARTITIONS, PARTITION_BYTES, SPLIT_BYTES, bound_partitions
    first, size, split = ("spark.sql.adaptive.coalescePartitions.initialPartitionNum",
                          "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes")
    old = {k: spark.conf.get(k, None) for k in (first, size, split)}
    try:
        spark.conf.unset(first)
        spark.conf.set(size, "64MB")
        spark.conf.set(split, "134217728b")
        bound_partitions(spark)
        assert [int(spark.conf.get(k)) for k in (first, size, split)] == [FINE_PARTITIONS, PARTITION_BYTES, SPLIT_BYTES]
        for k, v in ((first, "2000"), (size, "8m"), (split, "1m")):
            spark.conf.set(k, v)
        bound_partitions(spark)
        assert [spark.conf.get(k) for k in (first, size, split)] == ["2000", "8m", "1m"]
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
