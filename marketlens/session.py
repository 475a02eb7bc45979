"""Spark session helpers.

Cluster jobs receive their session (and its ``spark.checkpoint.dir``) from the
platform; only tests and the local benchmark build one here.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings every plan in this package relies on.  They are safe on a cluster:
# AQE re-plans joins / coalesces partitions at runtime and splits skewed
# partitions of sort-merge joins.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # bucketed tables written one file per bucket and sorted by the key
    # report that order, so sort-merge joins on the key skip their sorts
    # (Spark only claims the order when each bucket is a single file)
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
    # a union of bucketed scans must not pass for partitioned by the bucket
    # key: an aggregate over it would skip its exchange and keep split groups
    "spark.sql.unionOutputPartitioning": "false",
}

# A task's memory follows its partition, so partitions must not grow with the
# tables: shuffles are dealt finely and AQE joins small partitions up to
# PARTITION_BYTES (joins and aggregates hold some 40 times the shuffled bytes),
# scans are split at SPLIT_BYTES.
FINE_PARTITIONS, PARTITION_BYTES, SPLIT_BYTES = 480, 16 << 20, 32 << 20


def _driver_memory() -> str:
    """60 % of physical memory, capped at 8 GiB (local mode: the driver is
    the only JVM)."""
    try:
        with open("/proc/meminfo") as f:
            kb = next(int(line.split()[1]) for line in f if line.startswith("MemTotal"))
        mb = int(kb / 1024 * 0.6)
    except (OSError, StopIteration, ValueError):
        mb = 4096
    return f"{max(1024, min(mb, 8192))}m"


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app: str = "marketlens", scratch: str | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Local session for tests / bench: UI off, UTC, AQE on."""
    scratch = scratch or tempfile.mkdtemp(prefix="marketlens-")
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.maxMetadataStringLength", "2000")    # whole filters in printed plans
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", _driver_memory())
         .config("spark.sql.warehouse.dir", os.path.join(scratch, "warehouse"))
         .config("spark.local.dir", os.path.join(scratch, "local")))
    for k, v in {**RUNTIME_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark, os.path.join(scratch, "checkpoints"))
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str) -> str:
    """Return the cluster's shared checkpoint folder; set ``fallback`` only
    when the session has none (tests, local runs)."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(current)
        return current
    spark.conf.set("spark.checkpoint.dir", fallback)
    spark.sparkContext.setCheckpointDir(fallback)
    return fallback


def apply_runtime_conf(spark: SparkSession) -> None:
    """Apply the runtime settings to a session built elsewhere (the driver).
    They are all runtime settings; a failure to set one is an error."""
    for k, v in RUNTIME_CONF.items():
        spark.conf.set(k, v)
    bound_partitions(spark)


def bound_partitions(spark: SparkSession) -> None:
    """Shuffles of at least ``FINE_PARTITIONS`` partitions, joined by AQE to at
    most ``PARTITION_BYTES``, and scans of at most ``SPLIT_BYTES`` a task.  More
    or smaller ones that the session has stay."""
    first = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    if int(spark.conf.get(first, None) or spark.conf.get("spark.sql.shuffle.partitions")) < FINE_PARTITIONS:
        spark.conf.set(first, str(FINE_PARTITIONS))
    for key, most in (("spark.sql.adaptive.advisoryPartitionSizeInBytes", PARTITION_BYTES),
                      ("spark.sql.files.maxPartitionBytes", SPLIT_BYTES)):
        now = re.fullmatch(r"(\d+)(b|k|kb|m|mb)?", spark.conf.get(key).lower())
        unit = {"k": 10, "m": 20}.get((now[2] or "b")[0], 0) if now else 0
        if not now or int(now[1]) << unit > most:
            spark.conf.set(key, str(most))


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``.  Where a session
    has none, a folder in its warehouse if that is shared: on a file system of
    the cluster, or where driver and executors are one process.  Else it is an
    error, as executors would not see each other's files."""
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not spark.conf.get("spark.checkpoint.dir", None):
        local = re.match(r"local($|\[)", spark.sparkContext.master)
        if not local and re.match(r"file:|/|[^:/]*(/|$)", warehouse):
            raise ValueError("spark.checkpoint.dir is not set, and the warehouse is a folder of this machine")
    return ensure_checkpoint_dir(spark, f"{warehouse}/_checkpoints")


def materialize(df):
    """Cut lineage of a frame that several jobs read: a reliable checkpoint
    in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
