"""Helpers shared by the corpus operators: written tables, a hash filter of
bounded size and connected components."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.
    Where a session has none, a folder beside its warehouse is set if that is
    shared: on a file system of the cluster, or where driver and executors are one
    process (tests, local runs).  Else it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        local = re.match(r"local($|\[)", spark.sparkContext.master)
        if not local and re.match(r"file:|/|[^:/]*(/|$)", warehouse):
            raise ValueError("spark.checkpoint.dir is not set, and the warehouse is a folder of this machine")
        folder = warehouse + "/_work"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, so a
    lost executor costs a reread and never a rerun of what came before.  With
    ``by``, its last column, a folder for each of that column's values."""
    path = new_folder(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def remove(spark: SparkSession, *folders: str) -> None:
    """Delete folders of the shared folder that nothing reads any more."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        remove(df.sparkSession, df.written_to)


def bounded_batches(spark: SparkSession, limit: int = 8 << 20) -> None:
    """Batches between Spark and Python of ``limit`` bytes at most, so a task's
    memory outside the heap doesn't follow the length of the texts.  A smaller
    bound that the session has stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if not (now.rstrip("bB").isdigit() and 0 < int(now.rstrip("bB")) <= limit):
        spark.conf.set(key, str(limit))


def slices(batch: pa.RecordBatch, column: int, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of at most ``limit`` bytes of ``column``, strings or
    lists of 8-byte numbers (or one row), so a task's memory follows one part
    and not a whole batch."""
    values = batch.column(column)
    each = pc.multiply(pc.list_value_length(values), 8) if pa.types.is_list(values.type) else pc.binary_length(values)
    sizes = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(each, 0).to_numpy(zero_copy_only=False), np.int64))])
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(sizes, sizes[start] + limit, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def ascii_lower(col):
    """A-Z to a-z and nothing else: ``lower`` where all is ASCII."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(
        F.translate(col, upper, upper.lower()))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift and multiply), on uint64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


# --------------------------------------------------------------------------
# A filter of bounded size over 64-bit keys.  Up to the bound its size follows
# the keys, as the driver holds it several times while it is gathered and sent
# out; with more keys it lets more through, and an exact join stands behind it.

FILTER_BITS = 27              # 2^27 bits are 16 MiB
_CHUNK_BITS = 20              # built in chunks of 128 KiB
_BITS_A_KEY = 64              # lets one in a thousand of other keys through


def filter_bits(keys: int) -> int:
    """The power of two of the bits that a filter of so many keys has."""
    return min(FILTER_BITS, max(_CHUNK_BITS, (_BITS_A_KEY * keys - 1).bit_length()))


def _positions(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    h, mask = mix(keys.view(np.uint64)), np.uint64(size - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)


def _or_chunk(parts: list[bytes]) -> bytes:
    bits = np.zeros(1 << (_CHUNK_BITS - 3), np.uint8)
    for b in parts:
        if b[:1] == b"d":
            bits |= np.frombuffer(b, np.uint8, offset=1)
        else:
            at = np.frombuffer(b[1:], np.uint32).astype(np.int64)
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return bits.tobytes()


def hash_filter(keys: DataFrame, bits_log: int = FILTER_BITS) -> np.ndarray:
    """Bit array (uint8, 2^bits_log bits) of the one bigint column of ``keys``;
    nulls are left out."""
    size = 1 << bits_log

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size >> 3, np.uint8)
        for b in batches:
            k = b.column(0).drop_null().to_numpy(zero_copy_only=False)
            for at in _positions(k, size):
                np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        step = 1 << (_CHUNK_BITS - 3)
        for c in range(len(bits) // step):
            chunk = bits[c * step:(c + 1) * step]
            if not chunk.any():
                continue
            at = np.flatnonzero(np.unpackbits(chunk, bitorder="little")).astype(np.uint32)
            packed = b"s" + at.tobytes() if 4 * len(at) < step else b"d" + chunk.tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([c], pa.int32()), pa.array([packed], pa.binary())], ["chunk", "bits"])

    def merge(key, table):
        out = _or_chunk(table.column("bits").to_pylist())
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()),
                         "bits": pa.array([out], pa.binary())})

    rows = (keys.mapInArrow(partial, "chunk int, bits binary")
            .groupBy("chunk").applyInArrow(merge, "chunk int, bits binary").collect())
    out = np.zeros(size >> 3, np.uint8)
    step = 1 << (_CHUNK_BITS - 3)
    for r in rows:
        out[r["chunk"] * step:(r["chunk"] + 1) * step] = np.frombuffer(r["bits"], np.uint8)
    return out


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Boolean mask: False where a key is surely not in the filter."""
    h, mask = mix(keys.view(np.uint64)), np.uint64(8 * len(bits) - 1)
    a = (h & mask).astype(np.int64)
    hit = (bits[a >> 3] >> (a & 7).astype(np.uint8)) & 1
    at = np.flatnonzero(hit)
    b = ((h[at] >> np.uint64(32)) & mask).astype(np.int64)
    hit[at] = (bits[b >> 3] >> (b & 7).astype(np.uint8)) & 1
    return hit.astype(bool)


# --------------------------------------------------------------------------

def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join on the bigint ``key`` so that both sides are dealt out for the join
    itself, even where ``right`` is an aggregate by that key: adaptive
    execution can then split a hot key's rows over tasks."""
    r = right.withColumnRenamed(key, "_right_key")
    out = left.join(r, left[key].cast("decimal(20,0)") == r["_right_key"].cast("decimal(20,0)"), how)
    return out if how in ("left_semi", "left_anti") else out.drop("_right_key")


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of one partition as stars with the same components."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while up.setdefault(root, root) != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    def stars():
        found = [(x, find(x)) for x in list(up)]
        pairs = [(x, r) for x, r in found if x != r]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()),
                                           pa.array([r for _, r in pairs], pa.int64())], ["a", "b"])

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = find(x), find(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        if len(up) > 1_000_000:                          # bounded: what is known so far goes out as it is
            yield stars()
            up.clear()
    yield stars()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row ``(node, component)``
    per node that has an edge, the component being its smallest node.

    Rounds of large-star and small-star, each after a contraction of every
    partition's own edges.  A hub's neighbours are never gathered, only their
    minimum; each round is a written table."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        # large: each node's neighbours above it move to its smallest neighbour
        # small: each node and its neighbours below move to the smallest of them
        near = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        low = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        j = skew_join(near, low, "a")
        if large:
            return j.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return j.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                          F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where(
            F.col("a") != F.col("b")).distinct()

    def contracted(e: DataFrame) -> DataFrame:
        return written(e.select("a", "b").mapInArrow(_forest, "a long, b long"), "edges")

    now = contracted(edges)
    for turn in range(max_rounds):
        if turn != 1:                                    # one round is rarely enough: the first look is before, the next after two
            # done once each component is a star: no node hangs from two roots, or from a node that hangs itself
            ends = now.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("hangs")),
                                                F.struct(F.col("b").alias("node"), F.lit(0).alias("hangs")))).alias("e"))
            if ends.groupBy("e.node").agg(F.sum("e.hangs").alias("up"), F.min("e.hangs").alias("root")).where(
                    "up > 1 or (up > 0 and root = 0)").isEmpty():
                break
        now = contracted(star(star(now, True), False))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("node", F.col("node").alias("component")))
