"""Line dedup over levelled sorted runs.

A line's key is the line stripped of ASCII white space at both ends, with A-Z
lower-cased; a run is a table of (128-bit key digest, number of documents),
bucketed and sorted by the digest.  Documents come in batches.  A batch counts
its keys, merge-anti-joins the settled keys (those that earlier batches have
already found often enough: no more counting is needed) and adds the rest as
its own run.  When a level holds ``fanout`` runs they are merged into one run
of the next level, and keys that reach the limit move to the settled run.

Runs share one bucketing, so these merges need no shuffle.  Counting combines
on the map side: a line that a third of all documents hold is one row per task.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ascii_lower, discard, new_folder, remove, written

SPACE = " \t\n\x0b\x0c\r"


def line_key(line):
    """128-bit digest of a line's key; null for an empty key."""
    key = ascii_lower(F.trim(line, F.lit(SPACE)))
    return F.when(key != "", F.unhex(F.md5(key)))


def lines_of(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """Levelled runs in the session's shared folder."""

    def __init__(self, spark: SparkSession, limit: int, fanout: int = 2, buckets: int | None = None, keys: int = 0):
        # a bucket is one task's: their number follows the keys to come, 4 million lines of a batch or so in each
        self.spark, self.limit, self.fanout = spark, limit, fanout
        self.buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-keys // 4_000_000))
        self.levels: list[list[DataFrame]] = []
        self.settled: list[DataFrame] = []
        self.tables: dict[str, str] = {}

    def _run(self, rows: DataFrame) -> DataFrame:
        name = f"line_run_{uuid.uuid4().hex}"
        self.tables[name] = new_folder(self.spark, name)
        (rows.repartition(self.buckets, "key").write.bucketBy(self.buckets, "key").sortBy("key")
         .option("path", self.tables[name]).saveAsTable(name))
        return self.spark.table(name)

    def drop(self) -> None:
        """Delete the runs, tables and files."""
        for name, folder in self.tables.items():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, folder)
        self.tables.clear()

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        """Merge joins of runs on their common bucketing; a run has a key once."""
        rows = runs[0].select("key", "n")
        for r in runs[1:]:
            other = r.select(F.col("key").alias("k2"), F.col("n").alias("n2"))
            rows = rows.join(other, rows["key"] == other["k2"], "full_outer").select(
                F.coalesce("key", "k2").alias("key"),
                (F.coalesce("n", F.lit(0)) + F.coalesce("n2", F.lit(0))).alias("n"))
        return rows

    def add(self, batch: DataFrame) -> None:
        """``batch(key, n)``: a new batch's keys and in how many of its documents."""
        for s in self.settled:
            batch = batch.join(s, "key", "left_anti")
        self._place(self._run(batch), 0)

    def _place(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) < self.fanout:
            return
        merged = written(self._merged(self.levels[level]), "merged")
        self.levels[level] = []
        done = merged.where(F.col("n") >= self.limit)
        if self.settled:
            done = done.join(self.settled[0].select("key"), "key", "left_anti").union(self.settled[0].select("key", "n"))
        self.settled = [self._run(done)]
        rest = self._run(merged.where(F.col("n") < self.limit))
        discard(merged)
        self._place(rest, level + 1)

    def frequent(self) -> DataFrame:
        """Keys found in at least ``limit`` documents, as a written table."""
        rest = [r for level in self.levels for r in level]
        parts = [s.select("key") for s in self.settled]
        if rest:
            parts.append(self._merged(rest).where(F.col("n") >= self.limit).select("key"))
        # a part each, so that none loses its bucketing in a union
        apart = [written(p, "frequent") for p in parts]
        keys = written(reduce(DataFrame.union, apart).distinct(), "frequent")
        discard(*apart)
        self.drop()
        return keys


def _keys_of(docs: DataFrame, batches: int) -> DataFrame:
    """(doc_id, key, batch): the distinct keys of each row, by batch."""
    return written(docs.select(
        "doc_id", F.explode(F.array_distinct(F.transform(lines_of(F.col("text")), line_key))).alias("key"),
        F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch")).where("key is not null"), "line_keys", by="batch")


def _frequent(keys: DataFrame, least_docs: int, batches: int, **runs) -> DataFrame:
    store = LineRuns(keys.sparkSession, least_docs, keys=keys.count() // batches, **runs)
    for b in range(batches):
        store.add(keys.where(F.col("batch") == b).groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    return store.frequent()


def frequent_lines(docs: DataFrame, least_docs: int = 10, batches: int = 4, **runs) -> DataFrame:
    """Line keys found in at least ``least_docs`` rows of ``docs``, from
    ``batches`` batches of documents by hash of their id."""
    keys = _keys_of(docs, batches)
    found = _frequent(keys, least_docs, batches, **runs)
    discard(keys)
    return found


_PARTS = 256


def drop_frequent_lines(docs: DataFrame, least_docs: int = 10, **more) -> DataFrame:
    """All columns of ``docs(doc_id, text, ...)`` plus ``n_lines``,
    ``n_dropped`` and ``kept``: the text without the lines whose key is found
    in at least ``least_docs`` documents (rows).  Null or empty text is one
    empty line; a line with an empty key always stays; a text that loses all
    its lines becomes the empty text.  Input columns of these names are
    replaced."""
    docs = docs.drop("n_lines", "n_dropped", "kept", "_bad", "_parts")
    batches = more.pop("batches", 4)
    keys = _keys_of(docs, batches)
    frequent = _frequent(keys, least_docs, batches, **more)
    bad = written(keys.join(frequent, "key").groupBy(F.col("doc_id").alias("_bad_id")).agg(F.collect_set("key").alias("_bad")), "bad_lines")
    discard(keys, frequent)
    # a long list of a document's frequent lines is looked up by parts, so that no row takes time in proportion to its
    # lines times its frequent lines
    part = lambda key: F.pmod(F.xxhash64(key), F.lit(_PARTS)).cast("int")            # noqa: E731
    parts = F.when(F.size("_bad") > _PARTS, F.transform(
        F.sequence(F.lit(0), F.lit(_PARTS - 1)), lambda i: F.filter("_bad", lambda k: part(k) == i)))
    at = docs.join(bad.withColumn("_parts", parts), docs["doc_id"].eqNullSafe(bad["_bad_id"]), "left")
    lines = lines_of(F.col("text"))

    def stays(line):
        key = line_key(line)
        listed = F.when(F.col("_parts").isNull(), F.array_contains("_bad", key)).otherwise(
            F.array_contains(F.get("_parts", part(key)), key))
        return ~F.coalesce(listed, F.lit(False))

    # a text without a frequent line stays as it is, and its keys are not made again
    stay = F.when(F.col("_bad").isNotNull(), F.filter(lines, stays))
    return at.select(*[docs[c] for c in docs.columns], F.size(lines).cast("long").alias("n_lines"),
                     F.coalesce(F.size(lines) - F.size(stay), F.lit(0)).cast("long").alias("n_dropped"),
                     F.coalesce(F.array_join(stay, "\n"), "text", F.lit("")).alias("kept"))
