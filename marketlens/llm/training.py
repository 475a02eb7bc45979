"""A bounded, deterministic sample of labelled documents for model fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def id_remainder(doc_id, parts: int):
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, held_out: int,
                    max_rows: int, seed: int = 11) -> DataFrame:
    """(text, y) of at most ``max_rows`` documents with a 0/1 ``label`` outside
    the held-out part, chosen by hash of the id: half of each label where there
    are enough.  Only ids of the sample are broadcast, ``max_rows`` at most; an
    id that comes with several texts gives its smallest one, so the rows stay
    within the bound however often ids repeat."""
    rows = (labels.select("doc_id", F.col(label).cast("int").alias("y"))
            .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
            .groupBy("doc_id").agg(F.max("y").alias("y"))
            .where(id_remainder(F.col("doc_id"), parts) != held_out)
            .withColumn("h", F.xxhash64(F.lit(seed), "doc_id")))
    ones = rows.where("y = 1").orderBy("h", "doc_id").limit(max_rows // 2)
    zeros = rows.where("y = 0").orderBy("h", "doc_id").limit(max_rows // 2)
    chosen = F.broadcast(ones.union(zeros).drop("h"))
    return docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id").agg(
        F.min("text").alias("text"), F.first("y").alias("y")).select("text", "y")


def prior(labels: DataFrame, label: str, parts: int, held_out: int) -> tuple[int, int]:
    """Numbers of rows labelled 0 and 1 outside the held-out part."""
    r = labels.where(id_remainder(F.col("doc_id"), parts) != held_out).agg(
        F.count(F.when(F.col(label) == 0, 1)), F.count(F.when(F.col(label) == 1, 1))).first()
    return int(r[0]), int(r[1])
