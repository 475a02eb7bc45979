"""Corpus pipeline: quality, line dedup, near duplicates, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run`
writes each one's rows as Parquet in the shared folder and rereads them as the
next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import decontaminate, line_dedup, mixing, ngram_join, quality
from marketlens.llm.queries import OTHER_SHARE, SOURCE_SHARES, table
from marketlens.llm.shared import discard, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose quality score is at least 0.5.  The model learns
    from all labelled documents but the held-out third, at most its bound."""
    docs = docs.select(*COLUMNS)
    model = quality.fit_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model).where("quality_score >= 0.5").select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines found in at least ten of the documents it is given; a
    document that loses all its text goes, one that had none stays."""
    docs = docs.select(*COLUMNS)
    out = line_dedup.drop_frequent_lines(docs, 10)
    text = F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("text"))
    return (out.where((F.col("n_dropped") == 0) | (F.trim("kept", F.lit(line_dedup.SPACE)) != ""))
            .select("doc_id", text.alias("text"), "lang", "source",
                    F.when(F.col("n_dropped") > 0, F.char_length("kept")).otherwise(F.col("n_chars"))
                    .cast(docs.schema["n_chars"].dataType).alias("n_chars")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest doc_id of each near-duplicate component."""
    docs = docs.select(*COLUMNS)
    found = ngram_join.jaccard_components(docs, n=5, percent=80)
    copies = written(found.where("component_id <> doc_id").select(F.col("doc_id").alias("_copy")).distinct(), "copies")
    return docs.join(copies, docs["doc_id"] == copies["_copy"], "left_anti")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gives every document its slot in the mix of sources."""
    return mixing.mix_sources(docs.select(*COLUMNS), SOURCE_SHARES, OTHER_SHARE)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources", mixing_stage),
]

#: The first stage's fitted classifier is not expressible in SQL; tests/llm
#: holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline")
        discard(*before)                                 # what the last stage has read
        before = [docs]
    return docs
