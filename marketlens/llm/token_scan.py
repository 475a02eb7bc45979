"""Token counts by separator scan over flat, unindexed token files.

A flat file holds the token ids of many documents as little-endian unsigned
integers, each document closed by the end-of-document id, and nothing else.
Byte ranges of such files are scanned independently: a vectorised search finds
the separators of a block.  A prefix scan over the blocks' summaries (number of
separators, position of the last one) then gives every block the ordinal and the
open document it begins with, so a document that spans any number of blocks is
stitched from its two separators' positions.
"""

from __future__ import annotations

import base64
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import new_folder, slices, written

TOKENIZER = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
EOD = 50256
# Fixed value: how the byte-pair vocabulary's texts are cut into pieces.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or an absolute local path."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path)


def load_encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_token_files(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, eod: int = EOD,
                      dtype: str = "<u2") -> DataFrame:
    """Tokenise ``docs(doc_id, text)`` into flat files, one per task, in
    ``folder`` (shared storage).  Returns the written table ``(file, bytes,
    ordinal, doc_id)``: what lies where.  Null texts are empty documents.  A
    task that is run again writes a new file; the table names only files of
    the runs that counted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, fs, out, name, count, size = None, None, None, "", 0, 0
        ids: list = []
        for b in (part for batch in batches for part in slices(batch, 1)):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if out is None:
                    enc = load_encoder(tokenizer)
                    fs, root = opened(folder)
                    fs.create_dir(root, recursive=True)
                    name = f"{uuid.uuid4().hex}.tokens"
                    out = fs.open_output_stream(f"{root}/{name}")
                tokens = np.array([*enc.encode_ordinary((text or "").encode("utf-8", "replace").decode()), eod], dtype)
                out.write(tokens.tobytes())
                size += tokens.nbytes
                ids.append(doc)
        if out is not None:
            out.close()
            for start in range(0, len(ids), 10_000):
                part = ids[start:start + 10_000]
                count = len(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{folder}/{name}"] * count), pa.array([size] * count, pa.int64()),
                     pa.array(range(start, start + count), pa.int64()), pa.array(part, pa.int64())],
                    ["file", "bytes", "ordinal", "doc_id"])

    return written(docs.select("doc_id", "text").mapInArrow(
        run, "file string, bytes long, ordinal long, doc_id long"), "token_index")


def scan_separators(files: DataFrame, eod: int = EOD, dtype: str = "<u2", block_bytes: int = 1 << 22) -> DataFrame:
    """(file, ordinal, n_tokens): tokens of each document of ``files(file,
    bytes)``, the separator not counted.  Tokens after a file's last separator
    are one more, open document; an empty file has none."""
    width = np.dtype(dtype).itemsize
    step = max(width, block_bytes // width * width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, start, size in zip(*(b.column(i).to_pylist() for i in range(3))):
                fs, path = opened(file)
                with fs.open_input_file(path) as f:
                    block = np.frombuffer(f.read_at(min(step, size - start), start), dtype)
                at = np.flatnonzero(block == eod) + start // width
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), pa.array([start], pa.int64()), pa.array([size // width], pa.int64()),
                     pa.array([at], pa.list_(pa.int64()))], ["file", "start", "tokens", "ends"])

    sizes = files.withColumn("bytes", F.col("bytes") - F.col("bytes") % width).where("bytes > 0")
    blocks = sizes.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(step).cast("long")))
                          .alias("start"), "bytes").repartition("file", "start")
    found = written(blocks.mapInArrow(run, "file string, start long, tokens long, ends array<long>"), "separators")
    # the prefix scan sees one small row per block
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    carry = found.select("file", "start", F.size("ends").alias("n"), F.element_at(F.expr(
        "if(size(ends) > 0, ends, null)"), -1).alias("end")).select(
        "file", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ordinal0"),
        F.coalesce(F.last("end", True).over(before), F.lit(-1)).alias("open"))
    each = found.join(carry, ["file", "start"]).select(
        "file", "ordinal0", F.explode(F.arrays_zip(
            F.col("ends").alias("end"), F.concat(F.array("open"), F.col("ends")).alias("was"),
            F.sequence(F.lit(0), F.size("ends")).alias("i"))).alias("d"))
    closed = each.where("d.end is not null").select(
        "file", (F.col("ordinal0") + F.col("d.i")).alias("ordinal"), (F.col("d.end") - F.col("d.was") - 1).alias("n_tokens"))
    tails = found.groupBy("file").agg(F.sum(F.size("ends")).alias("ordinal"), F.max("tokens").alias("tokens"),
                                      F.max(F.array_max("ends")).alias("end"))
    open_ = tails.select("file", "ordinal", (F.col("tokens") - F.coalesce("end", F.lit(-1)) - 1).alias("n_tokens")).where(
        "n_tokens > 0")
    return closed.union(open_)


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, **scan) -> DataFrame:
    """(doc_id, n_tokens) of every row of ``docs(doc_id, text)``, counted by
    scanning the flat files that its tokens were written to.  Null and empty
    texts have 0 tokens; repeated rows are counted each."""
    spark: SparkSession = docs.sparkSession
    index = write_token_files(docs, new_folder(spark, "tokens"), tokenizer)
    files = index.groupBy("file").agg(F.max("bytes").alias("bytes"))
    return index.join(scan_separators(files, **scan), ["file", "ordinal"]).select("doc_id", "n_tokens")
