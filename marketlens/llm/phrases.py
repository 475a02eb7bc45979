"""Phrase collocations by top-order marginalisation.

A word and the words that follow it in its piece, as lead columns w1..w5 padded
at the piece's end, make one window per word.  Only these longest windows are
counted; ``ROLLUP`` over the columns then sums ever shorter prefixes, and as
every occurrence of a phrase begins exactly one window, the sum over the windows
that begin with it is its frequency.  No n-gram of another length is exploded.

Before, one pass counts the hashes of all prefixes in tables whose places
follow the words, one table per length.  Where a prefix's count there is below
the limit (it never is too low) the window is padded from there on: no phrase
that counts can be lost, and the distinct windows that remain are few.

Neither pass sends a row per word: tasks send places and summed windows as
packed blocks, dealt by hash, and what a task holds is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, mix, slices, written

# Bytes that end a piece, and bytes between words.
_BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
_SPACES = b" \t"

_PART = 4 << 20               # bytes of text looked at at once
_HELD_PLACES = 8 << 20        # a task sends its places after so many
_HELD_WINDOWS = 1 << 19       # and its windows after so many different ones
_LEAST_BITS, _MOST_BITS = 17, 27    # places of a length's table: 16 KiB to 16 MiB as bits
_SLICE_WORDS = 25             # log2 of the words whose places meet in one task, per length
_BUCKET_WORDS = 23            # log2 of the words whose windows meet in one task
_FACTOR = np.uint64(0x9E3779B97F4A7C15)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)
_KIND[list(_SPACES)] = 1
_KIND[list(_BREAKS)] = 2


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """(words, text each is of, whether it follows the word before it in one
    piece) of an array of strings without nulls."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    ends = ends - ends[0]
    kind = _KIND[data]
    inside = kind == 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = ends[:-1][ends[:-1] < len(data)]
    first[heads] |= inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    offsets = np.concatenate([[0], np.cumsum(stop - start)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[inside]]))
    text = np.searchsorted(ends, start, side="right") - 1
    piece = np.searchsorted(np.flatnonzero(kind == 2), start)
    follows = np.zeros(len(start), bool)
    follows[1:] = (text[1:] == text[:-1]) & (piece[1:] == piece[:-1])
    return words.dictionary_encode(), text, follows


def _parts(batches: Iterator[pa.RecordBatch]):
    """(languages, language number per word, words, follows) of parts of the rows."""
    for part in (p for b in batches for p in slices(b, 1, _PART)):
        langs = part.column(0).dictionary_encode()
        words, text, follows = words_of(part.column(1))
        yield langs.dictionary, langs.indices.to_numpy(zero_copy_only=False)[text].astype(np.int64), words, follows


def _hash(strings: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(s) for s in strings.cast(pa.binary()).to_pylist()), np.uint64, len(strings))


def _prefixes(langs: pa.Array, lang: np.ndarray, words: pa.DictionaryArray, follows: np.ndarray, longest: int):
    """Per length: where windows of that many words begin, and the hash of each."""
    code = _hash(words.dictionary)[words.indices.to_numpy()]
    total = _hash(langs)[lang]
    at = np.arange(len(code))
    for k in range(longest):
        if k:
            stays = at + k < len(code)
            stays[stays] = follows[at[stays] + k]
            at, total = at[stays], total[stays]
        total = mix(total * _FACTOR + code[at + k])
        yield at, total


def _words_in(texts: DataFrame) -> int:
    """Words of the texts, roughly, by their bytes.  Sizes follow it, no result does."""
    return (texts.agg(F.sum(F.octet_length("text"))).head()[0] or 0) // 6


def _table_bits(words: int, least: int) -> int:
    """The power of two of the places of a length's table: a place gets a
    quarter of ``least`` at most, up to the bound."""
    return min(_MOST_BITS, max(_LEAST_BITS, (4 * words // least).bit_length()))


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers byte by byte of their width, compressed: small ones cost a byte or less."""
    planes = np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes()
    return pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, width * n, codec="zstd"), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(n)


def _enough(texts: DataFrame, longest: int, least: int) -> np.ndarray:
    """Per length one bit per place: prefixes there may occur ``least`` times.
    Counts stop at ``least``.  Slices of the tables are summed by a task each."""
    kind = np.uint8 if least < 256 else np.uint32
    words = _words_in(texts)
    table_bits = _table_bits(words, least)
    n_slices = 1 << min(table_bits - 10, max(3, (words >> _SLICE_WORDS).bit_length()))
    slice_bits = table_bits - n_slices.bit_length() + 1
    sent = pa.schema([("slice", pa.int32()), ("size", pa.int32()), ("gaps", pa.binary()), ("counts", pa.binary())])

    def blocks(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for k, places in enumerate(held):
            place, n = np.unique(np.concatenate(places or [np.zeros(0, np.uint32)]), return_counts=True)
            n = np.minimum(n, least).astype(kind)
            starts = np.arange(n_slices + 1, dtype=np.uint32) << np.uint32(slice_bits)
            cuts = np.searchsorted(place, starts)
            for i in np.flatnonzero(np.diff(cuts)):
                own = slice(cuts[i], cuts[i + 1])
                row = {"slice": k * n_slices + int(i), "size": int(cuts[i + 1] - cuts[i]),
                       "gaps": _packed(np.diff(place[own], prepend=starts[i])), "counts": _packed(n[own])}
                yield pa.RecordBatch.from_pylist([row], schema=sent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [[] for _ in range(longest)], 0
        for langs, lang, words, follows in _parts(batches):
            for places, (_, total) in zip(held, _prefixes(langs, lang, words, follows, longest)):
                places.append((total >> np.uint64(64 - table_bits)).astype(np.uint32))
                n += len(total)
            if n >= _HELD_PLACES:
                yield from blocks(held)
                held, n = [[] for _ in range(longest)], 0
        yield from blocks(held)

    def merge(key, rows):
        total = np.zeros(1 << slice_bits, kind)
        for size, gaps, counts in zip(*(rows.column(c).to_pylist() for c in ("size", "gaps", "counts"))):
            at = np.cumsum(_unpacked(gaps, size, np.uint32), dtype=np.int64)
            total[at] = np.minimum(total[at].astype(np.int64) + _unpacked(counts, size, kind), least)
        bits = np.packbits(total >= least, bitorder="little")
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([_packed(bits)], pa.binary())})

    rows = texts.mapInArrow(run, "slice int, size int, gaps binary, counts binary").groupBy("slice").applyInArrow(
        merge, "slice int, bits binary").collect()                                  # 16 MiB per length at most, and packed
    out = np.zeros((longest << table_bits) // 8, np.uint8)
    step = (1 << slice_bits) // 8
    for r in rows:
        out[r["slice"] * step:(r["slice"] + 1) * step] = _unpacked(r["bits"], step, np.uint8)
    return out.reshape(longest, -1)


def _summed(tables: list[pa.Table], keys: list[str]) -> pa.Table:
    out = pa.concat_tables(tables).group_by(keys, use_threads=False).aggregate([("n", "sum")])
    return out.select([*keys, "n_sum"]).rename_columns([*keys, "n"]).combine_chunks()


def window_counts(texts: DataFrame, bits, longest: int) -> DataFrame:
    """(lang, phrase, n) of ``texts(lang, text)``: the longest windows, padded
    with '' after the last word of the piece and from where ``bits`` says that no
    longer prefix counts, joined by spaces; one row for each."""
    n_buckets = max(32, _words_in(texts) >> _BUCKET_WORDS)
    columns = [f"w{k + 1}" for k in range(longest)]
    sent = pa.schema([("bucket", pa.int32()), ("size", pa.int32()), ("lengths", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary())])

    def windows(langs: pa.Array, lang: np.ndarray, words: pa.DictionaryArray, follows: np.ndarray) -> pa.Table:
        """(bucket, key, n) of a part, the key being the language, a line break and the phrase."""
        ids = words.indices.to_numpy()
        length = np.zeros(len(ids) + 1, np.int8)
        bucket = np.zeros(len(ids), np.int32)
        for k, (at, total) in enumerate(_prefixes(langs, lang, words, follows, longest)):
            table = bits.value[k]
            place = (total >> np.uint64(64 - (8 * len(table)).bit_length() + 1)).astype(np.int64)
            may = (table[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
            # a phrase that counts begins and ends with one, a word shorter, that does
            may &= (length[at] == k) & (length[at + (1 if k else 0)] >= k)
            at = at[may]
            length[at] = k + 1
            bucket[at] = (total[may] % np.uint64(n_buckets)).astype(np.int32)
        names, pad, at = pa.concat_arrays([words.dictionary, pa.array([""])]), len(words.dictionary), np.arange(len(ids))
        cols = [np.where(length[:-1] > k, ids[np.minimum(at + k, len(ids) - 1)], pad) for k in range(longest)]
        found = pa.table([pa.array(lang), pa.array(bucket), *map(pa.array, cols)], ["lang", "bucket", *columns]).group_by(
            ["lang", "bucket", *columns], use_threads=False).aggregate([([], "count_all")]).combine_chunks()
        phrase = pc.binary_join_element_wise(*(names.take(found[c]) for c in columns), " ")
        return pa.table({"bucket": found["bucket"], "key": pc.binary_join_element_wise(langs.take(found["lang"]), phrase, "\n"),
                         "n": found["count_all"]})

    def blocks(found: pa.Table) -> Iterator[pa.RecordBatch]:
        found = found.sort_by([("bucket", "ascending"), ("key", "ascending")]).combine_chunks()
        bucket, n = found["bucket"].to_numpy(), found["n"].to_numpy()
        keys = found["key"].chunk(0) if len(n) else pa.array([], pa.string())
        ends, data = np.frombuffer(keys.buffers()[1], np.int32, len(n) + 1), keys.buffers()[2]
        cuts = np.searchsorted(bucket, np.arange(n_buckets + 1))
        for i in np.flatnonzero(np.diff(cuts)):
            a, b = int(cuts[i]), int(cuts[i + 1])
            row = {"bucket": int(i), "size": b - a, "lengths": _packed(np.diff(ends[a:b + 1])), "counts": _packed(n[a:b]),
                   "keys": pa.compress(data.slice(int(ends[a]), int(ends[b] - ends[a])), codec="zstd", asbytes=True)}
            yield pa.RecordBatch.from_pylist([row], schema=sent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for part in _parts(batches):
            if len(part[1]):
                held.append(windows(*part))
                n += len(held[-1])
            if n >= _HELD_WINDOWS:
                yield from blocks(_summed(held, ["bucket", "key"]))
                held, n = [], 0
        if held:
            yield from blocks(_summed(held, ["bucket", "key"]))

    def merge(key, rows):
        held, n, most = [], 0, _HELD_WINDOWS
        for size, lengths, keys, counts in zip(*(rows.column(c).to_pylist() for c in ("size", "lengths", "keys", "counts"))):
            ends = np.concatenate([[0], np.cumsum(_unpacked(lengths, size, np.int32))]).astype(np.int32)
            data = pa.decompress(keys, int(ends[-1]), codec="zstd")
            held.append(pa.table({"key": pa.StringArray.from_buffers(size, pa.py_buffer(ends), data),
                                  "n": _unpacked(counts, size, np.int64)}))
            n += size
            if n >= most:
                held = [_summed(held, ["key"])]
                n, most = len(held[0]), max(most, 2 * len(held[0]))
        found = _summed(held, ["key"])
        both = pc.split_pattern(found["key"], "\n", max_splits=1, reverse=True)         # no word has a line break
        return pa.table({"lang": pc.list_element(both, 0), "phrase": pc.list_element(both, 1), "n": found["n"]})

    return texts.mapInArrow(run, "bucket int, size int, lengths binary, keys binary, counts binary").groupBy("bucket").applyInArrow(
        merge, "lang string, phrase string, n long")


def phrase_counts(docs: DataFrame, longest: int = 5, least: int = 100) -> DataFrame:
    """(lang, words, phrase, f): every phrase of up to ``longest`` words that
    occurs ``least`` times in the texts of a language, and the row without words
    that has the number of all its words."""
    columns = [f"w{k + 1}" for k in range(longest)]
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    bits = docs.sparkSession.sparkContext.broadcast(_enough(texts, longest, least))
    words = F.split("phrase", " ")
    counted = written(window_counts(texts, bits, longest).select(
        "lang", *(words[k].alias(c) for k, c in enumerate(columns)), "n"), "windows")
    bits.destroy()
    up = counted.rollup("lang", *columns).agg(F.sum("n").alias("f"), F.grouping_id().alias("out"))
    size = F.greatest(F.lit(longest) - F.bit_count("out"), F.lit(0))       # the words that a prefix has
    words = F.slice(F.array(*columns), F.lit(1), size.cast("int"))
    kept = written(up.where("lang is not null").where((F.col("f") >= least) | (size == 0)).where(
        ~F.array_contains(words, "")).select("lang", words.alias("words"), F.array_join(words, " ").alias("phrase"), "f"), "phrases")
    discard(counted)
    return kept


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, percent: int = 100) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the best phrases per language.

    Reads ``docs(text, lang)``; other columns don't matter.  A null text is
    empty, a null lang is ``und``.  Every row counts, equal ones too.  A phrase's
    score is that of its lowest-scoring cut, ``floor(1000 a n / (l r))`` with
    ``a``, ``l``, ``r`` the frequencies of the phrase and its two parts and ``n``
    the language's words; ties go to the earliest cut.  Phrases inside a longer
    one with at least ``percent`` hundredths of their frequency are left out.
    Rank by score, frequency (both falling) and phrase.  No words, no rows."""
    counts = phrase_counts(docs, longest, least)
    totals = counts.where(F.size("words") == 0).select(F.col("lang").alias("_lang"), F.col("f").alias("n"))
    part = counts.where(F.size("words") > 0).select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), "f")
    several = counts.where(F.size("words") > 1)

    def sliced(first, n):
        return F.array_join(F.slice("words", first, n), " ")

    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.size("words") - m + 1), lambda i: F.array_join(F.slice("words", i, m), " "))))
    longer = (several.where(F.size("words") > 2).select("lang", F.col("f").alias("of"), F.explode(F.array_distinct(inner)).alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("of").alias("of")))
    alone = several.join(longer, ["lang", "phrase"], "left").where(
        F.col("of").isNull() | (100 * F.col("of").cast("decimal(38,0)") < percent * F.col("f").cast("decimal(38,0)")))
    cuts = alone.select("lang", "phrase", F.col("f").alias("a"), "words",
                        F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("cut")).select(
        "lang", "phrase", "a", "cut", sliced(F.lit(1), F.col("cut")).alias("head"),
        sliced(F.col("cut") + 1, F.size("words") - F.col("cut")).alias("tail"))
    for side, f in (("head", "l"), ("tail", "r")):
        p = part.withColumnRenamed("f", f)
        cuts = cuts.join(p, (cuts["lang"] == p["_lang"]) & (cuts[side] == p["_phrase"])).drop("_lang", "_phrase", side)
    scored = cuts.join(totals, cuts["lang"] == totals["_lang"]).drop("_lang").withColumn(
        "score", F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(16,0)) * cast(n as decimal(18,0))) div "
                        "(cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("c")).select(
        "lang", "phrase", "c.*")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return lowest.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")
