"""Personal data by bootstrapped contextual extraction.

Identifiers of unmistakable form (the base spans) are the seeds.  The words
around them are lexical patterns, and the seeds and all other identifier-like
strings in the same contexts are the instances of a graph of patterns and
instances.  Spark scores it in rounds: a pattern's confidence in a kind is the
share of its instances known to be of that kind; an instance's score is the
noisy-or of its confident patterns; instances that score enough are known from
then on and can make further patterns confident.  Mentions in confident contexts
are added to the base spans.

One pass over the texts finds seeds, candidates and contexts; all later work is
on its written table of spans, which holds digests of the values and no text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, slices, written

#: Kinds in their order within spans.
KINDS = ("email", "ip", "card", "phone")
_EMAIL, _IP, _CARD, _PHONE = range(4)

# The base patterns, written so that no text takes more than time in proportion to its length.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_QUAD = re.compile(r"[0-9]++((?:\.[0-9]++){3})?+")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
_DIALLED = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# What else may be an identifier: mail addresses without a dotted host or with spelled-out marks, eight-part addresses of
# the newer internet protocol, longer runs of digits.
_AT, _DOT = r"[\[({<] ?[aA][tT] ?[\])}>]", r"(?: ?(?:\.|[\[({<] ?[dD][oO][tT] ?[\])}>]| dot ) ?[A-Za-z0-9-]{1,63}+){0,8}"
_MAIL = (re.compile(r"@[A-Za-z0-9-]{1,63}+" + _DOT), re.compile(_AT + r" ?[A-Za-z0-9-]{1,63}+" + _DOT),
         re.compile(r" at [A-Za-z0-9-]{1,63}+(?: dot [A-Za-z0-9-]{1,63}+){1,8}"))
_COLON = re.compile(r":[0-9A-Fa-f]{1,4}:")
_COLONS = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){3,7}(?![0-9A-Za-z:])")
_NUMBER = re.compile(r"[0-9](?:[ ().\-/]{0,3}[0-9])++")
_MAYBE = re.compile(r"[0-9@\[({<]")

_WORD = re.compile(r"[^\W\d_]+|[:#=]")
_CONTEXT = 64                 # characters looked at on each side


def luhn(digits: str) -> bool:
    doubled = "0246813579"
    return sum(int(doubled[int(d)] if i % 2 else d) for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the identifiers of unmistakable form, sorted."""
    out, end = [], 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                end = m.end()
                out.append((start, _EMAIL, end))
    for m in _QUAD.finditer(text):
        if m.group(1) and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), _IP, m.end()))
    for m in _DIGITS.finditer(text):
        if 14 <= m.end() - m.start() <= 37:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), _CARD, m.end()))
    if "+" in text:
        for m in _DIALLED.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), _PHONE, m.end()))
    return sorted(out)


def candidate_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, tuple[int, ...]]]:
    """(start, end, kinds it may be of) of identifier-like strings that touch no
    base span, in order and without overlaps; the earlier form goes first."""
    found = []
    for form in _MAIL:
        for m in form.finditer(text):
            head = m.start()
            if head and text[head - 1] == " " and text[head] not in "@ ":
                head -= 1
            start = head
            while start > 0 and head - start < 64 and text[start - 1] in _LOCAL:
                start -= 1
            if start < head:
                found.append((start, m.end(), (_EMAIL,)))
    if _COLON.search(text):
        found += [(m.start(), m.end(), (_IP,)) for m in _COLONS.finditer(text)]
    for m in _NUMBER.finditer(text):
        start, end = m.span()
        if end - start > 64:
            continue
        while start > max(0, m.start() - 2) and text[start - 1] in "(+":
            start -= 1
        if text[start - 1:start].isalnum() or text[start - 1:start] in (".", ",") or text[end:end + 1].isalnum():
            continue
        n = sum(c.isdigit() for c in m.group())
        kinds = ((_CARD,) if 12 <= n <= 19 else ()) + ((_PHONE,) if 7 <= n <= 15 else ())
        if kinds:
            found.append((start, end, kinds))
    taken = iter([*((s, e) for s, _, e in _joined(base)), (len(text) + 1, len(text) + 1)])
    s, e = next(taken)
    out, free = [], 0
    for start, end, kinds in sorted(found, key=lambda f: f[0]):
        while e <= start:
            s, e = next(taken)
        if end <= s and start >= free:
            out.append((start, end, kinds))
            free = end
    return out


def _joined(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The parts of a text that spans cover, in order."""
    out: list[tuple[int, int, int]] = []
    for s, k, e in spans:
        if out and s < out[-1][2]:
            out[-1] = out[-1][0], k, max(e, out[-1][2])
        else:
            out.append((s, k, e))
    return out


def value_of(mention: str, kind: int) -> str:
    """What mentions of one identifier share, however they are written."""
    if kind in (_CARD, _PHONE):
        return "".join(c for c in mention if c.isdigit())
    if kind == _EMAIL:
        low = re.sub(r" ?[\[({<] ?at ?[\])}>] ?| at ", "@", mention.lower())
        return re.sub(r" ?[\[({<] ?dot ?[\])}>] ?| dot ", ".", low)
    return mention.lower()


def contexts(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns that a span stands in: the two and the three words
    before it, and the words on both sides; ``^`` is a line's end.  Words are
    lower-case letters, or one of ``:#=``."""
    left = text[max(0, start - _CONTEXT):start].rpartition("\n")
    before = ["^"] * 3 + [w.lower() for w in _WORD.findall(left[2])]
    after = [w.lower() for w in _WORD.findall(text[end:end + _CONTEXT].partition("\n")[0])] + ["^"]
    both = [" ".join(before[-2:]) + " _", " ".join(before[-3:]) + " _", f"{before[-1]} _ {after[0]}"]
    return [p for p in both if any(c.isalpha() for c in p)]


_SPAN = "struct<start:int,kind:int,end:int>"
_MARK = "struct<seed:boolean,start:int,end:int,kinds:array<int>,values:array<binary>,patterns:array<string>>"
_FOUND = f"text_digest binary, base array<{_SPAN}>, marks array<{_MARK}>"


def _digest(s: str) -> bytes:
    return xxhash.xxh3_128_digest(s.encode("utf-8", "surrogatepass"))


def _marks(text: str, base: list[tuple[int, int, int]]) -> Iterator[dict]:
    for start, kind, end in base:
        yield {"seed": True, "start": start, "end": end, "kinds": [kind],
               "values": [_digest(value_of(text[start:end], kind))], "patterns": contexts(text, start, end)}
    for start, end, kinds in candidate_spans(text, base):
        yield {"seed": False, "start": start, "end": end, "kinds": list(kinds),
               "values": [_digest(value_of(text[start:end], k)) for k in kinds], "patterns": contexts(text, start, end)}


def find_marks(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` but ``text``, with ``text_digest``, ``base`` and
    ``marks``: base spans and candidates with their values and patterns."""
    keep = [c for c in docs.columns if c not in ("text", "text_digest", "base", "marks")]
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    mark = pa.list_(pa.struct([("seed", pa.bool_()), ("start", pa.int32()), ("end", pa.int32()), ("kinds", pa.list_(pa.int32())),
                               ("values", pa.list_(pa.binary())), ("patterns", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in slices(b, 0)):
            digests, bases, marks = [], [], []
            for text in part.column(0).to_pylist():
                text = text or ""
                some = _MAYBE.search(text) or " dot " in text
                base = base_spans(text) if some else []
                digests.append(_digest(text))
                bases.append([dict(zip(("start", "kind", "end"), s)) for s in base])
                marks.append(list(_marks(text, base)) if some else [])
            yield pa.RecordBatch.from_arrays(
                [*part.columns[1:], pa.array(digests, pa.binary()), pa.array(bases, span), pa.array(marks, mark)],
                [*keep, "text_digest", "base", "marks"])

    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return docs.select("text", *keep).mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in keep), _FOUND]))


def bootstrap(marks: DataFrame, rounds: int = 4, least_known: int = 5, least_confidence: float = 0.8,
              least_score: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """(known, good) of ``marks(seed, kind, value, pattern)``.

    ``good(pattern, kind, known, instances, confidence)`` are the patterns with
    at least ``least_known`` known instances of a kind and a confidence, known /
    (instances + 1), of at least ``least_confidence``; ``known(kind, value,
    seed)`` are seeds and instances whose noisy-or over good patterns has reached
    ``least_score``.  An instance counts once per pattern however often it
    occurs, so copies of a text add nothing."""
    edges = written(marks.groupBy("pattern", "kind", "value").agg(F.max("seed").alias("seed")), "edges")
    sizes = written(edges.select("pattern", "value").distinct().groupBy("pattern").agg(
        F.count(F.lit(1)).alias("instances")).where(F.col("instances") >= least_known), "sizes")
    known = written(edges.where("seed").select("kind", "value", F.lit(True).alias("seed")).distinct(), "known")
    good = None
    for _ in range(rounds):
        last = good
        held = edges.join(known.select("kind", "value"), ["kind", "value"]).groupBy("pattern", "kind").agg(
            F.count(F.lit(1)).alias("known")).where(F.col("known") >= least_known)
        good = written(held.join(sizes, "pattern").withColumn(
            "confidence", F.col("known") / (F.col("instances") + 1)).where(F.col("confidence") >= least_confidence), "good")
        if last is not None:
            discard(last)
        score = edges.where("not seed").join(good.select("pattern", "kind", "confidence"), ["pattern", "kind"]).groupBy(
            "kind", "value").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score")).where(
            F.round("score", 9) >= least_score).select("kind", "value")
        new = written(score.join(known, ["kind", "value"], "left_anti").withColumn("seed", F.lit(False)), "new")
        if new.isEmpty():
            break
        before, known = known, written(known.union(new), "known")
        discard(before, new)
    discard(edges, sizes)
    return known, good


def personal_data(docs: DataFrame, **limits) -> DataFrame:
    """The columns of ``docs(text, ...)`` but ``text``, with ``base`` and
    ``spans``: sorted arrays of (start, kind, end), offsets in code points, end
    exclusive, ``kind`` the place in ``KINDS``.

    ``spans`` holds the base spans and the mentions that the method adds: those
    whose identifier is a seed elsewhere, and those of known identifiers in a
    confident context.  Null texts are empty; texts without identifiers have
    empty arrays; rows may repeat, also with other texts, and each has its own
    row.  Input columns ``text_digest``, ``marks``, ``base`` and ``spans`` are
    replaced."""
    found = written(find_marks(docs.drop("spans")), "marks")
    mention = found.select("text_digest", F.explode("marks").alias("m")).select(
        "text_digest", "m.seed", "m.start", "m.end", F.explode(F.arrays_zip("m.kinds", "m.values")).alias("v"), "m.patterns").select(
        "text_digest", "seed", "start", "end", F.col("v.kinds").alias("kind"), F.col("v.values").alias("value"), "patterns")
    known, good = bootstrap(mention.select("seed", "kind", "value", F.explode("patterns").alias("pattern")), **limits)
    open_ = written(mention.where("not seed").distinct().join(known.withColumnRenamed("seed", "sure"), ["kind", "value"]), "open")
    sure = open_.where("sure").select("text_digest", "start", "end", "kind", F.lit(1.0).alias("weight"))
    told = open_.where("not sure").select("text_digest", "start", "end", "kind", F.explode("patterns").alias("pattern")).join(
        good.select("pattern", "kind", F.col("confidence").alias("weight")), ["pattern", "kind"]).drop("pattern")
    # a mention has one kind: the best supported, then the first in order
    kinds = sure.unionByName(told).groupBy("text_digest", "start", "end").agg(
        F.max(F.struct("weight", (-F.col("kind")).alias("kind"))).alias("best"))
    added = written(kinds.groupBy("text_digest").agg(F.collect_list(F.struct(
        "start", (-F.col("best.kind")).alias("kind"), "end")).alias("added")), "added").withColumnRenamed("text_digest", "_digest")
    return found.join(added, found["text_digest"] == added["_digest"], "left").withColumn(
        "spans", F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(f"array<{_SPAN}>"))))).drop(
        "_digest", "added", "marks", "text_digest")


def span_list(spans):
    """``kind:start:end`` of an array of spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")
