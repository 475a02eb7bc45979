"""Benchmark decontamination by template canonicalisation.

Numbers, names and units of a text become typed placeholders, so a question
with other numbers or names has the same template.  Windows of template words
are hash-joined between documents and benchmark items; slot values of matching
windows are then compared: along one alignment equal slots of the item must be
equal in the document and different ones different, as in a re-parameterised
question.  Beside this form each text has a plain one, whose names are words
like others, for copies in other letter case or without punctuation and for
items that are names throughout.  A window that is mostly placeholders is compared by its words and
slot values as they are.  An item is found where consistent alignments cover
enough of its words.

A filter of bounded size over the benchmark's windows lets few other document
windows through to the exact join; nothing else is broadcast by hand.
"""

from __future__ import annotations

from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, filter_bits, hash_filter, may_hold, mix, skew_join, slices, written

# Words read as numbers and as units.
NUMBER_WORDS = """zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen
sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million
billion half twice double triple""".split()
UNIT_WORDS = """mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer
kilometers kilometre kilometres g kg mg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons
tonne tonnes l ml liter liters litre litres gallon gallons s sec secs second seconds min mins minute minutes h hr hrs
hour hours day days week weeks month months year years dollar dollars cent cents euro euros usd eur gbp percent
degree degrees celsius fahrenheit kelvin watt watts kw volt volts amp amps joule joules newton newtons pascal pascals
mph kph byte bytes kb mb gb tb""".split()

_WORD, _NUMBER, _UNIT, _NAME = range(4)
_EDGE = ".,;:!?\"'()[]{}<>“”‘’«»…*_#|-–—$€£¥"
_INSIDE = dict.fromkeys(map(ord, "'’‐-"))
_FACTORS = np.random.default_rng(77).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_EXACT = np.uint64(0x9E3779B97F4A7C15)                   # apart from the template of the same words
_KINDS = {**dict.fromkeys(UNIT_WORDS, _UNIT), **dict.fromkeys(NUMBER_WORDS, _NUMBER)}


# a word's traits: its kind in the low bits, then
_TITLE, _ENDS, _EMPTY = 4, 8, 16                         # capitalised, ends a sentence, of marks alone


class _Words(dict):
    """Word -> its place in two tables, of hashes and of traits."""

    def __init__(self, bound: int = 150_000):
        super().__init__()
        self.bound = bound
        self.hashes, self.traits = array("Q"), array("B")

    def __missing__(self, word: str) -> int:
        i = self[word] = len(self)
        if word.isalpha():                               # most words
            low = word.casefold()                        # straße and STRASSE are one word
            traits = _KINDS.get(low, _WORD)
            if traits == _WORD and len(word) > 1 and word[0].isupper() and word[1:].islower():
                traits = _TITLE
        else:
            core = word.strip(_EDGE)
            low = core.casefold()
            if core.isalpha():
                traits = _KINDS.get(low, _WORD)
            elif core and core[0].isdigit() or core[1:2].isdigit() and core[0] in "+-.":
                traits = _NUMBER
            else:
                traits = _WORD
                low = low.translate(_INSIDE) or low      # don't and dont are one word
            if traits == _WORD and len(core) > 1 and core[0].isupper() and core[1:].islower():
                traits = _TITLE
            if word.rstrip("\"'”’)]»")[-1:] in (".", "!", "?", ":"):
                traits |= _ENDS
            if not core:
                traits |= _EMPTY
        self.hashes.append(xxhash.xxh3_64_intdigest(low.encode("utf-8", "surrogatepass")))
        self.traits.append(traits)
        return i

    def rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) + len(words) > self.bound:
            self.clear()
            self.hashes, self.traits = array("Q"), array("B")
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if not len(at):
            return np.empty(0, np.uint64), np.empty(0, np.uint8)
        return np.frombuffer(self.hashes, np.uint64)[at], np.frombuffer(self.traits, np.uint8)[at]


Form = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]

_NAMES, _PLAIN = range(2)


def forms(text: str | None, words: _Words) -> tuple[Form, Form]:
    """The two forms of a text, each (codes, is placeholder, slot value, first
    word).  In the plain form names are words like others, so neither letter case
    nor sentence marks matter.  In the other, a name is a title-case word that
    doesn't begin a sentence, and neighbouring names are one placeholder.  Words
    of punctuation alone are left out."""
    h, f = words.rows((text or "").split())
    stays = f & _EMPTY == 0
    begins = np.r_[True, f[:-1] & _ENDS > 0][:len(f)][stays]
    h, f = h[stays], f[stays]
    kind = f & 3
    every = np.arange(len(h))
    plain = np.where(kind == _WORD, h, kind.astype(np.uint64)), kind != _WORD, h, every
    name = (f & _TITLE > 0) & ~begins
    if not name.any():
        return plain, plain
    kind = np.where(name, _NAME, kind)
    at = every[~(name & np.r_[False, name[:-1]])]
    value, kind = np.add.reduceat(h, at), kind[at]
    return (np.where(kind == _WORD, value, kind.astype(np.uint64)), kind != _WORD, value, at), plain


def template(text: str | None, words: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, is placeholder, slot value) of a text's template with names."""
    return forms(text, words)[_NAMES][:3]


def windows(codes: np.ndarray, slot: np.ndarray, value: np.ndarray, sizes: list[int]) -> Iterator[np.ndarray]:
    """For each of the rising ``sizes`` the hash of the window of so many words
    from each word on.  A window that is mostly placeholders says little by its
    template: its hash holds the slot values too.  One pass: a longer window's
    sum goes on from a shorter one's."""
    some = bool(slot.any())
    total, filled, values = np.zeros(len(codes), np.uint64), np.zeros(len(codes), np.int16), np.zeros(len(codes), np.uint64)
    done = 0
    for size in sizes:
        n = max(len(codes) - size + 1, 0)
        total, filled, values = total[:n], filled[:n], values[:n]
        for i in range(done, size):
            total = total + codes[i:n + i] * _FACTORS[i]
            if some:
                filled = filled + slot[i:n + i]
                values = values + value[i:n + i] * _FACTORS[i]
        done = size
        out = np.where(2 * filled > size, _EXACT + values, total) if some else total
        yield mix(out + np.uint64(size)).view(np.int64)


def _slots(slot: np.ndarray, value: np.ndarray, at: int, size: int) -> list[int]:
    return value[at:at + size][slot[at:at + size]].view(np.int64).tolist()


def item_windows(benchmark: DataFrame, size: int, least_words: int) -> DataFrame:
    """(hash, form, item_id, at, size, from, to, words, slots), a row per window:
    the words of the item from ``from`` up to ``to`` are the window's.  An item
    without names has the plain form alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(50_000)
        out = defaultdict(list)
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                both = forms(text, words)
                n = len(both[_PLAIN][0])
                if item is None:
                    continue
                for form, (codes, slot, value, first) in enumerate(both):
                    k = min(size, len(codes))
                    if k < least_words or form == _NAMES and both[_NAMES] is both[_PLAIN]:
                        continue
                    ends = np.r_[first[1:], n]
                    for at, h in enumerate(next(windows(codes, slot, value, [k]))):
                        for c, v in (("hash", int(h)), ("form", form), ("item_id", item), ("at", at), ("size", k),
                                     ("from", int(first[at])), ("to", int(ends[at + k - 1])), ("words", n),
                                     ("slots", _slots(slot, value, at, k))):
                            out[c].append(v)
        if out:
            yield pa.RecordBatch.from_pydict(dict(out), schema=pa.schema(
                [("hash", pa.int64()), ("form", pa.int32()), ("item_id", pa.int64()), ("at", pa.int32()), ("size", pa.int32()),
                 ("from", pa.int32()), ("to", pa.int32()), ("words", pa.int32()), ("slots", pa.list_(pa.int64()))]))

    return benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(
        run, "hash long, form int, item_id long, at int, size int, `from` int, `to` int, words int, slots array<long>").distinct()


_HIT = "doc_id long, item_id long, covered long, words long, cover double, consistency double, same_slots boolean"


def _longest_run(spans: list[tuple[int, int]]) -> int:
    """Words in the longest stretch that the spans cover without a gap."""
    best, start, end = 0, 0, -1
    for a, b in sorted(spans):
        if a > end:
            start, end = a, b
        end = max(end, b)
        best = max(best, end - start)
    return best


def _judge(least_cover: float, least_consistency: float, least_run: int):
    def judge(key, table):
        doc, item = (k.as_py() for k in key)
        rows = table.select(["form", "dpos", "at", "from", "to", "words", "dslots", "slots"]).to_pylist()
        words = rows[0]["words"]
        lines = defaultdict(list)
        for r in rows:
            lines[r["form"], r["dpos"] - r["at"]].append(r)
        covered, agree, of, same, run = set(), 0, 0, True, 0
        for line in lines.values():
            pairs = Counter()
            for r in line:
                pairs.update(zip(r["slots"], r["dslots"]))
            total, share = sum(pairs.values()), 1.0
            if total:
                there, back = defaultdict(int), defaultdict(int)
                for (a, b), c in pairs.items():
                    there[a] = max(there[a], c)
                    back[b] = max(back[b], c)
                share = min(sum(there.values()), sum(back.values())) / total
            if share < least_consistency:
                continue
            agree, of = agree + share * total, of + total
            same = same and all(a == b for a, b in pairs)
            for r in line:
                covered.update(range(r["from"], r["to"]))
            run = max(run, _longest_run([(r["from"], r["to"]) for r in line]))
        hit = covered and (len(covered) >= least_cover * words or run >= least_run)
        row = [doc, item, len(covered), words, len(covered) / words, agree / of if of else 1.0, same]
        return pa.table({f.split()[0]: pa.array([v] if hit else [], t) for f, v, t in zip(
            _HIT.split(", "), row, [pa.int64()] * 4 + [pa.float64()] * 2 + [pa.bool_()])})
    return judge


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 5, least_cover: float = 0.6,
                 least_consistency: float = 0.8, least_words: int = 3, least_run: int = 50) -> DataFrame:
    """One row per ``(doc_id, item_id)`` found: item words covered and in all,
    their share, the share of slots that agree with a one-to-one renaming, and
    whether all slot values are the same.

    Reads ``docs(doc_id, text)`` and ``benchmark(item_id, text)`` only.  Null
    and empty texts match nothing; items of under ``least_words`` words are no
    evidence and match nothing; shorter items than a window match as a whole.  An
    item is found by its share of words (``least_cover``), or by ``least_run``
    of its words in one unbroken run, however long it is.  Rows that share a
    doc_id are judged together."""
    spark = docs.sparkSession
    items = written(item_windows(benchmark, size, least_words), "items")
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())           # `size` of them at most
    bits = spark.sparkContext.broadcast(hash_filter(items.select("hash"), filter_bits(items.count())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for b in (part for batch in batches for part in slices(batch, 1)):
            ids, form, pos, hashes, slots = [], [], [], [], []

            def add(doc, of, codes, slot, value, first):
                for k, h in zip(sizes, windows(codes, slot, value, sizes)):
                    at = np.flatnonzero(may_hold(bits.value, h))
                    for p, x in zip(at.tolist(), h[at].tolist()):
                        there = _slots(slot, value, p, k)
                        for kind in of:
                            ids.append(doc)
                            form.append(kind)
                            pos.append(p)
                            hashes.append(x)
                            slots.append(there)

            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                named, plain = forms(text, words)
                if named is plain:
                    add(doc, (_NAMES, _PLAIN), *plain)
                else:
                    add(doc, (_NAMES,), *named)
                    add(doc, (_PLAIN,), *plain)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(form, pa.int32()), pa.array(pos, pa.int32()),
                 pa.array(hashes, pa.int64()), pa.array(slots, pa.list_(pa.int64()))],
                ["doc_id", "form", "dpos", "hash", "dslots"])

    near = written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, form int, dpos int, hash long, dslots array<long>"), "windows")
    bits.destroy()
    # item windows stay rows of their own: a window that a third of all items share is split like any hot key
    pairs = skew_join(near, items.withColumnRenamed("form", "item_form"), "hash").where("form = item_form")
    found = written(pairs.select("doc_id", "item_id", "form", "dpos", "dslots", "at", "from", "to", "words", "slots")
                    .groupBy("doc_id", "item_id").applyInArrow(_judge(least_cover, least_consistency, least_run), _HIT), "found")
    discard(near, items)
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs`` whose doc_id holds no benchmark item."""
    hits = contaminated(docs, benchmark, **limits)
    found = written(hits.select(F.col("doc_id").alias("_found")).distinct(), "leaks")
    discard(hits)
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_found"]), "left_anti")
