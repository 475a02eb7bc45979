"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in an order by hash, are cut into blocks of equal
length.  With integer shares ``a`` of a period of ``T = sum(a)`` slots, block
``i`` of a source is released at slot ``floor(i T / a)`` and due by slot
``ceil((i + 1) T / a)``; earliest deadline first then fills one slot with one
block, and at each slot every source has had its share to within one block.

The schedule repeats with each period, so the driver lays out one period (its
length is the sum of the shares, whatever the data) and the slot of any block
follows by arithmetic in the plan.  When a source runs out, the others go on
with their shares among themselves: a new phase.  Every document gets a slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OTHER = "*"


def period(shares: dict[str, int]) -> list[tuple[str, int]]:
    """(source, its block) of each slot of one period, by earliest deadline."""
    total = sum(shares.values())
    taken = dict.fromkeys(shares, 0)
    out = []
    for t in range(total):
        ready = [s for s, a in shares.items() if taken[s] < a and taken[s] * total // a <= t]
        s = min(ready, key=lambda s: (-(-(taken[s] + 1) * total // shares[s]), s))
        out.append((s, taken[s]))
        taken[s] += 1
    return out


def schedule(shares: dict[str, int], blocks: dict[str, int]) -> list[tuple]:
    """Rows (source, phase, first block, end block, first slot, share, period,
    slots of the source in a period): where each source's blocks go."""
    left, at, start, phase, rows = {s: n for s, n in blocks.items() if n}, 0, dict.fromkeys(blocks, 0), 0, []
    while left:
        now = {s: shares[s] for s in sorted(left)}
        plan = period(now)
        total = len(plan)
        slots = {s: [t for t, (x, _) in enumerate(plan) if x == s] for s in now}
        spent = {s: (left[s] - 1) // now[s] * total + slots[s][(left[s] - 1) % now[s]] + 1 for s in now}
        length = min(spent.values())                     # the phase ends as the first source runs out
        for s, a in now.items():
            used = length // total * a + sum(t < length % total for t in slots[s])
            if used:
                rows.append((s, phase, start[s], start[s] + used, at, a, total, slots[s]))
            start[s] += used
            left[s] -= used
        left = {s: n for s, n in left.items() if n}
        at += length
        phase += 1
    return rows


def mix_sources(docs: DataFrame, shares: dict[str, int], other_share: int = 1, block_chars: int = 1 << 18,
                buckets: int = 1024, bucket_chars: int = 64 << 20, seed: int = 7) -> DataFrame:
    """All columns of ``docs(doc_id, text, source, ...)`` plus ``mix_class``,
    ``block``, ``phase``, ``slot`` and ``offset`` (of the document in its class,
    in code points): read in order of (slot, offset) the rows are the mix.

    Sources (null included) that ``shares`` doesn't list form one class ``*``
    with ``other_share``; a share below 1 is a ValueError.  A document belongs to the block where it starts; a
    longer one fills the following blocks too.  Null or empty texts have length
    0.  Rows that repeat a doc_id are placed each on its own; equal ones share a
    place's order.  Input columns of the output's names are replaced."""
    spark = docs.sparkSession
    docs = docs.drop("mix_class", "block", "phase", "slot", "offset")
    given = {k: int(v) for k, v in shares.items()}
    wrong = [k for k, v in {**given, OTHER: other_share}.items() if v < 1]
    if wrong:
        raise ValueError(f"shares below 1: {', '.join(wrong)}")
    cls = F.when(F.col("source").isin(list(given)), F.col("source")).otherwise(F.lit(OTHER))
    size = F.coalesce(F.char_length("text"), F.lit(0)).cast("long")
    key = F.xxhash64(F.lit(seed), "doc_id")
    totals = {r[0]: r[1] for r in docs.groupBy(cls).agg(F.sum(size)).collect()}             # a row per listed source
    plan = schedule({**given, OTHER: other_share}, {s: n // block_chars + 1 for s, n in totals.items()})
    # a source may hold a third of all rows: its running length is summed by bucket, then within each bucket, and there
    # are as many more buckets as the largest source asks for
    buckets = max(buckets, max(totals.values(), default=0) // bucket_chars + 1)
    at = (docs.withColumn("mix_class", cls).withColumn("_size", size).withColumn("_key", key)
          .withColumn("_bucket", F.pmod("_key", F.lit(buckets))))
    sums = (docs.select(cls.alias("mix_class"), F.pmod(key, F.lit(buckets)).alias("_bucket"), size.alias("_size"))
            .groupBy("mix_class", "_bucket").agg(F.sum("_size").alias("_sum")))
    before = Window.partitionBy("mix_class").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("mix_class", "_bucket", "_sum",
                         F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    # at most (sources + 1)^2 rows, each with at most the sum of the shares: bounded by the parameters
    table = F.broadcast(spark.createDataFrame(
        plan, "_class string, phase int, _from long, _to long, _slot0 long, _share long, _period long, _slots array<long>"))
    here = Window.partitionBy("mix_class", "_bucket").orderBy("_key", "doc_id", F.xxhash64("text")).rowsBetween(
        Window.unboundedPreceding, -1)
    at = (at.withColumn("_in", F.coalesce(F.sum("_size").over(here), F.lit(0)))
          .join(starts.select("mix_class", "_bucket", "_before"), ["mix_class", "_bucket"])
          .withColumn("offset", F.col("_before") + F.col("_in"))
          .withColumn("block", F.floor(F.col("offset") / block_chars).cast("long")))
    i = F.col("block") - F.col("_from")
    return (at.join(table, (at["mix_class"] == table["_class"]) & (at["block"] >= table["_from"]) & (at["block"] < table["_to"]))
            .withColumn("slot", F.col("_slot0") + F.floor(i / F.col("_share")) * F.col("_period")
                        + F.get("_slots", (i % F.col("_share")).cast("int")))
            .select(*[docs[c] for c in docs.columns], "mix_class", "block", "phase", "slot", "offset"))
