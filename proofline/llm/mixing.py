"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in a fixed hash order, form blocks of ``block_size`` (documents, or
units of a size column). With integer shares that sum to A, block i of a source with share a
is released at slot floor(i*A/a) and due by ceil((i+1)*A/a); earliest deadline first among
released blocks serves one block a slot. As the shares fill every slot, each source is within
one block of its target at every slot, and the schedule repeats after A slots: so one period
of A slots is laid out once and every block's slot is arithmetic on its number. When a source
runs out, the rest go on with their shares among themselves in a new phase, so no document is
dropped or repeated; within a phase the deviation from the phase's shares stays below one
block.

What the driver handles is bounded by the shares it is given: one count per named source (all
other sources together count as one more) and a period of ``MAX_PERIOD`` slots at most. The
running number of a document in its source is never taken in one task: the hash cuts each
source into 2 ** ``BUCKET_BITS`` buckets, numbered apart, and bucket totals give the offsets.

Defined results: a null source and sources without a share are pooled under the share of
``other``; a null size counts as 0, a negative one too; a null id hashes like any other value;
repeated rows are numbered one after the other; ties of the hash are ordered by id; an empty
table gives no rows.
"""
from __future__ import annotations

import heapq
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.llm.common import free_name, whole_text, written

BLOCK_SIZE = 32
BUCKET_BITS = 10
MAX_PERIOD = 10_000
OTHER = "(other)"


def period(shares: dict[str, int]) -> list[str]:
    """The source served in each slot of one period: Pfair windows, earliest deadline first."""
    total = sum(shares.values())
    if total > MAX_PERIOD:
        raise ValueError(f"shares sum to {total}; {MAX_PERIOD} at most")
    waiting = [(0, s, 0) for s in sorted(shares) if shares[s]]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    slots = []
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * total // shares[s]), s, i))
        _, s, i = heapq.heappop(ready)
        slots.append(s)
        if i + 1 < shares[s]:
            heapq.heappush(waiting, ((i + 1) * total // shares[s], s, i + 1))
    return slots


def phases(blocks: dict[str, int], shares: dict[str, int]) -> list[dict]:
    """Phases until every source has run out: first slot, period length, and per source its
    first block and its slots within the period. Pure arithmetic on block counts."""
    left, done, start, out = {s: n for s, n in blocks.items() if n}, {}, 0, []
    while left:
        active = {s: shares[s] for s in left}
        slots = period(active)
        own = {s: [t for t, x in enumerate(slots) if x == s] for s in active}
        length = min((n - 1) // active[s] * len(slots) + own[s][(n - 1) % active[s]] + 1
                     for s, n in left.items())
        out.append({"start": start, "period": len(slots), "own": own,
                    "first": {s: done.get(s, 0) for s in active}})
        for s in list(left):
            whole, rest = divmod(length, len(slots))
            used = whole * active[s] + bisect_left(own[s], rest)
            done[s] = done.get(s, 0) + used
            left[s] -= used
            if not left[s]:
                del left[s]
        start += length
    return out


def numbered(docs: DataFrame, id_col: str, source: Column, size: Column, seed: int,
             bucket_bits: int) -> DataFrame:
    """_id, _h, _source, _size, _before: the sizes of all earlier documents of the source."""
    h = F.xxhash64(F.col(id_col).cast("string"), F.lit(seed))
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(whole_text("text")).alias("_t")
                       if "text" in docs.columns else F.lit(0).cast("long").alias("_t"),
                       source.alias("_source"), size.alias("_size"), h.alias("_h"))
    # the leading bits of the hash, so that buckets are in the order of the hash
    rows = rows.withColumn("_bucket", F.shiftright("_h", 64 - bucket_bits))
    totals = rows.groupBy("_source", "_bucket").agg(F.sum("_size").alias("n"))
    # one row per source and bucket: bounded by the shares and the bucket count
    before = totals.select("_source", "_bucket", F.coalesce(F.sum("n").over(
        Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_source", "_bucket").orderBy("_h", "_id", "_t").rowsBetween(
        Window.unboundedPreceding, -1)
    return (rows.withColumn("_in", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
            .join(before, ["_source", "_bucket"])
            .withColumn("_before", F.col("_in") + F.col("_offset")))


def mix(docs: DataFrame, shares: dict[str, int], other: int = 1, id_col: str = "doc_id",
        source_col: str = "source", size_col: str | None = None, block_size: int = BLOCK_SIZE,
        seed: int = 0, bucket_bits: int = BUCKET_BITS) -> DataFrame:
    """One row per document: id, source, block (number within its source), slot (place of the
    block in the mixed stream), place (of the document within the block), phase.
    ``shares``: source -> positive integer; ``other``: the share of all remaining sources."""
    if OTHER in shares or other < 1 or any(v < 1 for v in shares.values()):
        raise ValueError("shares are positive integers; '(other)' is taken")
    shares = shares | {OTHER: other}
    known = F.col(source_col).isin([s for s in shares if s != OTHER])
    source = F.when(known, F.col(source_col).cast("string")).otherwise(F.lit(OTHER))
    size = F.lit(1).cast("long") if size_col is None else F.greatest(
        F.coalesce(F.col(size_col).cast("long"), F.lit(0)), F.lit(0))
    rows = written(numbered(docs, id_col, source, size, seed, bucket_bits).select(
        "_id", "_t", "_h", "_source", "_before",
        F.floor(F.col("_before") / block_size).alias("block")), "mix-numbered")
    blocks = {r[0]: r[1] + 1 for r in rows.groupBy("_source").agg(F.max("block")).collect()}
    plan = phases(blocks, shares)
    # one row per phase, source and slot of a period: bounded by the shares
    table = [(p, s, x["start"], x["period"], x["first"][s], own) for p, x in enumerate(plan)
             for s, own in x["own"].items()]
    spark = docs.sparkSession
    steps = spark.createDataFrame(
        table, "phase int, _source string, start long, period long, first long, own array<int>")
    after = Window.partitionBy("_source").orderBy("phase")
    steps = steps.withColumn("next", F.coalesce(F.lead("first").over(after), F.lit((1 << 63) - 1)))
    at = F.col("block") - F.col("first")
    share = F.size("own")
    slot = (F.col("start") + F.floor(at / share) * F.col("period")
            + F.element_at("own", (at % share + 1).cast("int")))
    placed = (rows.join(F.broadcast(steps), "_source")
              .where((F.col("block") >= F.col("first")) & (F.col("block") < F.col("next"))))
    return placed.select(
        F.col("_id").alias(id_col), F.col("_source").alias(source_col), "block",
        slot.alias("slot"), (F.col("_before") - F.col("block") * block_size).alias("place"),
        "phase", F.col("_t").alias("text_hash"))


def mixed(docs: DataFrame, shares: dict[str, int], other: int = 1, id_col: str = "doc_id",
          source_col: str = "source", block_size: int = BLOCK_SIZE, seed: int = 0) -> DataFrame:
    """The rows of ``docs`` with their columns, range-partitioned and sorted by their place in
    the mixed stream, so that a written table holds them in that order."""
    places = mix(docs, shares, other, id_col, source_col, None, block_size, seed)
    at, pid, h = (free_name(docs, c) for c in ("_at", "_pid", "_hash"))
    places = places.groupBy(F.col(id_col).alias(pid), F.col("text_hash").alias(h)).agg(
        F.min(F.struct("slot", "place")).alias(at))
    own = docs[id_col].eqNullSafe(places[pid]) & (
        F.xxhash64(whole_text(docs["text"])) == places[h])
    return (docs.join(places, own).repartitionByRange(at).sortWithinPartitions(at)
            .select(*[docs[c] for c in docs.columns]))
