"""As-of join: for every row the last event of its group before it (JON-12, WIN-2).

A few groups may hold everything, so no step works on a whole group. What matters of a row is its
group and time alone: rows and events are first reduced to their distinct times (combined
map-side), so a third of all rows at one moment is one pair. Times fall into buckets of
``bucket_seconds``. An event of the row's own bucket is found there, by a window over the distinct
times of one bucket; otherwise the answer is the last event of an earlier bucket, a running
maximum over one row per bucket of a group. Rows meet their answer under salts, since many may
share one.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 16


def bucket_of(at: Column, seconds: int) -> Column:
    """Number of the bucket of a date or timestamp."""
    return F.floor(F.unix_micros(at.cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")


def asof_join(rows: DataFrame, events: DataFrame, group: str, at: str, event_at: str, seq: str,
              values: list[str], row_id: str, bucket_seconds: int = 86_400) -> DataFrame:
    """The rows with ``values`` of the event of their group that is last by (event_at, seq) among
    those strictly before ``at``; null where there is none. A null group or time, of a row or an
    event, matches nothing. ``row_id`` only spreads rows over salts."""
    moments = rows.where(F.col(group).isNotNull() & F.col(at).isNotNull()).select(
        F.col(group).alias("_g"), F.col(at).alias("_t")).distinct()
    last = F.max_by(F.struct(*values), F.col(seq)).alias("_v")
    known = events.where(F.col(group).isNotNull() & F.col(event_at).isNotNull()).groupBy(
        F.col(group).alias("_g"), F.col(event_at).alias("_t")).agg(last)
    none = F.lit(None).cast(known.schema["_v"].dataType)
    both = known.select("_g", "_t", "_v", F.lit(False).alias("_ask")).unionByName(
        moments.select("_g", "_t", none.alias("_v"), F.lit(True).alias("_ask")))
    both = both.withColumn("_b", bucket_of(F.col("_t"), bucket_seconds))
    # distinct times of one bucket: the answer within it; at one time the row comes first
    inside = Window.partitionBy("_g", "_b").orderBy("_t", F.desc("_ask")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    asked = both.withColumn("_here", F.last("_v", ignorenulls=True).over(inside)).where("_ask")
    # one row per group and bucket: the last event of the bucket, then of all buckets before
    ends = both.groupBy("_g", "_b").agg(F.max_by("_v", F.when(~F.col("_ask"), F.col("_t"))).alias("_v"))
    before = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_g", "_b", F.last("_v", ignorenulls=True).over(before).alias("_earlier"))
    answers = (asked.join(carried, ["_g", "_b"]).select("_g", "_t", F.coalesce("_here", "_earlier").alias("_v"))
               .where("_v is not null")
               .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(row_id), F.lit(SALTS)).cast("int"))
    hit = ((salted[group] == answers["_g"]) & (salted[at] == answers["_t"]) & (salted["_salt"] == answers["_salt"]))
    return salted.join(answers, hit, "left").select(*[salted[c] for c in rows.columns],
                                                    *[F.col("_v")[v].alias(v) for v in values])
