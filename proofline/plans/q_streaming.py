"""Arriving responses as a stream: checked, stored, folded into run progress."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from proofline.operators.checks import Check
from proofline.plans.registry import query
from proofline.session import checkpoint_dir
from proofline.sources import tables as T
from proofline.streaming import progress as P


SQL_PROGRESS = """
SELECT user_id AS run_id, count(*) AS done, count_if(value <= 25) AS passed,
  count(*) + CASE WHEN user_id % 5 = 0 THEN 1 ELSE 0 END AS cases_total,
  CASE WHEN user_id % 5 = 0 THEN 'pending' ELSE 'ready_for_review' END AS state
FROM events GROUP BY user_id"""


def _delivered(spark, sf_dir, take):
    """All events as responses, delivered in two drops: first the later half of each run's
    events together with every tenth event of the earlier half, then the whole earlier half
    (late, and partly for the second time). ``take(stream, root)`` runs after each drop, the
    second time as a restart on the first one's checkpoint. Returns (root, totals): every fifth
    run expects one case more than ever arrives."""
    root = f"{checkpoint_dir(spark)}/stream-events-{uuid.uuid4().hex}"
    e = T.table(spark, sf_dir, "events")
    resp = e.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("suite_id"),
                    F.col("event_id").alias("case_id"), F.col("props").alias("body"),
                    F.col("value").alias("latency_ms"))
    totals = resp.groupBy("run_id").agg(
        (F.count(F.lit(1)) + F.when(F.col("run_id") % 5 == 0, 1).otherwise(0)).alias("cases_total"))
    late = F.col("case_id") % 2 == 0
    for drop in (~late | (F.col("case_id") % 20 == 0), late):
        resp.where(drop).write.mode("append").parquet(f"{root}/drop")
        stream = P.checked(P.response_stream(spark, f"{root}/drop", resp.schema),
                           [Check("latency_bound", {"max_ms": 25})], P.CASE)
        take(stream, root, totals)
    return root, totals


def _tracked(spark, sf_dir):
    def take(stream, root, totals):
        P.track_progress(stream, P.ProgressTable(spark, f"{root}/progress", compact_every=2),
                         f"{root}/checkpoint", totals)
    root, totals = _delivered(spark, sf_dir, take)
    return P.ProgressTable(spark, f"{root}/progress"), totals


@query("stream_results", sql=SQL_PROGRESS)
def stream_results(spark, sf_dir):
    """STR-1/4: results stored per micro-batch, progress folded from the stored cases."""
    root, totals = _delivered(spark, sf_dir, lambda stream, root, totals: P.store_results(
        stream, f"{root}/results", f"{root}/checkpoint"))
    return P.progress(P.stored_cases(spark, f"{root}/results"), totals)


@query("stream_progress", sql=SQL_PROGRESS)
def stream_progress(spark, sf_dir):
    """STR-3: progress from the stream's state, through the versioned table."""
    table, totals = _tracked(spark, sf_dir)
    return P.states(table.current(), totals)


@query("stream_ready", sql="""
SELECT user_id AS run_id, count(*) AS done, count(*) AS cases_total, 'ready_for_review' AS state,
  CASE WHEN bool_or(event_id % 2 = 0 AND event_id % 20 <> 0) THEN 1 ELSE 0 END AS "at"
FROM events GROUP BY user_id HAVING user_id % 5 <> 0""")
def stream_ready(spark, sf_dir):
    """STR-2: the runs that got all their cases, each once, with the micro-batch that completed it."""
    return _tracked(spark, sf_dir)[0].ready().select("run_id", "done", "cases_total", "state", "at")
