"""proofline: evaluate captured model outputs at table scale on Spark.

Checks are Column expressions over a ``responses`` table; everything downstream
(case gates, run summaries, verdict policies, coverage, review-log folds, judge
reductions, rollups and reports) is joins, aggregates and windows.
"""
from proofline.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
