"""Append-only review logs folded into current state (WIN-1..7,9; REV-1..5; JON-11).

"Latest per group" is an aggregate, not a window: ``max_by(value, (time, id))`` is
combined map-side, so a group holding a third of the log costs one partial row per
input partition. Ties on time are broken by id (deviation D-2).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- fixed values that must equal the reference's --------------------------------
# Legal report state changes (from -> to); "done" is final.
VALID_TRANSITIONS = [("pending", "ready_for_review"), ("ready_for_review", "done"),
                     ("ready_for_review", "pending")]
REVIEWER_ROLES = ["reviewer", "admin"]
# -----------------------------------------------------------------------------------


def latest(df: DataFrame, keys: list[str], order: list[str], values: list[str],
           where: Column | None = None) -> DataFrame:
    """One row per group: the ``values`` of the row that is last by ``order``."""
    src = df if where is None else df.where(where)
    pick = F.max_by(F.struct(*values), F.struct(*order)).alias("_last")
    return src.groupBy(*keys).agg(pick).select(*keys, "_last.*")


def effective_adjudication(log: DataFrame, case_keys: list[str], at: str = "at",
                           seq: str = "adjudication_id") -> DataFrame:
    """WIN-7: the last log row per case decides; ``clear`` leaves no verdict, but
    actor and time are still the last row's."""
    last = latest(log, case_keys, [at, seq], ["action", "verdict", "actor", at])
    return last.withColumn("human_verdict",
                           F.when(F.col("action") == "clear", F.lit(None)).otherwise(F.col("verdict")))


def activation_status(versions: DataFrame, activations: DataFrame, pipeline: str = "pipeline_id",
                      version: str = "version_id", at: str = "at", seq: str = "activation_id") -> DataFrame:
    """WIN-6: the version activated last is active, others that ever were are archived, the rest
    stay draft. ``activations`` is a log: a version may be activated again and again. Versions
    meet one row per activated version, never one row per pipeline."""
    last = latest(activations, [pipeline], [at, seq], [version]).select(
        F.col(version).alias("_v"), F.lit(True).alias("_active"))
    ever = activations.select(F.col(version).alias("_v")).distinct().join(last, "_v", "left")
    j = versions.join(ever, versions[version] == ever["_v"], "left")
    status = F.when(F.col("_active"), "active").when(F.col("_v").isNotNull(), "archived").otherwise("draft")
    return j.withColumn("status", status).drop("_active", "_v")


def state_fold(transitions: DataFrame, reports: DataFrame, report: str, at: str, seq: str,
               initial: str = "pending") -> DataFrame:
    """REV-1: the state of every report: the last ``to_state``, or ``initial`` without one."""
    last = latest(transitions, [report], [at, seq], ["to_state"])
    return reports.select(report).join(last, report, "left").select(
        report, F.coalesce("to_state", F.lit(initial)).alias("state"))


def illegal_transitions(transitions: DataFrame, report: str, at: str, seq: str,
                        initial: str = "pending") -> DataFrame:
    """REV-1 audit: transitions that the state machine does not allow, or whose own
    ``from_state`` is not the state the report was in. The log's ``from_state`` is kept, beside
    it ``actual_state``.

    Self-loops are accepted: reviewer assignment logs ``from = to`` (REV-2). The previous state
    needs the ordered log of one report, what people did to it, so this is a window.
    """
    w = Window.partitionBy(report).orderBy(at, seq)
    rows = transitions if "from_state" in transitions.columns else transitions.withColumn(
        "from_state", F.lit(None).cast("string"))
    rows = rows.withColumn("actual_state", F.coalesce(F.lag("to_state").over(w), F.lit(initial)))
    allowed = F.col("actual_state") == F.col("to_state")
    for a, b in VALID_TRANSITIONS:
        allowed = allowed | ((F.col("actual_state") == a) & (F.col("to_state") == b))
    claimed = F.col("from_state").isNull() | (F.col("from_state") == F.col("actual_state"))
    return rows.where(~(allowed & claimed))


def assigned_reviewers(assignments: DataFrame, report: str = "report_id", at: str = "at",
                       seq: str = "transition_id") -> DataFrame:
    """REV-2: the reviewer assigned last to each report, by whom and when."""
    return latest(assignments, [report], [at, seq], ["reviewer", "actor", at])


def actor_reason(actor: Column, roles: Column, n_users: int, mode: str = "open") -> Column:
    """REV-5: why an actor may not act, NULL if they may. ``roles``: the actor's role, NULL for
    an unknown one; with no users at all anybody is trusted in open mode, nobody in enforced."""
    if mode not in ("open", "enforced"):
        raise ValueError(f"mode is open or enforced, not {mode!r}")
    if n_users == 0:
        return F.lit("no reviewer accounts configured" if mode == "enforced" else None).cast("string")
    return F.when(~F.coalesce(roles.isin(REVIEWER_ROLES), F.lit(False)), "actor lacks reviewer authority")


def validate_adjudications(attempts: DataFrame, reports: DataFrame, users: DataFrame, case_runs: DataFrame,
                           mode: str = "open", verdict: str = "verdict", reason: str = "reason") -> DataFrame:
    """REV-3: adjudication attempts (report_id, case_id, actor, verdict, reason, ...) accepted or
    rejected with the first rule they break: actor, report known, unlocked, ready_for_review, a
    reason to set a verdict (blanks are one), case in the report. ``reports``: report_id, run_id,
    state, locked (optional: done), as they stand while the attempts are made; a log in which
    the state changes between attempts goes through ``replay.replay_reviews``. ``case_runs``:
    case_id, run_id; ``users``: name, role."""
    n_users = users.limit(1).count()
    locked = F.col("locked") if "locked" in reports.columns else F.col("state") == "done"
    rep = reports.select("report_id", F.col("run_id").alias("_run"), F.col("state").alias("_state"), locked.alias("_locked"))
    j = (attempts.join(rep, "report_id", "left")
         .join(users.select(F.col("name").alias("actor"), F.col("role").alias("_role")), "actor", "left")
         .join(case_runs.select("case_id", F.col("run_id").alias("_case_run")).distinct(), "case_id", "left"))
    why = (F.when(actor_reason(F.col("actor"), F.col("_role"), n_users, mode).isNotNull(),
                  actor_reason(F.col("actor"), F.col("_role"), n_users, mode))
           .when(F.col("_state").isNull(), "report not found")
           .when(F.col("_locked"), "report is locked")
           .when(F.col("_state") != "ready_for_review", "report is not ready_for_review")
           .when(F.col(verdict).isNotNull() & (F.coalesce(F.col(reason), F.lit("")) == ""),
                 "reason required when setting a verdict")
           .when(F.col("_case_run").isNull() | (F.col("_case_run") != F.col("_run")), "case not in report"))
    return j.withColumn("accepted", why.isNull()).withColumn("reject_reason", why).drop(
        "_run", "_state", "_locked", "_role", "_case_run")


def validate_verdicts(attempts: DataFrame, reports: DataFrame, users: DataFrame, summaries: DataFrame,
                      mode: str = "open", order: list[str] | None = None) -> DataFrame:
    """REV-4: report verdicts (report_id, verdict, reason, actor) accepted or rejected; an
    accepted one locks the report and carries the summary recomputed from effective results
    (``summaries``: run_id, cases, passed). Checked in order: verdict value, a reason that is
    not blank, actor, report known, state. Of several verdicts on one report that pass all this,
    the first by ``order`` (default: all columns) locks it and the others come too late; equal
    rows are one attempt."""
    n_users = users.limit(1).count()
    j = (attempts.join(reports.select("report_id", F.col("run_id").alias("_run"), F.col("state").alias("_state")),
                       "report_id", "left")
         .join(users.select(F.col("name").alias("actor"), F.col("role").alias("_role")), "actor", "left"))
    no_actor = actor_reason(F.col("actor"), F.col("_role"), n_users, mode)
    why = (F.when(~F.coalesce(F.col("verdict").isin("pass", "fail"), F.lit(False)), "verdict must be 'pass' or 'fail'")
           .when(F.coalesce(F.trim("reason"), F.lit("")) == "", "reason required")
           .when(no_actor.isNotNull(), no_actor).when(F.col("_state").isNull(), "report not found")
           .when(F.col("_state") != "ready_for_review", F.concat(F.lit("illegal transition "), "_state", F.lit(" -> done"))))
    s = summaries.select(F.col("run_id").alias("_run"), "cases", "passed")
    ok = F.col("reject_reason").isNull()
    when = F.struct(*(order or attempts.columns))
    j = j.withColumn("reject_reason", why)
    first = j.where(ok).groupBy(F.col("report_id").alias("_locked")).agg(F.min(when).alias("_first"))
    late = ok & (when != F.col("_first"))
    j = j.join(first, j["report_id"] == first["_locked"], "left").withColumn(
        "reject_reason", F.when(late, "illegal transition done -> done").otherwise(F.col("reject_reason")))
    return j.join(s, "_run", "left").select(
        *attempts.columns, "reject_reason", ok.alias("locked"), F.when(ok, "done").alias("new_state"),
        F.when(ok, F.coalesce("cases", F.lit(0))).alias("cases"), F.when(ok, F.coalesce("passed", F.lit(0))).alias("passed"))


def submit_events(reports: DataFrame, runs: DataFrame, targets: DataFrame, versions: DataFrame,
                  summaries: DataFrame) -> DataFrame:
    """REV-6 / JON-2: the event of every report that is submitted: report, run, target and
    version (NULL for a run without one) as one JSON payload. ``reports``: report_id, run_id,
    reviewer; ``runs``: run_id, project, target_id, version_id; ``targets``: target_id, adapter,
    model; ``versions``: version_id, version_number, content_hash; ``summaries``: run_id, cases,
    passed, failed."""
    j = (reports.join(runs, "run_id").join(targets, "target_id").join(versions, "version_id", "left")
         .join(summaries, "run_id", "left"))
    summary = F.struct(*[F.coalesce(c, F.lit(0)).alias(c) for c in ("cases", "passed", "failed")])
    payload = F.struct(
        F.lit("ready_for_review").alias("event"), "report_id", "run_id", "project", summary.alias("summary"),
        F.col("reviewer").alias("assigned_reviewer"), F.struct("adapter", "model").alias("target"),
        F.when(F.col("version_number").isNotNull(), F.struct(
            F.col("version_id").alias("id"), "version_number", "content_hash")).alias("pipeline_version"))
    return j.select("report_id", F.to_json(payload).alias("payload"))


def reviewers(users: DataFrame) -> DataFrame:
    """REL-6: names that may review, in order."""
    return users.where(F.col("role").isin(REVIEWER_ROLES)).select("name", "role").orderBy("name")


def non_reviewer_actions(actions: DataFrame, users: DataFrame, actor: str = "actor") -> DataFrame:
    """JON-11: actions by an actor who is not a reviewer or admin (left anti join)."""
    reviewers = users.where(F.col("role").isin(REVIEWER_ROLES)).select(F.col("name").alias(actor))
    return actions.join(reviewers, actor, "left_anti")
