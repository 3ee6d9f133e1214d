"""Review-log folds, activation, latest-per-group and reviewer audits."""
from __future__ import annotations

from pyspark.sql import functions as F

from proofline.operators import results as RS
from proofline.operators import review as RV
from proofline.operators.replay import replay_reviews
from proofline.plans.registry import query
from proofline.sources import tables as T

# ---- logs derived from events (per user, ordered by (ts, event_id)) ----------------
# adjudications: click = set pass, view = set fail, error = clear; case = user_id.
# transitions:   click -> pending, view -> ready_for_review, purchase -> done; report = user_id.


def adjudication_log(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view", "error"))
    return e.select(
        F.col("user_id").alias("case_id"), F.col("event_id").alias("adjudication_id"),
        F.col("ts").alias("at"),
        F.when(F.col("event_type") == "error", "clear").otherwise("set").alias("action"),
        F.when(F.col("event_type") == "click", "pass").when(F.col("event_type") == "view", "fail")
        .alias("verdict"),
        F.concat(F.lit("rev"), (F.col("event_id") % 7).cast("string")).alias("actor"))


SQL_ADJ_LOG = """(SELECT user_id AS case_id, event_id AS adjudication_id, ts AS "at",
  CASE WHEN event_type = 'error' THEN 'clear' ELSE 'set' END AS action,
  CASE event_type WHEN 'click' THEN 'pass' WHEN 'view' THEN 'fail' END AS verdict,
  'rev' || CAST(event_id % 7 AS VARCHAR) AS actor
  FROM events WHERE event_type IN ('click', 'view', 'error'))"""


@query("adjudication_fold", headline=True, sql=f"""
SELECT case_id, action, verdict, actor, "at", CASE WHEN action = 'clear' THEN NULL ELSE verdict END AS human_verdict
FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY "at" DESC, adjudication_id DESC) AS rn
      FROM {SQL_ADJ_LOG}) WHERE rn = 1""")
def adjudication_fold(spark, sf_dir):
    return RV.effective_adjudication(adjudication_log(spark, sf_dir), ["case_id"])


def transition_log(spark, sf_dir):
    """Every fifth entry claims that the report was pending before."""
    e = T.table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view", "purchase"))
    to_state = (F.when(F.col("event_type") == "click", "pending")
                .when(F.col("event_type") == "view", "ready_for_review").otherwise("done"))
    return e.select(F.col("user_id").alias("report_id"), F.col("event_id").alias("transition_id"),
                    F.col("ts").alias("at"), F.when(F.col("event_id") % 5 == 0, "pending").alias("from_state"),
                    to_state.alias("to_state"))


SQL_TRANSITIONS = """(SELECT user_id AS report_id, event_id AS transition_id, ts AS "at",
  CASE WHEN event_id % 5 = 0 THEN 'pending' END AS from_state,
  CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'ready_for_review' ELSE 'done' END AS to_state
  FROM events WHERE event_type IN ('click', 'view', 'purchase'))"""


@query("state_fold", sql=f"""
SELECT o_orderkey AS report_id, coalesce(s.state, 'pending') AS state FROM orders LEFT JOIN
  (SELECT report_id, arg_max(to_state, ("at", transition_id)) AS state FROM {SQL_TRANSITIONS} GROUP BY 1) s ON s.report_id = o_orderkey""")
def state_fold(spark, sf_dir):
    """Every report has a state, also those without a transition."""
    reports = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("report_id"))
    return RV.state_fold(transition_log(spark, sf_dir), reports, "report_id", "at", "transition_id")


@query("illegal_transitions", sql=f"""
SELECT report_id, transition_id, from_state, actual_state, to_state FROM (
  SELECT report_id, transition_id, from_state, to_state,
    coalesce(lag(to_state) OVER (PARTITION BY report_id ORDER BY "at", transition_id), 'pending') AS actual_state
  FROM {SQL_TRANSITIONS})
WHERE NOT ((actual_state = 'pending' AND to_state = 'ready_for_review')
        OR (actual_state = 'ready_for_review' AND to_state IN ('done', 'pending'))
        OR actual_state = to_state) OR from_state <> actual_state""")
def illegal_transitions(spark, sf_dir):
    out = RV.illegal_transitions(transition_log(spark, sf_dir), "report_id", "at", "transition_id")
    return out.select("report_id", "transition_id", "from_state", "actual_state", "to_state")


@query("assigned_reviewers", sql="""
SELECT user_id AS report_id, arg_max('rev' || event_id % 7, (ts, event_id)) AS reviewer,
  arg_max('rev' || event_id % 3, (ts, event_id)) AS actor, max(ts) AS "at" FROM events WHERE event_type = 'signup' GROUP BY 1""")
def assigned_reviewers(spark, sf_dir):
    """REV-2: sign-ups as assignments."""
    name = lambda n: F.concat(F.lit("rev"), (F.col("event_id") % n).cast("string"))
    log = T.table(spark, sf_dir, "events").where("event_type = 'signup'").select(
        F.col("user_id").alias("report_id"), F.col("ts").alias("at"), F.col("event_id").alias("transition_id"),
        name(7).alias("reviewer"), name(3).alias("actor"))
    return RV.assigned_reviewers(log)


@query("activation", sql="""
WITH v AS (SELECT DISTINCT user_id AS pipeline_id, user_id * 100 + event_id % 10 AS version_id FROM events),
 a AS (SELECT user_id AS pipeline_id, user_id * 100 + event_id % 10 AS version_id, ts, event_id FROM events WHERE event_type = 'purchase'),
 l AS (SELECT pipeline_id, arg_max(version_id, (ts, event_id)) AS active FROM a GROUP BY 1)
SELECT v.pipeline_id, v.version_id, CASE WHEN v.version_id = l.active THEN 'active'
  WHEN v.version_id IN (SELECT version_id FROM a) THEN 'archived' ELSE 'draft' END AS status FROM v LEFT JOIN l USING (pipeline_id)""")
def activation(spark, sf_dir):
    """Ten versions a pipeline, activated by purchases, again and again."""
    e = T.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("pipeline_id"), (F.col("user_id") * 100 + F.col("event_id") % 10).alias("version_id"),
        F.col("ts").alias("at"), F.col("event_id").alias("activation_id"), "event_type")
    out = RV.activation_status(e.select("pipeline_id", "version_id").distinct(), e.where("event_type = 'purchase'"))
    return out.select("pipeline_id", "version_id", "status")


@query("latest_notification", sql="""
SELECT user_id AS report_id, event_type AS channel, arg_max(event_id, (ts, event_id)) AS external_id
FROM events GROUP BY user_id, event_type""")
def latest_notification(spark, sf_dir):
    e = T.table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("report_id"), F.col("event_type").alias("channel")).agg(
        F.max_by("event_id", F.struct("ts", "event_id")).alias("external_id"))


# ---- latest report per project (orders as reports) ------------------------------------
@query("latest_done", sql=f"""
SELECT project, report_id, verdict, created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY project ORDER BY created_at DESC, report_id DESC) AS rn
  FROM {T.SQL_REPORTS} WHERE state = 'done') WHERE rn = 1""")
def latest_done(spark, sf_dir):
    r = T.reports(spark, sf_dir)
    return RV.latest(r, ["project"], ["created_at", "report_id"], ["report_id", "verdict", "created_at"],
                     where=F.col("state") == "done")


@query("baseline", sql=f"""
SELECT project, report_id, created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY project ORDER BY created_at DESC, report_id DESC) AS rn
  FROM {T.SQL_REPORTS} WHERE state = 'done' AND verdict = 'pass') WHERE rn = 1""")
def baseline(spark, sf_dir):
    r = T.reports(spark, sf_dir)
    return RV.latest(r, ["project"], ["created_at", "report_id"], ["report_id", "created_at"],
                     where=(F.col("state") == "done") & (F.col("verdict") == "pass"))


@query("latest_run", sql=f"""
SELECT project, run_id, created_at AS started_at FROM (
  SELECT *, row_number() OVER (PARTITION BY project ORDER BY created_at DESC, run_id DESC) AS rn
  FROM {T.SQL_REPORTS}) WHERE rn = 1""")
def latest_run(spark, sf_dir):
    r = T.reports(spark, sf_dir).withColumnRenamed("created_at", "started_at")
    return RV.latest(r, ["project"], ["started_at", "run_id"], ["run_id", "started_at"])


@query("next_version", sql="""
SELECT l_orderkey AS pipeline_id, max(l_linenumber) + 1 AS next_version FROM lineitem GROUP BY l_orderkey""")
def next_version(spark, sf_dir):
    li = T.table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("pipeline_id")).agg(
        (F.max("l_linenumber") + 1).alias("next_version"))


# ---- adjudication and verdict validation, reviewer audit ---------------------------------
# attempts: labels rows; report = the order with o_orderkey = doc_id; quality 1 = pass, 0 = fail;
# actor = the supplier with s_suppkey = doc_id % (number of suppliers); a toxic row carries no
# reason, every tenth a blank one. Case k * 10 + 1 belongs to run k; every sixth attempt names
# the case of the next run.
def _attempts(spark, sf_dir):
    sup = T.table(spark, sf_dir, "supplier")
    n_sup = sup.count()  # one scalar: attempts are paired with supplier doc_id % n
    lab = T.table(spark, sf_dir, "labels").withColumn("s_suppkey", F.col("doc_id") % F.lit(n_sup))
    d = F.col("doc_id")
    return lab.join(sup.select("s_suppkey", F.col("s_name").alias("actor")), "s_suppkey", "left").select(
        d.alias("report_id"), "doc_id", (F.when(d % 6 == 0, d + 1).otherwise(d) * 10 + 1).alias("case_id"), "actor",
        F.when(d % 9 == 0, "maybe").when(F.col("quality") == 1, "pass").otherwise("fail").alias("verdict"),
        F.when(F.col("toxic") == 1, F.lit(None)).when(d % 10 == 3, "  ").otherwise(
            F.concat(F.lit("label "), d.cast("string"))).alias("reason"))


SQL_ATTEMPTS = """(SELECT doc_id AS report_id, doc_id, (CASE WHEN doc_id % 6 = 0 THEN doc_id + 1 ELSE doc_id END) * 10 + 1 AS case_id,
  s_name AS actor, CASE WHEN doc_id % 9 = 0 THEN 'maybe' WHEN quality = 1 THEN 'pass' ELSE 'fail' END AS verdict,
  CASE WHEN toxic = 1 THEN NULL WHEN doc_id % 10 = 3 THEN '  ' ELSE 'label ' || doc_id END AS reason
  FROM labels LEFT JOIN supplier ON s_suppkey = doc_id % (SELECT count(*) FROM supplier))"""
SQL_USERS = """(SELECT s_name AS name, CASE WHEN s_nationkey % 5 = 0 THEN 'admin'
  WHEN s_nationkey % 2 = 0 THEN 'reviewer' ELSE 'runner' END AS role FROM supplier)"""


@query("adjudication_validation", sql=f"""
SELECT a.doc_id,
  CASE WHEN coalesce(u.role, '') NOT IN ('reviewer', 'admin') THEN 'actor lacks reviewer authority'
       WHEN r.state IS NULL THEN 'report not found' WHEN r.state = 'done' THEN 'report is locked'
       WHEN r.state <> 'ready_for_review' THEN 'report is not ready_for_review'
       WHEN coalesce(a.reason, '') = '' THEN 'reason required when setting a verdict'
       WHEN c.o_orderkey IS NULL OR c.o_orderkey <> r.run_id THEN 'case not in report' END AS reject_reason,
  reject_reason IS NULL AS accepted
FROM {SQL_ATTEMPTS} a LEFT JOIN {T.SQL_REPORTS} r ON r.report_id = a.report_id LEFT JOIN {SQL_USERS} u ON u.name = a.actor
LEFT JOIN orders c ON c.o_orderkey * 10 + 1 = a.case_id""")
def adjudication_validation(spark, sf_dir):
    """REV-3 / REV-5."""
    cases = T.table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") * 10 + 1).alias("case_id"), F.col("o_orderkey").alias("run_id"))
    out = RV.validate_adjudications(_attempts(spark, sf_dir), T.reports(spark, sf_dir), users(spark, sf_dir), cases, "enforced")
    return out.select("doc_id", "reject_reason", "accepted")


@query("verdict_validation", sql=f"""
WITH s AS (SELECT run_id, count(*) AS cases, count_if(coalesce(human_verdict = 'pass', passed)) AS passed FROM {T.SQL_CASE_RESULTS} GROUP BY 1),
 j AS (SELECT a.doc_id, r.run_id, CASE WHEN a.verdict NOT IN ('pass', 'fail') THEN 'verdict must be ''pass'' or ''fail'''
       WHEN coalesce(trim(a.reason), '') = '' THEN 'reason required'
       WHEN coalesce(u.role, '') NOT IN ('reviewer', 'admin') THEN 'actor lacks reviewer authority'
       WHEN r.state IS NULL THEN 'report not found'
       WHEN r.state <> 'ready_for_review' THEN 'illegal transition ' || r.state || ' -> done' END AS reject_reason
   FROM {SQL_ATTEMPTS} a LEFT JOIN {T.SQL_REPORTS} r ON r.report_id = a.report_id LEFT JOIN {SQL_USERS} u ON u.name = a.actor)
SELECT doc_id, reject_reason, reject_reason IS NULL AS locked, CASE WHEN reject_reason IS NULL THEN 'done' END AS new_state,
  CASE WHEN reject_reason IS NULL THEN coalesce(cases, 0) END AS cases, CASE WHEN reject_reason IS NULL THEN coalesce(passed, 0) END AS passed
FROM j LEFT JOIN s USING (run_id)""")
def verdict_validation(spark, sf_dir):
    """REV-4."""
    cr = T.case_results(spark, sf_dir)
    eff = cr.withColumn("effective", RS.effective_passed(F.col("passed"), F.col("human_verdict")))
    s = RS.run_summary(eff, flag="effective").select("run_id", "cases", "passed")
    out = RV.validate_verdicts(_attempts(spark, sf_dir), T.reports(spark, sf_dir), users(spark, sf_dir), s)
    return out.select("doc_id", "reject_reason", "locked", "new_state", "cases", "passed")


# The log of a review: events as attempts on the report with the user's id, every third on report 1.
# signup = submit, error = return, click and view = adjudicate, purchase = verdict; the actor is a
# supplier; only every eleventh purchase names a verdict that exists, every fourth attempt lacks a reason.
def _review_log(spark, sf_dir):
    sup = T.table(spark, sf_dir, "supplier")
    n_sup = sup.count()  # one scalar: attempts are paired with supplier event_id % n
    i = F.col("event_id")
    e = T.table(spark, sf_dir, "events").withColumn("s_suppkey", i % F.lit(n_sup))
    report = F.when(i % 3 == 0, F.lit(1).cast("long")).otherwise(F.col("user_id"))
    kind = (F.when(F.col("event_type") == "signup", "submit").when(F.col("event_type") == "error", "return")
            .when(F.col("event_type") == "purchase", "verdict").otherwise("adjudicate"))
    verdict = (F.when((F.col("event_type") == "purchase") & (i % 11 != 0), "maybe")
               .when(F.col("event_type") == "view", "fail").when(i % 13 != 0, "pass"))
    return e.join(sup.select("s_suppkey", F.col("s_name").alias("actor")), "s_suppkey", "left").select(
        report.alias("report_id"), F.col("ts").alias("at"), i.alias("attempt_id"), kind.alias("kind"),
        (F.when(i % 6 == 0, report + 1).otherwise(report) * 10 + 1).alias("case_id"), verdict.alias("verdict"),
        F.when(i % 4 != 0, F.concat(F.lit("event "), i.cast("string"))).alias("reason"), "actor")


SQL_REVIEW_LOG = """(SELECT *, (CASE WHEN attempt_id % 6 = 0 THEN report_id + 1 ELSE report_id END) * 10 + 1 AS case_id FROM (
  SELECT CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id END AS report_id, ts AS "at", event_id AS attempt_id,
    CASE event_type WHEN 'signup' THEN 'submit' WHEN 'error' THEN 'return' WHEN 'purchase' THEN 'verdict' ELSE 'adjudicate' END AS kind,
    CASE WHEN event_type = 'purchase' AND event_id % 11 <> 0 THEN 'maybe' WHEN event_type = 'view' THEN 'fail'
         WHEN event_id % 13 <> 0 THEN 'pass' END AS verdict,
    CASE WHEN event_id % 4 <> 0 THEN 'event ' || event_id END AS reason, s_name AS actor
  FROM events LEFT JOIN supplier ON s_suppkey = event_id % (SELECT count(*) FROM supplier)))"""


@query("review_replay", sql=f"""
WITH RECURSIVE a AS MATERIALIZED (
  SELECT l.*, r.o_orderkey AS run_id, c.o_orderkey AS case_run, coalesce(u.role, '') IN ('reviewer', 'admin') AS may,
    row_number() OVER (PARTITION BY report_id ORDER BY "at", attempt_id) AS n
  FROM {SQL_REVIEW_LOG} l LEFT JOIN orders r ON r.o_orderkey = report_id LEFT JOIN orders c ON c.o_orderkey * 10 + 1 = l.case_id
  LEFT JOIN {SQL_USERS} u ON u.name = l.actor),
 s AS MATERIALIZED (SELECT *, CASE WHEN kind = 'verdict' AND coalesce(verdict, '') NOT IN ('pass', 'fail') THEN 'verdict must be ''pass'' or ''fail'''
     WHEN kind = 'verdict' AND coalesce(trim(reason), '') = '' THEN 'reason required'
     WHEN kind IN ('verdict', 'adjudicate') AND NOT may THEN 'actor lacks reviewer authority'
     WHEN run_id IS NULL THEN 'report not found' END AS first FROM a),
 w AS (
  SELECT report_id, CAST(0 AS BIGINT) AS n, CASE WHEN run_id IS NOT NULL THEN 'pending' END AS was, CASE WHEN run_id IS NOT NULL THEN 'pending' END AS now
  FROM s WHERE n = 1
  UNION ALL
  SELECT s.report_id, s.n, w.now, CASE WHEN s.first IS NOT NULL THEN w.now WHEN s.kind = 'submit' AND w.now = 'pending' THEN 'ready_for_review'
    WHEN s.kind = 'return' AND w.now = 'ready_for_review' THEN 'pending' WHEN s.kind = 'verdict' AND w.now = 'ready_for_review' THEN 'done' ELSE w.now END
  FROM w JOIN s ON s.report_id = w.report_id AND s.n = w.n + 1),
 j AS (SELECT attempt_id, kind, was AS state_before, now AS state_after, CASE WHEN first IS NOT NULL THEN first
    WHEN kind = 'adjudicate' AND was = 'done' THEN 'report is locked' WHEN kind = 'adjudicate' AND was <> 'ready_for_review' THEN 'report is not ready_for_review'
    WHEN kind = 'submit' AND was <> 'pending' THEN 'illegal transition ' || was || ' -> ready_for_review'
    WHEN kind = 'return' AND was <> 'ready_for_review' THEN 'illegal transition ' || was || ' -> pending'
    WHEN kind = 'verdict' AND was <> 'ready_for_review' THEN 'illegal transition ' || was || ' -> done'
    WHEN kind = 'adjudicate' AND verdict IS NOT NULL AND coalesce(reason, '') = '' THEN 'reason required when setting a verdict'
    WHEN kind = 'adjudicate' AND (case_run IS NULL OR case_run <> run_id) THEN 'case not in report' END AS reject_reason
  FROM s JOIN w USING (report_id, n))
SELECT *, reject_reason IS NULL AS accepted FROM j""")
def review_replay(spark, sf_dir):
    """REV-3 / REV-4 over a whole log: every attempt judged in the state that those before it left."""
    orders = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"))
    reports = orders.select(F.col("run_id").alias("report_id"), "run_id", F.lit("pending").alias("state"))
    cases = orders.select((F.col("run_id") * 10 + 1).alias("case_id"), "run_id")
    out = replay_reviews(_review_log(spark, sf_dir), reports, users(spark, sf_dir), cases, "enforced")
    return out.select("attempt_id", "kind", "state_before", "state_after", "reject_reason", "accepted")


@query("review_events", sql=f"""
WITH s AS (SELECT run_id, count(*) AS cases, count_if(passed) AS passed FROM {T.SQL_CASE_RESULTS} GROUP BY 1)
SELECT r.report_id, '{{"event":"ready_for_review","report_id":' || r.report_id || ',"run_id":' || r.run_id || ',"project":"' || r.project
  || '","summary":{{"cases":' || coalesce(s.cases, 0) || ',"passed":' || coalesce(s.passed, 0) || ',"failed":' || coalesce(s.cases - s.passed, 0)
  || '}},"assigned_reviewer":"' || r.reviewer || '","target":{{"adapter":"rest","model":"' || t.s_name || '"}}'
  || CASE WHEN p.p_partkey IS NOT NULL THEN ',"pipeline_version":{{"id":' || p.p_partkey || ',"version_number":' || (p.p_partkey % 5 + 1)
       || ',"content_hash":"' || md5(p.p_partkey::VARCHAR) || '"}}' ELSE '' END || '}}' AS payload
FROM {T.SQL_REPORTS} r JOIN supplier t ON t.s_suppkey = r.o_custkey % (SELECT count(*) FROM supplier)
LEFT JOIN part p ON p.p_partkey = CASE WHEN r.o_custkey % 4 <> 0 THEN r.o_custkey END LEFT JOIN s ON s.run_id = r.run_id
WHERE r.state = 'ready_for_review'""")
def review_events(spark, sf_dir):
    """REV-6 / JON-2: report, run, target and (for some runs) version as one payload."""
    rep = T.reports(spark, sf_dir).where("state = 'ready_for_review'")
    sup = T.table(spark, sf_dir, "supplier")
    n_sup = sup.count()  # one scalar: a run's target is supplier o_custkey % n
    runs = rep.select("run_id", "project", (F.col("o_custkey") % F.lit(n_sup)).alias("target_id"),
                      F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey")).alias("version_id"))
    targets = sup.select(F.col("s_suppkey").alias("target_id"), F.lit("rest").alias("adapter"), F.col("s_name").alias("model"))
    p = F.col("p_partkey")
    versions = T.table(spark, sf_dir, "part").select(p.alias("version_id"), (p % 5 + 1).alias("version_number"),
                                                     F.md5(p.cast("string")).alias("content_hash"))
    return RV.submit_events(rep.select("report_id", "run_id", "reviewer"), runs, targets, versions,
                            RS.run_summary(T.case_results(spark, sf_dir)))


@query("reviewer_list", sql=f"SELECT name, role FROM {SQL_USERS} WHERE role IN ('reviewer', 'admin') ORDER BY name")
def reviewer_list(spark, sf_dir):
    """REL-6."""
    return RV.reviewers(users(spark, sf_dir))


def users(spark, sf_dir):
    s = T.table(spark, sf_dir, "supplier")
    role = (F.when(F.col("s_nationkey") % 5 == 0, "admin")
            .when(F.col("s_nationkey") % 2 == 0, "reviewer").otherwise("runner"))
    return s.select(F.col("s_name").alias("name"), role.alias("role"))


@query("approved_by_non_reviewer", sql=f"""
SELECT r.report_id, s.s_name AS actor FROM {T.SQL_REPORTS} r
JOIN supplier s ON s.s_suppkey = r.o_custkey % (SELECT count(*) FROM supplier)
WHERE r.state = 'done' AND s.s_name NOT IN (SELECT name FROM {SQL_USERS} WHERE role IN ('reviewer', 'admin'))""")
def approved_by_non_reviewer(spark, sf_dir):
    sup = T.table(spark, sf_dir, "supplier")
    n_sup = sup.count()  # one scalar: the approver of report r is supplier o_custkey % n
    rep = T.reports(spark, sf_dir).where(F.col("state") == "done").select(
        "report_id", (F.col("o_custkey") % F.lit(n_sup)).alias("s_suppkey"))
    actions = rep.join(sup.select("s_suppkey", F.col("s_name").alias("actor")), "s_suppkey")
    return RV.non_reviewer_actions(actions, users(spark, sf_dir)).select("report_id", "actor")
