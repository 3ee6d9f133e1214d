"""Report listings, queues, joins across report/run/target and project rollups."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from proofline.operators import paging
from proofline.operators import results as RS
from proofline.operators import rollups as RU
from proofline.plans.q_results import SQL_EFFECTIVE, effective_results
from proofline.plans.registry import query
from proofline.sources import tables as T


@query("report_page", sql=f"""
SELECT report_id, project, state, created_at FROM {T.SQL_REPORTS}
WHERE state = 'done' AND lower(project) LIKE '%mach%'
ORDER BY created_at DESC, report_id DESC LIMIT 50 OFFSET 100""")
def report_page(spark, sf_dir):
    r = T.reports(spark, sf_dir).where(RU.report_filter(state="done", project_like="MACH"))
    return RU.page(r.select("report_id", "project", "state", "created_at"), 2)


_SQL_MIDDLE = f"""SELECT report_id, project, state, created_at, row_number() OVER (ORDER BY created_at DESC, report_id DESC) - 1 AS place,
  (SELECT count(*) FROM {T.SQL_REPORTS}) // 100 * 50 AS first FROM {T.SQL_REPORTS}"""


def _middle(spark, sf_dir):
    r = T.reports(spark, sf_dir).select("report_id", "project", "state", "created_at")
    return r, paging.page(r, r.count() // 100, RU.PAGE_SIZE, "created_at", "report_id")


@query("report_middle_page", sql=f"""
SELECT report_id, project, state, created_at FROM ({_SQL_MIDDLE}) WHERE place >= first AND place < first + 50""")
def report_middle_page(spark, sf_dir):
    """REL-2: the page in the middle of all reports, found by counting ranges of the sort key."""
    return _middle(spark, sf_dir)[1]


@query("report_next_page", sql=f"""
SELECT report_id, project, state, created_at FROM ({_SQL_MIDDLE}) WHERE place >= first + 50 AND place < first + 100""")
def report_next_page(spark, sf_dir):
    """REL-2: the page after the middle one, from the last row of that page."""
    r, shown = _middle(spark, sf_dir)
    last = shown.agg(F.min(F.struct("created_at", "report_id")).alias("last")).first()["last"]
    return paging.page_after(r, tuple(last), RU.PAGE_SIZE, "created_at", "report_id")


@query("report_total", sql=f"""
SELECT count(*) AS total FROM {T.SQL_REPORTS} WHERE state = 'done' AND lower(project) LIKE '%mach%'""")
def report_total(spark, sf_dir):
    r = T.reports(spark, sf_dir).where(RU.report_filter(state="done", project_like="MACH"))
    return r.agg(F.count(F.lit(1)).alias("total"))


@query("top50", sql=f"""
SELECT report_id, created_at, verdict FROM {T.SQL_REPORTS} WHERE project = 'BUILDING'
ORDER BY created_at DESC, report_id DESC LIMIT 50""")
def top50(spark, sf_dir):
    r = T.reports(spark, sf_dir).where(F.col("project") == "BUILDING")
    return RU.newest_first(r.select("report_id", "created_at", "verdict")).limit(RU.PAGE_SIZE)


@query("distinct_projects", sql=f"SELECT DISTINCT project FROM {T.SQL_REPORTS} ORDER BY project")
def distinct_projects(spark, sf_dir):
    return T.reports(spark, sf_dir).select("project").distinct().orderBy("project")


@query("review_queue", sql=f"""
WITH per_run AS (SELECT run_id, count(*) AS cases, count_if(effective_passed) AS passed FROM {SQL_EFFECTIVE} GROUP BY run_id)
SELECT r.report_id, r.project, r.created_at, r.reviewer, p.cases, p.passed
FROM {T.SQL_REPORTS} r LEFT JOIN per_run p ON p.run_id = r.run_id
WHERE r.state = 'ready_for_review' AND r.project = 'AUTOMOBILE'
ORDER BY r.created_at DESC, r.report_id DESC""")
def review_queue(spark, sf_dir):
    """REL-4 + JON-2: the queue joins each report to its recomputed run summary in one plan."""
    r = T.reports(spark, sf_dir).where(RU.report_filter(state="ready_for_review", project="AUTOMOBILE"))
    per_run = RS.run_summary(effective_results(spark, sf_dir), flag="effective_passed").select("run_id", "cases", "passed")
    j = r.join(per_run, "run_id", "left")
    return RU.newest_first(j.select("report_id", "project", "created_at", "reviewer", "cases", "passed"))


@query("semi_project_reports", sql=f"""
SELECT report_id, state FROM {T.SQL_REPORTS}
WHERE run_id IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'HOUSEHOLD')""")
def semi_project_reports(spark, sf_dir):
    """JON-5: reports whose run belongs to a project (left semi join)."""
    o = T.table(spark, sf_dir, "orders")
    c = T.table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "HOUSEHOLD")
    runs = o.join(c, o.o_custkey == c.c_custkey, "left_semi").select(F.col("o_orderkey").alias("run_id"))
    return T.reports(spark, sf_dir).join(runs, "run_id", "left_semi").select("report_id", "state")


@query("anti_runs", sql="""
SELECT o_orderkey AS run_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def anti_runs(spark, sf_dir):
    """JON-8: runs without any case result (left anti join)."""
    o = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"))
    li = T.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"))
    return o.join(li, "run_id", "left_anti")


@query("report_detail", sql=f"""
WITH t AS (SELECT user_id AS report_id, array_to_string(list(CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'ready_for_review' ELSE 'done' END
    || ' -> ' || CASE event_type WHEN 'click' THEN 'ready_for_review' WHEN 'view' THEN 'done' ELSE 'pending' END || ' by rev' || event_id % 7
    ORDER BY ts, event_id), '; ') AS history FROM events GROUP BY user_id)
SELECT r.report_id, r.project, r.state, coalesce(t.history, '') AS history FROM {T.SQL_REPORTS} r LEFT JOIN t USING (report_id)""")
def report_detail(spark, sf_dir):
    """REL-11: every report with its whole history in order."""
    et = F.col("event_type")
    t = T.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("report_id"), F.col("ts").alias("at"), F.col("event_id").alias("transition_id"),
        F.when(et == "click", "pending").when(et == "view", "ready_for_review").otherwise("done").alias("from_state"),
        F.when(et == "click", "ready_for_review").when(et == "view", "done").otherwise("pending").alias("to_state"),
        F.concat(F.lit("rev"), (F.col("event_id") % 7).cast("string")).alias("actor"))
    out = RU.report_history(T.reports(spark, sf_dir).select("report_id", "project", "state"), t)
    return out.withColumn("history", F.array_join("history", "; "))


@query("project_rollup", headline=True, sql=f"""
WITH per_run AS (SELECT run_id, count(*) AS cases, count_if(effective_passed) AS passed FROM {SQL_EFFECTIVE} GROUP BY run_id),
     rep AS (SELECT r.project, count(*) AS report_count, sum(p.cases) AS c, sum(p.passed) AS p,
                    arg_max(r.verdict, (r.created_at, r.report_id)) FILTER (r.state = 'done') AS latest_verdict,
                    max(r.created_at) AS last_run_at
             FROM {T.SQL_REPORTS} r LEFT JOIN per_run p ON p.run_id = r.run_id GROUP BY r.project),
     pipes AS (SELECT c_mktsegment AS project, count(DISTINCT c_custkey) AS pipeline_count FROM customer GROUP BY 1)
SELECT pipes.project, pipes.pipeline_count, coalesce(rep.report_count, 0) AS report_count, rep.latest_verdict,
  CASE WHEN coalesce(rep.c, 0) > 0 THEN round(rep.p * 100.0 / rep.c, 1) END AS pass_rate, rep.last_run_at
FROM pipes LEFT JOIN rep ON rep.project = pipes.project""")
def project_rollup(spark, sf_dir):
    per_run = RS.run_summary(effective_results(spark, sf_dir), flag="effective_passed").select("run_id", "cases", "passed")
    pipes = T.table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("project"), F.col("c_custkey").alias("pipeline_id"))
    return RU.project_rollup(T.reports(spark, sf_dir), per_run, pipes)


# ---- versions: every order is a version of its customer's pipeline; F/O/P = archived / active /
# draft; its number is its rank among the customer's orders; every four orders in a row are runs
# of the first of them
def versions(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "archived").when(F.col("o_orderstatus") == "O", "active").otherwise("draft")
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))  # a customer's few orders
    return o.select(F.col("o_orderkey").alias("version_id"), F.col("o_custkey").alias("pipeline_id"),
                    n.alias("version_number"), status.alias("status"))


SQL_VERSIONS = """(SELECT o_orderkey AS version_id, o_custkey AS pipeline_id,
  CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS version_number,
  CASE o_orderstatus WHEN 'F' THEN 'archived' WHEN 'O' THEN 'active' ELSE 'draft' END AS status FROM orders)"""
SQL_ACTIVE = f"""(SELECT c_custkey AS pipeline_id, max(version_number) FILTER (status = 'active') AS active_version,
  arg_max(version_id, version_number) FILTER (status = 'active') AS active_version_id, count_if(status = 'draft') AS n_drafts
  FROM customer LEFT JOIN {SQL_VERSIONS} v ON v.pipeline_id = c_custkey GROUP BY 1)"""


@query("active_versions", sql=f"""
SELECT pipeline_id, arg_max(version_id, version_number) FILTER (status = 'active') AS active_version_id,
  max(version_number) FILTER (status = 'active') AS active_version,
  coalesce(string_agg(version_id::VARCHAR, ',' ORDER BY version_id DESC) FILTER (status = 'draft'), '') AS drafts
FROM {SQL_VERSIONS} GROUP BY pipeline_id""")
def active_versions(spark, sf_dir):
    """WIN-4."""
    return RU.active_versions(versions(spark, sf_dir)).withColumn(
        "drafts", F.array_join(F.col("drafts").cast("array<string>"), ","))


@query("pipeline_rollup", sql=f"""
WITH r AS (SELECT run_id - run_id % 4 AS version_id, count(*) AS n, arg_max(verdict, (created_at, report_id)) FILTER (state = 'done') AS v,
             max(created_at) AS last FROM {T.SQL_REPORTS} GROUP BY 1)
SELECT a.pipeline_id, a.active_version, coalesce(r.n, 0) AS report_count, r.v AS latest_verdict, r.last AS last_run_at, CAST(a.n_drafts AS INT) AS n_drafts
FROM {SQL_ACTIVE} a LEFT JOIN r ON r.version_id = a.active_version_id""")
def pipeline_rollup(spark, sf_dir):
    """AGG-10: over the runs of each pipeline's active version."""
    rep = T.reports(spark, sf_dir)
    runs = rep.select("run_id", (F.col("run_id") - F.col("run_id") % 4).alias("version_id"),
                      F.col("created_at").alias("started_at"))
    pipes = T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pipeline_id"))
    return RU.pipeline_rollup(pipes, versions(spark, sf_dir), runs,
                              rep.select("report_id", "run_id", "state", "verdict", "created_at"))


@query("open_versions", sql=f"""
SELECT version_id, pipeline_id, version_number, status, c_mktsegment AS project
FROM {SQL_VERSIONS} v JOIN customer ON c_custkey = pipeline_id WHERE status IN ('draft', 'active') ORDER BY version_id DESC""")
def open_versions(spark, sf_dir):
    """JON-3."""
    pipes = T.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("pipeline_id"), F.col("c_mktsegment").alias("project"))
    return RU.open_versions(versions(spark, sf_dir), pipes).select(
        "version_id", "pipeline_id", "version_number", "status", "project")


@query("pipeline_versions", sql=f"""
SELECT version_id, version_number, status FROM {SQL_VERSIONS}
WHERE pipeline_id = (SELECT min(o_custkey) FROM orders) AND status IN ('archived', 'active') ORDER BY version_number""")
def pipeline_versions(spark, sf_dir):
    """REL-7: versions of the first pipeline, drafts left out."""
    v = versions(spark, sf_dir)
    first = v.agg(F.min("pipeline_id")).first()[0]
    return RU.pipeline_versions(v, first, ["archived", "active"]).select("version_id", "version_number", "status")


@query("case_transcript", sql=f"""
SELECT r.report_id, d.doc_id AS case_id, 'prompt ' || d.doc_id AS request, d.text AS response, 2 AS n_checks
FROM {T.SQL_REPORTS} r JOIN documents d ON d.doc_id % 20 = r.run_id
WHERE r.report_id = 7 AND d.doc_id IN (SELECT max(doc_id) FROM documents WHERE doc_id % 20 = 7)""")
def case_transcript(spark, sf_dir):
    """REL-10: one case of report 7; documents are cases of run doc_id % 20."""
    d = T.table(spark, sf_dir, "documents")
    checks = F.array(F.struct(F.length("text").alias("n")), F.struct(F.length("lang").alias("n")))
    cases = d.select((F.col("doc_id") % 20).alias("run_id"), F.col("doc_id").alias("case_id"),
                     F.concat(F.lit("prompt "), F.col("doc_id").cast("string")).alias("request"),
                     F.col("text").alias("response"), checks.alias("checks"))
    last = cases.where("run_id = 7").agg(F.max("case_id")).first()[0]
    out = RU.transcript(T.reports(spark, sf_dir), cases, 7, last)
    return out.select("report_id", "case_id", "request", "response", F.size("checks").alias("n_checks"))


@query("run_progress", sql=f"""
SELECT o_orderkey AS run_id, CAST(7 AS BIGINT) AS cases_total, count(l_orderkey) AS done,
  CAST(round(count(l_orderkey) * 100.0 / 7, 0) AS BIGINT) AS percent
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def run_progress(spark, sf_dir):
    """AGG-11: a run expects 7 cases (the most lines an order has)."""
    runs = T.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.lit(7).cast("long").alias("cases_total"))
    cr = T.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"))
    return RU.run_progress(runs, cr).select("run_id", "cases_total", "done", "percent")
