"""Case gates, run summaries, verdict policies, coverage and baselines."""
from __future__ import annotations

from pyspark.sql import functions as F

from proofline.operators import coverage as COV
from proofline.operators import results as RS
from proofline.operators.evaluate import apply_and_gate
from proofline.operators.testsets import split_requirements
from proofline.plans.q_checks import LICENSE, SECRET, LICENSE_RE, SQL_CARD, SQL_EMAIL, SQL_IBAN, TEXT_SPEC
from proofline.plans.registry import query
from proofline.plans.sqltext import SQL_SPLIT, q
from proofline.sources import tables as T

# The text spec evaluated in SQL: one flag per required check, the gate over them.
SQL_TEXT_GATE = f"""(SELECT run_id, suite_id, case_id, requirement_ref,
   (contains(coalesce(text, ''), {q(LICENSE)})
    AND NOT contains(coalesce(text, ''), {q(SECRET)})
    AND regexp_matches(coalesce(text, ''), {q('(?sm)' + LICENSE_RE)})
    AND len(regexp_extract_all(coalesce(text, ''), {q(SQL_EMAIL)})) = 0
    AND len(regexp_extract_all(coalesce(text, ''), {q(SQL_IBAN)})) = 0
    AND len(regexp_extract_all(coalesce(text, ''), {q(SQL_CARD)})) = 0) AS passed,
   CAST((CASE WHEN contains(coalesce(text, ''), {q(LICENSE)}) THEN 0 ELSE 1 END)
    + (CASE WHEN contains(coalesce(text, ''), {q(SECRET)}) THEN 1 ELSE 0 END)
    + (CASE WHEN regexp_matches(coalesce(text, ''), {q('(?sm)' + LICENSE_RE)}) THEN 0 ELSE 1 END)
    + (CASE WHEN len(regexp_extract_all(coalesce(text, ''), {q(SQL_EMAIL)}))
               + len(regexp_extract_all(coalesce(text, ''), {q(SQL_IBAN)}))
               + len(regexp_extract_all(coalesce(text, ''), {q(SQL_CARD)})) > 0 THEN 1 ELSE 0 END)
    AS BIGINT) AS failed_checks
  FROM {T.SQL_TEXT_RESPONSES})"""


def text_gate(spark, sf_dir):
    """Documents as responses under TEXT_SPEC: one row per case with its gate."""
    r = T.text_responses(spark, sf_dir)
    return apply_and_gate(r, TEXT_SPEC, ["run_id", "suite_id", "case_id"], body=None,
                          extra=["requirement_ref"])


@query("case_gate", sql=f"SELECT case_id, passed, failed_checks FROM {SQL_TEXT_GATE}")
def case_gate(spark, sf_dir):
    return text_gate(spark, sf_dir).select("case_id", "passed", "failed_checks")


@query("run_summary", headline=True, sql=f"""
SELECT run_id, count(*) AS cases, count_if(passed) AS passed, count(*) - count_if(passed) AS failed
FROM {SQL_TEXT_GATE} GROUP BY run_id""")
def run_summary(spark, sf_dir):
    return RS.run_summary(text_gate(spark, sf_dir))


@query("run_gate", sql=f"SELECT suite_id, bool_and(passed) AS run_passed FROM {SQL_TEXT_GATE} GROUP BY suite_id")
def run_gate(spark, sf_dir):
    return RS.run_gate(text_gate(spark, sf_dir), keys=("suite_id",))


@query("run_cost", sql=f"""
SELECT run_id, CAST(round(sum(CAST(coalesce(cost_usd, 0) AS DECIMAL(24,8))), 6) AS DOUBLE) AS total_cost_usd
FROM {T.SQL_CASE_RESULTS} GROUP BY run_id""")
def run_cost(spark, sf_dir):
    return RS.run_cost(T.case_results(spark, sf_dir))


def effective_results(spark, sf_dir):
    cr = T.case_results(spark, sf_dir)
    return cr.withColumn("effective_passed", RS.effective_passed(F.col("passed"), F.col("human_verdict")))


SQL_EFFECTIVE = f"""(SELECT *, coalesce(human_verdict = 'pass', passed) AS effective_passed
  FROM {T.SQL_CASE_RESULTS})"""


@query("effective_summary", headline=True, sql=f"""
SELECT run_id, count(*) AS cases, count_if(effective_passed) AS passed,
  count(*) - count_if(effective_passed) AS failed
FROM {SQL_EFFECTIVE} GROUP BY run_id""")
def effective_summary(spark, sf_dir):
    return RS.run_summary(effective_results(spark, sf_dir), flag="effective_passed")


def _verdict(spark, sf_dir, policy):
    rep = T.reports(spark, sf_dir).select("report_id", "run_id")
    out = RS.suggested_verdict(rep, effective_results(spark, sf_dir), policy)
    return out.select("report_id", "suggested_verdict")


@query("verdict_all_required", headline=True, sql=f"""
SELECT r.report_id, CASE WHEN coalesce(bool_and(e.effective_passed), true) THEN 'pass' ELSE 'fail' END AS suggested_verdict
FROM {T.SQL_REPORTS} r LEFT JOIN {SQL_EFFECTIVE} e ON e.run_id = r.run_id GROUP BY r.report_id""")
def verdict_all_required(spark, sf_dir):
    return _verdict(spark, sf_dir, {"type": "all_required"})


@query("verdict_threshold", sql=f"""
SELECT r.report_id,
  CASE WHEN count(e.run_id) = 0 THEN 'pass'
       WHEN count_if(e.effective_passed) / count(e.run_id) >= 0.5 THEN 'pass' ELSE 'fail' END AS suggested_verdict
FROM {T.SQL_REPORTS} r LEFT JOIN {SQL_EFFECTIVE} e ON e.run_id = r.run_id GROUP BY r.report_id""")
def verdict_threshold(spark, sf_dir):
    return _verdict(spark, sf_dir, {"type": "threshold", "value": 0.5})


@query("verdict_must_pass_tags", sql=f"""
SELECT r.report_id,
  CASE WHEN coalesce(bool_and(e.effective_passed) FILTER (WHERE e.requirement_ref IN ('R1', 'R3', 'R5')), true)
       THEN 'pass' ELSE 'fail' END AS suggested_verdict
FROM {T.SQL_REPORTS} r LEFT JOIN {SQL_EFFECTIVE} e ON e.run_id = r.run_id GROUP BY r.report_id""")
def verdict_must_pass_tags(spark, sf_dir):
    return _verdict(spark, sf_dir, {"type": "must_pass_tags", "tags": ["R1", "R3", "R5"]})


# ---- coverage ------------------------------------------------------------------------
@query("coverage_counts", sql=f"""
SELECT coalesce(nullif(requirement_ref, ''), '(unmapped)') AS ref, count(*) AS total, count_if(passed) AS passed
FROM {SQL_TEXT_GATE} GROUP BY 1""")
def coverage_counts(spark, sf_dir):
    return COV.tested(text_gate(spark, sf_dir))


@query("coverage_by_requirement", sql=f"""
WITH t AS (SELECT coalesce(nullif(requirement_ref, ''), '(unmapped)') AS ref, count(*) AS total,
                  count_if(passed) AS passed FROM {T.SQL_CASE_RESULTS} GROUP BY 1)
SELECT q.req_id, q.text, q.section, coalesce(t.total, 0) AS total, coalesce(t.passed, 0) AS passed,
  coalesce(t.total, 0) > 0 AS covered
FROM {T.SQL_REQUIREMENTS} q LEFT JOIN t ON t.ref = q.req_id""")
def coverage_by_requirement(spark, sf_dir):
    return COV.by_requirement(F.broadcast(T.requirements(spark)), T.case_results(spark, sf_dir))


@query("uncovered", sql=f"""
SELECT q.req_id, q.text, q.section FROM {T.SQL_REQUIREMENTS} q
WHERE NOT EXISTS (SELECT 1 FROM {T.SQL_CASE_RESULTS} c WHERE c.requirement_ref = q.req_id)""")
def uncovered(spark, sf_dir):
    return COV.uncovered(T.requirements(spark), T.case_results(spark, sf_dir))


@query("orphans", sql=f"""
SELECT DISTINCT coalesce(nullif(requirement_ref, ''), '(unmapped)') AS ref FROM {T.SQL_TEXT_RESPONSES} c
WHERE coalesce(nullif(requirement_ref, ''), '(unmapped)') NOT IN (SELECT req_id FROM {T.SQL_REQUIREMENTS})""")
def orphans(spark, sf_dir):
    return COV.orphans(F.broadcast(T.requirements(spark)), T.text_responses(spark, sf_dir))


# Requirement lists per run: run -> version (o_custkey modulo the number of documents; none for every
# seventh customer) -> the requirements that the version's text, document doc_id = version, splits into.
def run_versions(spark, sf_dir):
    n_docs = T.table(spark, sf_dir, "documents").count()  # one scalar
    v = F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey") % F.lit(n_docs))
    return T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), v.alias("version_id"))


def version_requirements(spark, sf_dir):
    docs = T.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("version_id"), "text")
    return split_requirements(docs.join(run_versions(spark, sf_dir).select("version_id").distinct(), "version_id",
                                        "left_semi"), key="version_id")


SQL_RUN_REQUIREMENTS = f"""(SELECT o_orderkey AS run_id, req_id, text, section, position
  FROM orders JOIN ({SQL_SPLIT}) r ON r.doc_id = o_custkey % (SELECT count(*) FROM documents) WHERE o_custkey % 7 <> 0)"""


@query("run_requirements", sql=f"SELECT run_id, count(*) AS requirements, max(position) AS last FROM {SQL_RUN_REQUIREMENTS} GROUP BY 1")
def run_requirements(spark, sf_dir):
    """SRC-6: the requirement list of every run, through its version."""
    r = COV.run_requirements(run_versions(spark, sf_dir), version_requirements(spark, sf_dir))
    return r.groupBy("run_id").agg(F.count(F.lit(1)).alias("requirements"), F.max("position").alias("last"))


@query("coverage_per_run", sql=f"""
WITH t AS (SELECT run_id, coalesce(nullif(requirement_ref, ''), '(unmapped)') AS ref, count(*) AS total FROM {T.SQL_CASE_RESULTS} GROUP BY ALL),
 m AS (SELECT run_id, ref, position, total, q.ref IS NOT NULL AS known
       FROM (SELECT run_id, req_id AS ref, position FROM {SQL_RUN_REQUIREMENTS}) q FULL JOIN t USING (run_id, ref)),
 s AS (SELECT run_id, count_if(known) AS n, count_if(known AND total IS NOT NULL) AS c,
         string_agg(ref, ',' ORDER BY position, ref) FILTER (known AND total IS NULL) AS unc,
         string_agg(ref, ',' ORDER BY ref) FILTER (NOT known) AS orp FROM
         (SELECT run_id, ref, position, total, position IS NOT NULL AS known FROM m) GROUP BY run_id)
SELECT o_orderkey AS run_id, coalesce(n, 0) AS requirements_total, coalesce(c, 0) AS requirements_covered,
  CASE WHEN n > 0 THEN round_even(c / n * 100, 1) END AS covered_pct, coalesce(unc, '') AS uncovered,
  coalesce(orp, '') AS orphans, coalesce(n, 0) > 0 AS known_requirements
FROM orders LEFT JOIN s ON s.run_id = o_orderkey""")
def coverage_per_run(spark, sf_dir):
    """AGG-8 per run: against the list of the run's own version, runs without cases included."""
    runs = run_versions(spark, sf_dir)
    reqs = COV.run_requirements(runs, version_requirements(spark, sf_dir))
    out = COV.per_run(reqs, T.case_results(spark, sf_dir), runs)
    return out.withColumns({c: F.array_join(c, ",") for c in ("uncovered", "orphans")})


# ---- baseline comparison (JON-12) -------------------------------------------------------
# Baseline run: the text spec over every document; current run: the same documents under a spec
# whose licence check is on 'Licensed' instead, with cases renamed where doc_id % 10 = 0 (so
# these are gone, and new under their new name). Per (suite, case): the status.
@query("regression_vs_baseline", sql=f"""
WITH b AS (SELECT suite_id, case_id, passed FROM {SQL_TEXT_GATE}),
     c AS (SELECT g.suite_id, CASE WHEN g.case_id % 10 = 0 THEN -1 - g.case_id ELSE g.case_id END AS case_id,
             (failed_checks - CASE WHEN contains(coalesce(text, ''), {q(LICENSE)}) THEN 0 ELSE 1 END
              + CASE WHEN contains(coalesce(text, ''), 'Licensed') THEN 0 ELSE 1 END) = 0 AS passed
           FROM {SQL_TEXT_GATE} g JOIN documents d ON d.doc_id = g.case_id)
SELECT coalesce(c.suite_id, b.suite_id) AS suite_id, coalesce(c.case_id, b.case_id) AS case_id,
  c.passed AS current_passed, b.passed AS baseline_passed,
  CASE WHEN b.passed IS NULL THEN 'new' WHEN c.passed IS NULL THEN 'gone'
       WHEN b.passed AND NOT c.passed THEN 'regressed' WHEN NOT b.passed AND c.passed THEN 'fixed'
       ELSE 'same' END AS status
FROM c FULL OUTER JOIN b ON c.suite_id = b.suite_id AND c.case_id = b.case_id""")
def regression_vs_baseline(spark, sf_dir):
    from proofline.operators.checks import Check
    r = T.text_responses(spark, sf_dir)
    keys = ["suite_id", "case_id"]
    base = apply_and_gate(r, TEXT_SPEC, keys, body=None)
    spec2 = [Check("contains", {"value": "Licensed"})] + TEXT_SPEC[1:]
    renamed = r.withColumn("case_id", F.when(F.col("case_id") % 10 == 0, -1 - F.col("case_id")).otherwise(F.col("case_id")))
    return RS.compare_to_baseline(apply_and_gate(renamed, spec2, keys, body=None), base, keys)


# Every order is a run of its customer's market segment, started on its order date; its report is
# approved (if done and passed) report_id % 20 days after that.
SQL_BASELINES = f"""(WITH ap AS (SELECT project, created_at + to_days(CAST(report_id % 20 AS INTEGER)) AS approved_at, max(report_id) AS report_id
    FROM {T.SQL_REPORTS} WHERE state = 'done' AND verdict = 'pass' GROUP BY ALL)
  SELECT r.run_id, r.project, r.created_at AS started_at, ap.report_id AS baseline_report_id, ap.report_id AS baseline_run_id
  FROM {T.SQL_REPORTS} r ASOF LEFT JOIN ap ON r.project = ap.project AND r.created_at > ap.approved_at)"""


def run_baselines(spark, sf_dir):
    r = T.reports(spark, sf_dir)
    days = (F.col("report_id") % 20).cast("int")
    approved = r.where("state = 'done' and verdict = 'pass'").select(
        "report_id", "run_id", "project", (F.col("created_at").cast("timestamp") + F.make_dt_interval(days)).alias("approved_at"))
    return RS.baseline_of_runs(r.select("run_id", "project", F.col("created_at").cast("timestamp").alias("started_at")), approved)


@query("run_baseline", sql=f"SELECT run_id, project, baseline_report_id FROM {SQL_BASELINES}")
def run_baseline(spark, sf_dir):
    """WIN-2 per run: the report approved last before the run started."""
    return run_baselines(spark, sf_dir).select("run_id", "project", "baseline_report_id")


@query("baseline_comparison", sql=f"""
WITH b AS MATERIALIZED (SELECT * FROM {SQL_BASELINES}),
 c AS (SELECT run_id, suite_id, l_linenumber AS case_no, bool_or(passed) AS passed FROM {T.SQL_CASE_RESULTS} GROUP BY ALL),
 n AS (SELECT run_id, suite_id, case_no, passed FROM c SEMI JOIN b USING (run_id)),
 o AS (SELECT b.run_id, c.suite_id, c.case_no, c.passed FROM b JOIN c ON c.run_id = b.baseline_run_id),
 j AS (SELECT run_id, suite_id, case_no, n.passed AS current_passed, o.passed AS baseline_passed FROM n FULL JOIN o USING (run_id, suite_id, case_no))
SELECT j.run_id, suite_id, case_no, baseline_report_id, current_passed, baseline_passed,
  CASE WHEN baseline_passed IS NULL THEN 'new' WHEN current_passed IS NULL THEN 'gone' WHEN baseline_passed AND NOT current_passed THEN 'regressed'
       WHEN NOT baseline_passed AND current_passed THEN 'fixed' ELSE 'same' END AS status
FROM j JOIN b USING (run_id)""")
def baseline_comparison(spark, sf_dir):
    """JON-12: every run, case by case, against the baseline approved last before it started."""
    cases = T.case_results(spark, sf_dir).withColumnRenamed("l_linenumber", "case_no")
    out = RS.compare_runs_to_baselines(run_baselines(spark, sf_dir), cases, ["suite_id", "case_no"])
    return out.select("run_id", "suite_id", "case_no", "baseline_report_id", "current_passed", "baseline_passed", "status")


# ---- run records (SNK-2, REV-7) and tokens (AGG-13) -----------------------------------------
@query("run_records", sql=f"""
WITH s AS (SELECT run_id, count(*) AS cases, count_if(passed) AS passed,
             CAST(round(sum(CAST(coalesce(cost_usd, 0) AS DECIMAL(24,8))), 6) AS DOUBLE) AS cost FROM {T.SQL_CASE_RESULTS} GROUP BY 1)
SELECT o_orderkey AS run_id, CASE WHEN o_orderstatus = 'P' THEN 'error' ELSE 'complete' END AS status,
  CASE WHEN o_orderstatus = 'P' THEN 'TimeoutError: ' || o_orderpriority END AS error, coalesce(cost, 0.0) AS total_cost_usd,
  coalesce(cases, 0) AS cases, coalesce(passed, 0) AS passed, coalesce(cases, 0) - coalesce(passed, 0) AS failed,
  CASE WHEN o_orderstatus <> 'P' THEN 'pending' END AS report_state,
  CASE WHEN o_orderstatus <> 'P' THEN 'run created' END AS transition_note
FROM orders LEFT JOIN s ON s.run_id = o_orderkey""")
def run_records(spark, sf_dir):
    """SNK-2 / REV-7: every order a run; those still processing failed with their priority as text."""
    o = T.table(spark, sf_dir, "orders")
    failures = o.where("o_orderstatus = 'P'").select(
        F.col("o_orderkey").alias("run_id"), F.lit("TimeoutError").alias("error_type"),
        F.col("o_orderpriority").alias("error_message"))
    return RS.run_records(o.select(F.col("o_orderkey").alias("run_id")), T.case_results(spark, sf_dir), failures)


@query("token_rollup", sql="""
SELECT lang AS run_id, source AS suite_id, count(*) AS responses,
  CAST(sum(CASE WHEN doc_id % 9 = 0 THEN 0 ELSE n_chars // 4 END) AS BIGINT) AS input_tokens,
  CAST(sum(CASE WHEN doc_id % 9 = 0 THEN 0 ELSE doc_id % 7 END) AS BIGINT) AS output_tokens
FROM documents GROUP BY 1, 2""")
def token_rollup(spark, sf_dir):
    """AGG-13: usage as JSON text, missing for every ninth response."""
    d = T.table(spark, sf_dir, "documents")
    usage = F.when(F.col("doc_id") % 9 != 0, F.to_json(F.struct(
        F.floor(F.col("n_chars") / 4).alias("input_tokens"), (F.col("doc_id") % 7).alias("output_tokens"))))
    return RS.token_rollup(d.select(F.col("lang").alias("run_id"), F.col("source").alias("suite_id"), usage.alias("usage")),
                           ["run_id", "suite_id"])


# ---- rollups of cost and pass rate (AGG-13/14) -------------------------------------------
@query("cost_rollup", sql=f"""
WITH per_run AS (SELECT run_id, count(*) AS cases, sum(CAST(coalesce(cost_usd, 0) AS DECIMAL(24,8))) AS cost
                 FROM {T.SQL_CASE_RESULTS} GROUP BY run_id)
SELECT r.project, count(*) AS runs, CAST(coalesce(sum(p.cases), 0) AS BIGINT) AS cases,
  CAST(round(coalesce(sum(p.cost), 0), 4) AS DOUBLE) AS total_cost_usd
FROM {T.SQL_REPORTS} r LEFT JOIN per_run p ON p.run_id = r.run_id GROUP BY r.project""")
def cost_rollup(spark, sf_dir):
    per_run = T.case_results(spark, sf_dir).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("cases"), F.sum(RS.exact_cost(F.col("cost_usd"))).alias("cost"))
    rep = T.reports(spark, sf_dir).select("run_id", "project")
    return rep.join(per_run, "run_id", "left").groupBy("project").agg(
        F.count(F.lit(1)).alias("runs"), F.coalesce(F.sum("cases"), F.lit(0)).cast("long").alias("cases"),
        RS.rounded(F.coalesce(F.sum("cost"), F.lit(0).cast("decimal(24,8)")), 4).alias("total_cost_usd"))


@query("pass_rate_trend", sql=f"""
WITH per_run AS (SELECT run_id, count(*) AS cases, count_if(effective_passed) AS passed FROM {SQL_EFFECTIVE} GROUP BY run_id)
SELECT r.project, strftime(r.created_at, '%Y-%m') AS month, CAST(sum(p.cases) AS BIGINT) AS cases,
  CAST(sum(p.passed) AS BIGINT) AS passed, round(sum(p.passed) / sum(p.cases), 4) AS pass_rate
FROM {T.SQL_REPORTS} r JOIN per_run p ON p.run_id = r.run_id GROUP BY 1, 2""")
def pass_rate_trend(spark, sf_dir):
    per_run = RS.run_summary(effective_results(spark, sf_dir), flag="effective_passed")
    rep = T.reports(spark, sf_dir).select("run_id", "project", "created_at")
    return (rep.join(per_run, "run_id").groupBy(
        "project", F.date_format("created_at", "yyyy-MM").alias("month"))
        .agg(F.sum("cases").alias("cases"), F.sum("passed").alias("passed"))
        .withColumn("pass_rate", F.round(F.col("passed") / F.col("cases"), 4)))
