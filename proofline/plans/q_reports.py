"""Report lines for every run of the text responses (SNK-1, SNK-4)."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from proofline.operators import report as RP
from proofline.operators import results as RS
from proofline.operators.evaluate import check_columns, gate_column
from proofline.plans.q_checks import LICENSE, LICENSE_RE, SECRET, SQL_CARD, SQL_EMAIL, SQL_IBAN, TEXT_SPEC
from proofline.plans.q_results import SQL_TEXT_GATE
from proofline.plans.registry import ORACLE, query
from proofline.plans.sqltext import q
from proofline.session import checkpoint_dir
from proofline.sources import tables as T

# headers: one run per language; Spanish runs have no requirement list
_SQL_CHECK = f"""
  SELECT doc_id AS case_id, 0 AS i, contains(coalesce(text, ''), {q(LICENSE)}) AS ok, 'template:contains' AS id,
    'text ' || CASE WHEN contains(coalesce(text, ''), {q(LICENSE)}) THEN 'contains' ELSE 'missing' END || ': ' || {q(repr(LICENSE))} AS msg FROM documents
  UNION ALL SELECT doc_id, 1, NOT contains(coalesce(text, ''), {q(SECRET)}), 'template:not_contains',
    'forbidden string ' || CASE WHEN contains(coalesce(text, ''), {q(SECRET)}) THEN 'present' ELSE 'absent' END || ': ' || {q(repr(SECRET))} FROM documents
  UNION ALL SELECT doc_id, 2, regexp_matches(coalesce(text, ''), {q('(?sm)' + LICENSE_RE)}), 'template:regex_match',
    'pattern ' || CASE WHEN regexp_matches(coalesce(text, ''), {q('(?sm)' + LICENSE_RE)}) THEN 'matched' ELSE 'no match' END || ': ' || {q(repr(LICENSE_RE))} FROM documents
  UNION ALL SELECT doc_id, 3, e + n + c = 0, 'template:pii_absent', CASE WHEN e + n + c = 0 THEN 'no PII detected' ELSE 'PII detected: [' ||
      concat_ws(', ', CASE WHEN e > 0 THEN '''email''' END, CASE WHEN n > 0 THEN '''iban''' END, CASE WHEN c > 0 THEN '''card''' END) || ']' END
    FROM (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), {q(SQL_EMAIL)})) AS e,
          len(regexp_extract_all(coalesce(text, ''), {q(SQL_IBAN)})) AS n, len(regexp_extract_all(coalesce(text, ''), {q(SQL_CARD)})) AS c FROM documents)
  UNION ALL SELECT doc_id, 4, NOT r, 'template:refusal_detector', 'refusal=' || CASE WHEN r THEN 'True' ELSE 'False' END || ', expected=False'
    FROM (SELECT doc_id, list_bool_or(list_transform(['i can''t', 'i cannot', 'i''m unable', 'cannot help', 'not able to', 'i won''t'],
          lambda m: contains(lower(coalesce(text, '')), m))) AS r FROM documents)"""


@query("report_markdown", sql=f"""
WITH g AS (SELECT g.run_id, g.suite_id, g.case_id, g.passed, coalesce(nullif(g.requirement_ref, ''), '(unmapped)') AS ref, d.n_chars
           FROM {SQL_TEXT_GATE} g JOIN documents d ON d.doc_id = g.case_id),
 runs AS (SELECT run_id, count(*) AS cases, count_if(passed) AS passed, sum(n_chars) AS chars FROM g GROUP BY run_id),
 req AS (SELECT run_id, req_id AS ref, CAST(substr(req_id, 2) AS INT) AS position, text FROM runs, {T.SQL_REQUIREMENTS} WHERE run_id <> 'es'),
 t AS (SELECT run_id, ref, count(*) AS total, count_if(passed) AS passed FROM g GROUP BY ALL),
 m AS (SELECT run_id, ref, position, text, coalesce(total, 0) AS total, coalesce(passed, 0) AS passed, position IS NOT NULL AS known
       FROM req FULL JOIN t USING (run_id, ref)),
 s AS (SELECT run_id, count_if(known) AS n, count_if(known AND total > 0) AS c,
         list('`' || ref || '`' ORDER BY position) FILTER (known AND total = 0) AS unc, list('`' || ref || '`' ORDER BY ref) FILTER (NOT known) AS orp
       FROM m GROUP BY run_id),
 h AS (SELECT run_id, unnest([
    '# Evaluation report — documents in ' || run_id || ' (run ' || run_id || ')', '',
    '- **State:** pending', '- **Approved by:** — (—)', '- **Target:** ' || '`captured` ' || run_id,
    '- **Spec hash:** `' || md5(run_id) || '`  •  **Commit:** `—`', '- **Trigger:** batch by builder',
    '- **Summary:** ' || cases || ' cases, ' || passed || ' passed, ' || (cases - passed) || ' failed  •  **Cost:** $' || printf('%.4f', chars / 1e6), '']) AS line,
    unnest(range(9)) AS k3 FROM runs),
 cov AS (SELECT run_id, 1 AS section, unnest(['## Requirement coverage', '',
     CASE WHEN n = 0 THEN '_Requirement list unavailable for this run; showing tested requirements only._'
          ELSE '**' || c || '/' || n || ' requirements covered (' || CAST(round_even(c / n * 100, 1) AS VARCHAR) || '%)**' END, '']) AS line, unnest(range(4)) AS k3 FROM s
   UNION ALL SELECT run_id, 3, unnest([CASE WHEN n > 0 AND len(unc) > 0 THEN '' END,
     CASE WHEN n > 0 AND len(unc) > 0 THEN '> ' || len(unc) || ' requirement(s) have no test: ' || array_to_string(unc, ', ') END,
     CASE WHEN n > 0 AND len(orp) > 0 THEN '' END,
     CASE WHEN n > 0 AND len(orp) > 0 THEN '> Orphan tests, citing a requirement that no longer exists: ' || array_to_string(orp, ', ') END, '']), unnest(range(5)) FROM s)
SELECT run_id, 0 AS section, '' AS k1, '' AS k2, k3, line FROM h
UNION ALL SELECT run_id, section, '', '', k3, line FROM cov WHERE line IS NOT NULL
UNION ALL SELECT run_id, 2, ref, '', coalesce(position, 0), '- `' || ref || '` — ' ||
    CASE WHEN total > 0 THEN passed || '/' || total || ' passed' ELSE '**NOT COVERED**' END || CASE WHEN n > 0 THEN ' — ' || text ELSE '' END
  FROM m JOIN (SELECT run_id, n FROM s) USING (run_id) WHERE known OR n = 0
UNION ALL SELECT run_id, 4, '', '', unnest([0, 1]), unnest(['## Cases', '']) FROM runs
UNION ALL SELECT run_id, 5, suite_id, CAST(case_id AS VARCHAR), -1, '### [' || CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END || '] ' || suite_id || ' / ' || case_id
    || '  (' || n_chars || ' ms)' FROM g
UNION ALL SELECT run_id, 5, suite_id, CAST(case_id AS VARCHAR), i, '  - [' || CASE WHEN ok THEN 'ok' ELSE 'X' END || '] ' || id || ': ' || msg
  FROM g JOIN ({_SQL_CHECK}) USING (case_id)
UNION ALL SELECT run_id, 5, suite_id, CAST(case_id AS VARCHAR), 5, '' FROM g""")
def report_markdown(spark, sf_dir):
    """Header, coverage and one block per case with a line per check, per run (language). The
    checks run once into the stored results; a response's length stands in for its latency."""
    r = T.text_responses(spark, sf_dir, extra=["n_chars"])
    df = r.withColumn("json", F.lit(None).cast("variant"))
    cols = check_columns(TEXT_SPEC, latency=None, cost=None)
    cases = RP.store_case_results(
        df.select("run_id", "suite_id", "case_id", "requirement_ref", F.col("n_chars").cast("double").alias("latency_ms"),
                  gate_column(cols).alias("passed"), F.array(*cols).alias("checks")),
        f"{checkpoint_dir(spark)}/case-results-{uuid.uuid4().hex}")
    runs = cases.groupBy("run_id").agg(F.sum("latency_ms").alias("_chars"))
    headers = runs.select(
        "run_id", F.concat(F.lit("documents in "), "run_id").alias("project"), F.lit("pending").alias("state"),
        F.lit(None).cast("string").alias("approved_by"), F.lit(None).cast("string").alias("approved_at"),
        F.concat(F.lit("`captured` "), "run_id").alias("target"), F.md5("run_id").alias("spec_hash"),
        F.lit(None).cast("string").alias("commit"), F.lit("batch").alias("trigger"), F.lit("builder").alias("triggered_by"),
        (F.col("_chars") / 1e6).alias("cost_usd"))
    # a requirement list per run that has one: runs times 14 literal rows
    lists = runs.where("run_id <> 'es'").select("run_id", F.inline(F.array(*[F.struct(
        F.lit(i).alias("req_id"), F.lit(f"Requirement {i[1:]} holds.").alias("text"), F.lit(int(i[1:])).alias("position"))
        for i in T.REQUIREMENT_IDS])))
    return RP.report_lines(headers, lists, cases, RS.run_summary(cases))


@query("report_digests", sql=f"""
WITH n AS (SELECT run_id, line, row_number() OVER (PARTITION BY run_id ORDER BY section, k1, k2, k3) - 1 AS p FROM ({ORACLE["report_markdown"]})),
 a AS (SELECT run_id, p // 1024 AS g, count(*) AS n, sha256(string_agg(line, chr(10) ORDER BY p)) AS h FROM n GROUP BY run_id, p // 1024),
 b AS (SELECT run_id, g // 1024 AS gg, sum(n) AS n, sha256(string_agg(h, chr(10) ORDER BY g)) AS h FROM a GROUP BY run_id, g // 1024)
SELECT run_id, CAST(sum(n) AS BIGINT) AS lines, sha256(string_agg(h, chr(10) ORDER BY gg)) AS digest FROM b GROUP BY run_id""")
def report_digests(spark, sf_dir):
    """SNK-4: all reports written into packed files, read back, a digest per run."""
    path = f"{checkpoint_dir(spark)}/reports-{uuid.uuid4().hex}"
    RP.write_packed(report_markdown(spark, sf_dir), path)
    return RP.run_digests(spark.read.parquet(path))
