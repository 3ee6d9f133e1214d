"""User checks: a registered Python check and the same rule as a Column."""
from __future__ import annotations

from pyspark.sql import functions as F

from proofline.operators import udf as U
from proofline.operators.checks import Check
from proofline.operators.evaluate import apply_checks, with_body
from proofline.plans.registry import query
from proofline.sources import tables as T

SQL_NAMED = f"""
SELECT l_orderkey, l_linenumber, a1 <> '' AND coalesce(a2 <> '', false) AS passed
FROM {T.SQL_FINDINGS}"""


@query("user_check_udf", sql=f"""
SELECT l_orderkey, l_linenumber, a1 <> '' AND coalesce(a2 <> '', false) AS passed,
  ((CASE WHEN a1 <> '' THEN 1 ELSE 0 END) + (CASE WHEN a2 <> '' THEN 1 ELSE 0 END)) / 2 AS score,
  '{{"suite": "' || l_linestatus || '"}}' AS evidence
FROM {T.SQL_FINDINGS}""")
def user_check_udf(spark, sf_dir):
    """UDF-1/2: a registered Python check over every finding body (Arrow-batched), with the
    suite as its context."""
    r = T.finding_responses(spark, sf_dir)
    res = apply_checks(r, [Check("articles_named", type="generated")], ["l_orderkey", "l_linenumber"],
                       text=None, latency=None, context=F.to_json(F.struct(F.col("suite_id").alias("suite"))))
    return res.select("l_orderkey", "l_linenumber", "passed", "score", "evidence")


@query("user_check_native", sql=SQL_NAMED)
def user_check_native(spark, sf_dir):
    """UDF-2 expressed natively: the same rule as a Column, no Python in the plan."""
    r = with_body(T.finding_responses(spark, sf_dir))
    return r.select("l_orderkey", "l_linenumber", U.articles_named_native(F.col("json")).alias("passed"))
