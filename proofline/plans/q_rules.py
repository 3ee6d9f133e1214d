"""Keyword rules that are rows of a table, against the documents."""
from __future__ import annotations

from pyspark.sql import functions as F

from proofline.operators import rules as RL
from proofline.operators.testsets import BASELINES
from proofline.plans.registry import query
from proofline.plans.sqltext import q
from proofline.sources import tables as T

# A rule per part name and kind (p_size % 4): the two words of the name as a phrase, as the ends of
# a word, as beginnings of words with a suffix, and a pattern of single letters (no literal).
_W1, _W2 = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)"
_PATTERN = f"""CASE p_size % 4 WHEN 0 THEN {_W1} || '[a-z]* ' || {_W2}
  WHEN 1 THEN '\\b' || substr({_W1}, 1, 3) || '[a-z]*' || substr({_W2}, 1, 2) || '|' || p_name
  WHEN 2 THEN '(' || substr({_W1}, 1, 3) || '|' || substr({_W2}, 1, 3) || ')(ly|tion|er)'
  ELSE '\\b' || substr({_W2}, 1, 2) || '[a-z]' || substr({_W1}, 1, 1) || '\\b' END"""
_SQL_RULES = f"(SELECT DISTINCT p_name || '/' || p_size % 4 AS rule_id, {_PATTERN} AS pattern, p_name FROM part)"

# DuckDB's \b knows ASCII words only: an edge of a word in any script, as Python has it
_EDGE = "'(?:^|$|[^\\pL\\pN_])'"


def part_rules(spark, sf_dir):
    """(rule_id, pattern, ...) of the part names; assertions name the part."""
    p = T.table(spark, sf_dir, "part")
    pattern = F.expr(_PATTERN.replace("\\", "\\\\"))
    ident = F.concat("p_name", F.lit("/"), (F.col("p_size") % 4).cast("string"))
    return p.select(ident.alias("rule_id"), pattern.alias("pattern"), "p_name").distinct().select(
        "rule_id", "pattern", F.replace("rule_id", F.lit(" "), F.lit("-")).alias("suffix"), F.lit("quality").alias("category"),
        F.concat(F.lit("response treats "), "p_name").alias("assertion"), F.lit("judge").alias("how"),
        F.lit(None).cast("string").alias("template"), F.lit(None).cast("string").alias("params"), F.lit(0.8).alias("threshold"))


@query("rule_table", sql=f"""
WITH r AS {_SQL_RULES},
 hits AS (SELECT doc_id, rule_id, p_name FROM documents JOIN r ON regexp_matches(text, '(?i)' || replace(pattern, '\\b', {_EDGE})) WHERE length(trim(text)) > 0)
SELECT doc_id, 'H-R1-' || replace(rule_id, ' ', '-') AS intent_id, 'R1' AS requirement_ref, 'quality' AS category,
  'response treats ' || p_name AS assertion, 'judge' AS how, CAST(NULL AS VARCHAR) AS template, CAST(NULL AS VARCHAR) AS params, CAST(0.8 AS DOUBLE) AS threshold FROM hits
""" + "".join(f"""
UNION ALL SELECT doc_id, 'H-R1-{s}', 'R1', {q(c)}, {q(a)}, 'template', {q(t)}, {q(p)}, NULL FROM documents
WHERE length(trim(text)) > 0 AND doc_id NOT IN (SELECT doc_id FROM hits)""" for s, c, a, t, p in BASELINES))
def rule_table(spark, sf_dir):
    """JON-9 / TXT-2: each document is one requirement (R1), the rules are rows made from `part`."""
    d = T.table(spark, sf_dir, "documents").where(F.length(F.trim("text")) > 0)
    reqs = d.select("doc_id", F.lit("R1").alias("req_id"), "text", F.lit(1).alias("position"))
    return RL.rule_intents(reqs, part_rules(spark, sf_dir))
