"""Judge reduction over verdict samples and evidence-quote verification."""
from __future__ import annotations

from pyspark.sql import functions as F

from proofline.functions.columns import let
from proofline.functions.text import fold
from proofline.operators import judge as J
from proofline.operators.checks import Check
from proofline.operators.evaluate import apply_checks, case_gate, with_judgements
from proofline.plans.registry import query
from proofline.plans.sqltext import q
from proofline.sources import tables as T

# ---- verdict samples derived from events ---------------------------------------------
# case = user_id, dimension = event_type, sample = event_id; the score is written in
# varying JSON forms to exercise coercion: event_id % 4 = 0 -> "n" (string), 1 -> n + 0.9
# (float, truncates), 2 -> n (int), 3 -> "n.5" (not an integer: dropped); n = event_id % 3. Every
# sixth verdict also scores a dimension that no rubric lists.


def verdict_samples(spark, sf_dir):
    e = T.table(spark, sf_dir, "events")
    n = (F.col("event_id") % 3).cast("string")
    k = F.col("event_id") % 4
    value = (F.when(k == 0, F.concat(F.lit('"'), n, F.lit('"')))
             .when(k == 1, F.concat(n, F.lit(".9")))
             .when(k == 2, n).otherwise(F.concat(F.lit('"'), n, F.lit('.5"'))))
    noise = F.when(F.col("event_id") % 6 == 0, F.concat(F.lit(', "noise": '), n)).otherwise("")
    scores = F.concat(F.lit('{"'), F.col("event_type"), F.lit('": '), value, noise, F.lit("}"))
    return e.select(F.col("user_id").alias("case_id"), F.col("event_id").alias("sample_no"),
                    F.lit("r1").alias("rubric_id"), scores.alias("scores"))


SQL_SCORES = """(SELECT user_id AS case_id, event_type AS dim,
  CASE WHEN event_id % 4 = 3 THEN NULL ELSE event_id % 3 END AS score FROM events)"""

# Rubric dimensions: r1 = the five event types (click needs 1, the rest the top of the
# 0..2 scale); r2 = r1 plus 'safety', which no sample scores.
DIMS = [("r1", "click", 0, 1), ("r1", "view", 1, None), ("r1", "purchase", 2, None),
        ("r1", "signup", 3, None), ("r1", "error", 4, None)]
DIMS = DIMS + [("r2",) + d[1:] for d in DIMS] + [("r2", "safety", 5, None)]


def dims_table(spark):
    rows = [(r, d, p, m, None, 2) for r, d, p, m in DIMS]
    return spark.createDataFrame(
        rows, "rubric_id string, dim string, dim_pos int, min_score int, rubric_min int, scale_top int")


SQL_DIMS = "(SELECT * FROM (VALUES " + ", ".join(
    f"('{r}', '{d}', {p}, {m if m is not None else 'NULL'}, 2)" for r, d, p, m in DIMS
) + ") AS t(rubric_id, dim, dim_pos, min_score, scale_top))"


def reduced(spark, sf_dir):
    s = J.explode_scores(verdict_samples(spark, sf_dir), ["case_id"], dims=dims_table(spark))
    return J.reduce_scores(s, ["case_id"])


SQL_REDUCED = f"""(SELECT case_id, dim, count(score) AS n, CAST(floor(median(score)) AS INT) AS median,
  CAST(max(score) - min(score) AS INT) AS spread FROM {SQL_SCORES} WHERE score IS NOT NULL GROUP BY case_id, dim)"""


@query("judge_median_spread", headline=True, sql=f"SELECT * FROM {SQL_REDUCED}")
def judge_median_spread(spark, sf_dir):
    return reduced(spark, sf_dir)


@query("judge_consistency", sql=f"""
SELECT case_id, max(n) AS samples, max(spread) AS max_spread, max(spread) = 0 AS agreed
FROM {SQL_REDUCED} GROUP BY case_id HAVING max(n) > 1""")
def judge_consistency(spark, sf_dir):
    return J.consistency(reduced(spark, sf_dir), ["case_id"]).select("case_id", "samples", "max_spread", "agreed")


def _scored(spark, sf_dir, rubric):
    cases = T.table(spark, sf_dir, "events").select(F.col("user_id").alias("case_id")) \
        .distinct().withColumn("rubric_id", F.lit(rubric))
    return J.score_checks(reduced(spark, sf_dir), dims_table(spark), cases, ["case_id"]) \
        .select("case_id", "passed", "score", "n_failures", "message")


def _sql_scored(rubric):
    return f"""
WITH cases AS (SELECT DISTINCT user_id AS case_id FROM events),
     g AS (SELECT c.case_id, d.dim, d.dim_pos, coalesce(d.min_score, d.scale_top) AS threshold, d.scale_top, r.median
           FROM cases c JOIN {SQL_DIMS} d ON d.rubric_id = {q(rubric)}
           LEFT JOIN {SQL_REDUCED} r ON r.case_id = c.case_id AND r.dim = d.dim),
     f AS (SELECT *, CASE WHEN median IS NULL THEN 'judge did not score dimension ''' || dim || ''''
                          WHEN median < threshold THEN dim || '=' || CAST(median AS VARCHAR) || ' < min_score ' || CAST(threshold AS VARCHAR)
                     END AS failure FROM g)
SELECT case_id, count(failure) = 0 AS passed, round_even(sum(coalesce(median, 0)) / sum(scale_top), 3) AS score,
  CAST(count(failure) AS INT) AS n_failures,
  coalesce(string_agg(failure, '; ' ORDER BY dim_pos), '') AS message
FROM f GROUP BY case_id"""


@query("judge_score", sql=_sql_scored("r1"))
def judge_score(spark, sf_dir):
    return _scored(spark, sf_dir, "r1")


@query("judge_missing_dim", sql=_sql_scored("r2"))
def judge_missing_dim(spark, sf_dir):
    return _scored(spark, sf_dir, "r2")


# ---- rationale and evidence in the result ----------------------------------------------
# rationale of a sample: empty for every third event, else 'why <event_id>'. Rubric r1 requires
# evidence: users 4k quote nothing, users 4k + 1 something made up, the rest what was said.
def _message(spark, sf_dir):
    e = T.table(spark, sf_dir, "events")
    user = F.col("user_id")
    said = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("why "), F.col("event_id").cast("string")))
    quote = F.when(user % 4 == 1, F.array(F.lit("made it's up"))).when(user % 4 > 1, F.array(
        F.concat(F.lit("USER  "), user.cast("string")))).otherwise(F.expr("cast(array() as array<string>)"))
    v = e.select(user.alias("case_id"), F.col("event_id").alias("sample_no"), said.alias("rationale"),
                 quote.alias("evidence_quotes"))
    body = F.to_json(F.struct(F.struct(F.array(F.struct(user.alias("user"))).alias("said")).alias("from")))
    cases = e.select("user_id").distinct().select(
        user.alias("case_id"), F.lit("r1").alias("rubric_id"),
        fold(J.haystack(F.lit("said:"), F.parse_json(body))).alias("hay"))
    ev = J.evidence_failures(cases, J.unique_quotes(v, ["case_id"]), ["case_id"])
    return J.score_checks(reduced(spark, sf_dir), dims_table(spark), cases, ["case_id"],
                          rationale=J.first_rationale(v, ["case_id"]), evidence=ev)


_SQL_MESSAGE = f"""
WITH b AS ({_sql_scored("r1")}),
 r AS (SELECT user_id AS case_id, 'why ' || min(event_id) FILTER (event_id % 3 <> 0) AS why FROM events GROUP BY 1)
SELECT case_id, passed AND case_id % 4 > 1 AS passed, score, CAST(n_failures + CASE WHEN case_id % 4 <= 1 THEN 1 ELSE 0 END AS INT) AS n_failures,
  concat_ws('; ', nullif(message, ''), CASE case_id % 4 WHEN 0 THEN 'rubric requires evidence, but the judge quoted nothing'
     WHEN 1 THEN 'evidence quotes do not appear in the response: "made it''s up"' END, why) AS message
FROM b JOIN r USING (case_id)"""


@query("judge_message", sql=_SQL_MESSAGE)
def judge_message(spark, sf_dir):
    """JDG-10..14: failures in dimension order, evidence last, then the first rationale."""
    return _message(spark, sf_dir).select("case_id", "passed", "score", "n_failures", "message")


@query("judge_gate", sql=f"""
WITH j AS ({_SQL_MESSAGE}), u AS (SELECT user_id AS case_id, max(value) AS v FROM events GROUP BY 1)
SELECT case_id, v <= 120 AND score >= 0.3 AS passed, score >= 0.3 AS judge_passed, 'judge:primary' AS judge_check
FROM u JOIN j USING (case_id)""")
def judge_gate(spark, sf_dir):
    """Judge results in the case gate: one latency check and one graded judge check per user."""
    e = T.table(spark, sf_dir, "events")
    cases = e.groupBy(F.col("user_id").alias("case_id")).agg(F.max("value").alias("latency_ms"), F.max("props").alias("body"))
    res = apply_checks(cases, [Check("latency_bound", {"max_ms": 120}), Check(type="judge", judge="primary", threshold=0.3)],
                       ["case_id"], text=None)
    j = _message(spark, sf_dir).select("case_id", F.lit(1).cast("long").alias("check_index"), F.lit("primary").alias("judge"),
                                       "passed", "score", "message", "severity", F.lit(None).cast("string").alias("evidence"))
    res = with_judgements(res, j, ["case_id"])
    judged = res.where("type = 'judge'").select("case_id", F.col("passed").alias("judge_passed"), F.col("check_id").alias("judge_check"))
    return case_gate(res, ["case_id"]).join(judged, "case_id")


# ---- replies of a judge, by doc_id % 5: an object, an object in prose, a list, a broken object,
# nothing at all
VERDICT_SCHEMA = {"type": "object", "required": ["scores"], "properties": {
    "scores": {"type": "object", "additionalProperties": {"type": "integer"}}}}


@query("judge_parse", sql="""
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '{"rationale":"r' || doc_id || '","scores":{"a":1}}' WHEN doc_id % 7 = 1 THEN '{"scores":{"b":2}}'
    WHEN doc_id % 7 = 5 THEN '{"scores":{"c":' || doc_id || '}}' END AS verdict_json,
  CASE doc_id % 7 WHEN 2 THEN 'expected an object, got array' WHEN 3 THEN 'no JSON object in the reply' WHEN 4 THEN 'empty reply'
    WHEN 6 THEN CASE WHEN doc_id % 2 = 0 THEN 'does not match the schema: ''scores'' is a required property'
                     ELSE 'does not match the schema: additional properties are not allowed or not valid' END END AS verdict_error
FROM documents""")
def judge_parse(spark, sf_dir):
    """JDG-4: replies that are an object, hold one in prose, hold one behind the document's own words
    and braces that never close, are no object, or do not match the schema."""
    d = T.table(spark, sf_dir, "documents").select("doc_id", "text")
    k, i = F.col("doc_id") % 7, F.col("doc_id").cast("string")
    words = F.regexp_replace(F.coalesce("text", F.lit("")), "[{}\"]", "")
    reply = (F.when(k == 0, F.concat(F.lit('{"scores": {"a": 1}, "rationale": "r'), i, F.lit('"}')))
             .when(k == 1, 'Sure {thing}: {"scores": {"b": 2}} and {"more": 3}').when(k == 2, '[{"a": 1}]')
             .when(k == 3, 'I would say { "scores": ')
             .when(k == 5, F.concat(F.regexp_replace(words, " ", " {"), F.lit('{"open": {"scores": {"c": '), i, F.lit("}}")))
             .when((k == 6) & (F.col("doc_id") % 2 == 0), "is {} it?").when(k == 6, 'so {"scores": {"a": "x"}}'))
    return J.parse_verdicts(d.withColumn("verdict", reply), schema=VERDICT_SCHEMA).select("doc_id", "verdict_json", "verdict_error")


# ---- evidence quotes inside documents --------------------------------------------------
# Per document six quotes: its own words 3..14 lower-cased, re-wrapped and in curly quotes
# (present); words 1..4 '...' words 9..12 (present, elided); words 1..3, 6..8 and 11..13 elided; the first pair reversed (absent
# unless repeated); a blank elision; and the benchmark passage with item_id =
# doc_id % (number of benchmark items).
def quote_table(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents").select("doc_id", "text")
    b = T.table(spark, sf_dir, "benchmark")
    n_items = b.count()  # one scalar: documents are paired with item doc_id % n
    # few items for many documents: both sides carry a salt, items once each
    d = d.withColumn("item_id", F.col("doc_id") % F.lit(n_items)).withColumn(
        "_s", F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int"))
    b = b.select("item_id", F.col("text").alias("passage"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("_s"))
    w = F.split(F.col("text"), " ")
    own = F.concat(F.lit("“"), F.regexp_replace(F.lower(F.array_join(F.slice(w, 3, 12), " ")), " ", "\n  "),
                   F.lit("”"))
    head = F.array_join(F.slice(w, 1, 4), " ")
    tail = F.array_join(F.slice(w, 9, 4), " ")
    triple = F.concat_ws(" ... ", *[F.array_join(F.slice(w, i, 3), " ") for i in (1, 6, 11)])
    quotes = F.array(
        F.struct(F.lit("own").alias("variant"), own.alias("quote")),
        F.struct(F.lit("elided").alias("variant"), F.concat(head, F.lit(" ... "), tail).alias("quote")),
        F.struct(F.lit("triple").alias("variant"), triple.alias("quote")),
        F.struct(F.lit("reversed").alias("variant"), F.concat(tail, F.lit(" … "), head).alias("quote")),
        F.struct(F.lit("blank").alias("variant"), F.lit("  ...  ").alias("quote")),
        F.struct(F.lit("bench").alias("variant"), F.col("passage").alias("quote")))
    return d.join(b, ["item_id", "_s"]).select("doc_id", "text", quotes.alias("quotes"))


def _sql_fold(x):
    return (f"regexp_replace(trim(regexp_replace(lower(translate({x}, '‘’‚‛“”„–—− ', "
            f"'''''''''\"\"\"--- ')), '\\s+', ' ', 'g')), '^[\"'']+|[\"'']+$', '', 'g')")


SQL_QUOTES = f"""
WITH d AS (SELECT doc_id, text, string_split(text, ' ') AS w FROM documents),
     own AS (
       SELECT doc_id, text, 'own' AS variant,
              '“' || replace(lower(array_to_string(list_slice(w, 3, 14), ' ')), ' ', chr(10) || '  ') || '”' AS quote FROM d
       UNION ALL SELECT doc_id, text, 'elided', array_to_string(list_slice(w, 1, 4), ' ') || ' ... ' || array_to_string(list_slice(w, 9, 12), ' ') FROM d
       UNION ALL SELECT doc_id, text, 'triple', array_to_string(list_slice(w, 1, 3), ' ') || ' ... ' || array_to_string(list_slice(w, 6, 8), ' ')
         || ' ... ' || array_to_string(list_slice(w, 11, 13), ' ') FROM d
       UNION ALL SELECT doc_id, text, 'reversed', array_to_string(list_slice(w, 9, 12), ' ') || ' … ' || array_to_string(list_slice(w, 1, 4), ' ') FROM d
       UNION ALL SELECT doc_id, text, 'blank', '  ...  ' FROM d
       UNION ALL SELECT d.doc_id, d.text, 'bench', b.text FROM documents d
         JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)),
     s AS (SELECT doc_id, variant, {_sql_fold('text')} AS hay,
                  list_filter(list_transform(regexp_split_to_array(quote, '\\.{{3,}}|…'), lambda x: {_sql_fold('x')}), lambda x: length(x) > 0) AS segs
           FROM own)
SELECT doc_id, variant,
  CASE len(segs) WHEN 0 THEN false
    WHEN 1 THEN strpos(hay, segs[1]) > 0
    ELSE strpos(hay, segs[1]) > 0 AND strpos(r1, segs[2]) > 0
      AND (len(segs) < 3 OR strpos(substr(r1, strpos(r1, segs[2]) + length(segs[2])), segs[3]) > 0) END AS verified
FROM (SELECT *, substr(hay, strpos(hay, segs[1]) + length(segs[1])) AS r1 FROM s)"""


@query("quote_verify", sql=SQL_QUOTES)
def quote_verify(spark, sf_dir):
    """JDG-9: six quotes per document, tested as an array against the text folded once."""
    t = quote_table(spark, sf_dir)
    tested = let(fold(F.col("text")), lambda hay: F.transform("quotes", lambda x: F.struct(
        x["variant"].alias("variant"), J.quote_in(x["quote"], hay).alias("verified"))))
    return t.select("doc_id", F.inline(tested))
