"""Template checks on captured responses (CHK-1..16, CHK-20/21, SRC-1)."""
from __future__ import annotations

from pyspark.sql import functions as F

from proofline.operators.checks import PII_PATTERNS, Check
from proofline.operators.evaluate import (
    apply_checks,
    check_columns,
    checks_table,
    evaluate_checks,
    with_body,
    with_schema_results,
)
from proofline.plans.registry import query
from proofline.plans.sqltext import q
from proofline.sources import tables as T

# ---- the spec the text responses (documents) are checked against ------------------
LICENSE = "License"
SECRET = 'token = "'
LICENSE_RE = r"^(?P<kw>Licensed) under the"
TEXT_SPEC = [
    Check("contains", {"value": LICENSE}),
    Check("not_contains", {"value": SECRET}),
    Check("regex_match", {"pattern": LICENSE_RE}),
    Check("pii_absent"),
    Check("refusal_detector", {"expect_refusal": False}, required=False),
]
# The same patterns for the oracle, whose classes are ASCII.
SQL_EMAIL, SQL_IBAN, SQL_CARD = (PII_PATTERNS[k] for k in ("email", "iban", "card"))


def _one(spark, sf_dir, check):
    r = T.text_responses(spark, sf_dir)
    return apply_checks(r, [check], ["case_id"], body=None).select(
        "case_id", "passed", "message")


@query("chk_contains", sql=f"""
SELECT doc_id AS case_id, contains(coalesce(text, ''), {q(LICENSE)}) AS passed,
  'text ' || CASE WHEN contains(coalesce(text, ''), {q(LICENSE)}) THEN 'contains' ELSE 'missing' END
  || ': ' || {q(repr(LICENSE))} AS message
FROM documents""")
def chk_contains(spark, sf_dir):
    return _one(spark, sf_dir, TEXT_SPEC[0])


@query("chk_not_contains", sql=f"""
SELECT doc_id AS case_id, NOT contains(coalesce(text, ''), {q(SECRET)}) AS passed,
  'forbidden string ' || CASE WHEN contains(coalesce(text, ''), {q(SECRET)}) THEN 'present' ELSE 'absent' END
  || ': ' || {q(repr(SECRET))} AS message
FROM documents""")
def chk_not_contains(spark, sf_dir):
    return _one(spark, sf_dir, TEXT_SPEC[1])


@query("chk_regex", sql=f"""
SELECT doc_id AS case_id, regexp_matches(coalesce(text, ''), {q('(?sm)' + LICENSE_RE)}) AS passed,
  'pattern ' || CASE WHEN regexp_matches(coalesce(text, ''), {q('(?sm)' + LICENSE_RE)})
                THEN 'matched' ELSE 'no match' END || ': ' || {q(repr(LICENSE_RE))} AS message
FROM documents""")
def chk_regex(spark, sf_dir):
    return _one(spark, sf_dir, TEXT_SPEC[2])


@query("chk_pii_counts", sql=f"""
WITH h AS (
  SELECT doc_id,
    len(regexp_extract_all(coalesce(text, ''), {q(SQL_EMAIL)})) AS n_email,
    len(regexp_extract_all(coalesce(text, ''), {q(SQL_IBAN)})) AS n_iban,
    len(regexp_extract_all(coalesce(text, ''), {q(SQL_CARD)})) AS n_card
  FROM documents)
SELECT doc_id AS case_id, CAST(n_email AS BIGINT) AS n_email, CAST(n_iban AS BIGINT) AS n_iban,
  CAST(n_card AS BIGINT) AS n_card, (n_email + n_iban + n_card) = 0 AS passed,
  CASE WHEN n_email + n_iban + n_card = 0 THEN 'no PII detected'
       ELSE 'PII detected: [' || concat_ws(', ', CASE WHEN n_email > 0 THEN '''email''' END,
            CASE WHEN n_iban > 0 THEN '''iban''' END, CASE WHEN n_card > 0 THEN '''card''' END)
            || ']' END AS message
FROM h""")
def chk_pii_counts(spark, sf_dir):
    from proofline.operators.checks import pii_absent, pii_hits
    r = T.text_responses(spark, sf_dir)
    hits = pii_hits(F.coalesce(F.col("text"), F.lit("")))
    # every class is extracted once; counts and the check read the same arrays
    h = r.select("case_id", *[v.alias(f"h_{k}") for k, v in hits.items()])
    res = pii_absent({"text": None}, hits={k: F.col(f"h_{k}") for k in hits})
    return h.select("case_id", *[F.size(f"h_{k}").cast("long").alias(f"n_{k}") for k in hits],
                    res["passed"].alias("passed"), res["message"].alias("message"))


@query("chk_refusal", sql="""
SELECT conv_id AS case_id, turn,
  (contains(lower(coalesce(text, '')), 'i can''t') OR contains(lower(coalesce(text, '')), 'i cannot')
   OR contains(lower(coalesce(text, '')), 'i''m unable') OR contains(lower(coalesce(text, '')), 'cannot help')
   OR contains(lower(coalesce(text, '')), 'not able to') OR contains(lower(coalesce(text, '')), 'i won''t'))
   = false AS passed
FROM conversations WHERE role = 'assistant'""")
def chk_refusal(spark, sf_dir):
    conv = T.table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    return apply_checks(conv.withColumnRenamed("conv_id", "case_id"), [TEXT_SPEC[4]],
                        ["case_id", "turn"], body=None).select("case_id", "turn", "passed")


@query("chk_length_bound", sql="""
SELECT doc_id AS case_id, length(coalesce(text, '')) BETWEEN 100 AND 5000 AS passed FROM documents""")
def chk_length_bound(spark, sf_dir):
    r = T.text_responses(spark, sf_dir)
    return apply_checks(r, [Check("length_bound", {"min": 100, "max": 5000})], ["case_id"],
                        body=None).select("case_id", "passed")


# ---- JSON bodies (events.props) -----------------------------------------------------
def _json_one(spark, sf_dir, check, cols=("case_id", "passed", "message")):
    r = T.json_responses(spark, sf_dir)
    return apply_checks(r, [check], ["case_id"]).select(*cols)


# bodies: every seventh is followed by garbage, is null, is missing, is cut off; the rest as it is
SQL_BODIES = """(SELECT event_id, CASE event_id % 7 WHEN 0 THEN props || ' x' WHEN 1 THEN 'null'
  WHEN 2 THEN NULL WHEN 3 THEN substr(props, 1, length(props) - 1) ELSE props END AS body FROM events)"""


@query("chk_valid_json", sql=f"""
SELECT event_id AS case_id, coalesce(json_valid(body) AND trim(body) <> 'null', false) AS passed,
  CASE WHEN coalesce(json_valid(body) AND trim(body) <> 'null', false)
       THEN 'response body is valid JSON' ELSE 'response is not valid JSON' END AS message
FROM {SQL_BODIES}""")
def chk_valid_json(spark, sf_dir):
    e = T.table(spark, sf_dir, "events")
    k = F.col("event_id") % 7
    body = (F.when(k == 0, F.concat("props", F.lit(" x"))).when(k == 1, "null").when(k == 2, F.lit(None))
            .when(k == 3, F.expr("substr(props, 1, length(props) - 1)")).otherwise(F.col("props")))
    r = e.select(F.col("event_id").alias("case_id"), body.alias("body"))
    return apply_checks(r, [Check("valid_json")], ["case_id"]).select("case_id", "passed", "message")


@query("chk_numeric_bound", sql="""
SELECT event_id AS case_id,
  coalesce(CAST(json_extract(props, '$.k') AS DOUBLE) BETWEEN 10 AND 90, false) AS passed,
  CASE WHEN json_extract(props, '$.k') IS NULL THEN 'field not found: $.k'
       WHEN CAST(json_extract(props, '$.k') AS DOUBLE) BETWEEN 10 AND 90
       THEN '$.k=' || CAST(json_extract(props, '$.k') AS VARCHAR) || ' within [10,90]'
       ELSE '$.k=' || CAST(json_extract(props, '$.k') AS VARCHAR) || ' out of bounds' END AS message
FROM events""")
def chk_numeric_bound(spark, sf_dir):
    return _json_one(spark, sf_dir, Check("numeric_bound", {"field": "$.k", "min": 10, "max": 90}))


@query("chk_field_present", sql="""
SELECT event_id AS case_id, CAST(CASE WHEN json_extract(props, '$.k') IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n,
  json_extract(props, '$.k') IS NOT NULL AS passed,
  CAST(CASE WHEN json_extract(props, '$.k') IS NULL THEN 0 ELSE 1 END AS VARCHAR) || ' match(es) for $.k' AS message
FROM events""")
def chk_field_present(spark, sf_dir):
    df = _json_one(spark, sf_dir, Check("field_present", {"field": "$.k"}))
    return df.select("case_id", F.regexp_extract("message", r"^(\d+)", 1).cast("long").alias("n"),
                     "passed", "message")


@query("chk_latency", sql="""
SELECT event_id AS case_id, value <= 25 AS passed,
  'latency ' || CAST(CAST(round_even(value, 0) AS BIGINT) AS VARCHAR) || 'ms '
  || CASE WHEN value <= 25 THEN '<=' ELSE '>' END || ' 25ms' AS message
FROM events""")
def chk_latency(spark, sf_dir):
    return _json_one(spark, sf_dir, Check("latency_bound", {"max_ms": 25}))


# ---- nested finding bodies (one per lineitem row) ----------------------------------
FINDING_SCHEMA = {
    "type": "object",
    "required": ["findings"],
    "properties": {"findings": {"type": "array", "minItems": 1, "maxItems": 2, "items": {
        "type": "object",
        "required": ["severity", "article"],
        "properties": {
            "severity": {"type": "string", "pattern": "^[a-z]+$", "not": {"const": "urgent"}},
            "article": {"type": "string", "minLength": 1},
        },
    }}},
}


def _findings(spark, sf_dir, checks):
    r = T.finding_responses(spark, sf_dir)
    return apply_checks(r, checks, ["l_orderkey", "l_linenumber"], text=None, latency=None)


@query("chk_citation", sql=f"""
SELECT l_orderkey, l_linenumber,
  CAST((CASE WHEN a1 <> '' THEN 1 ELSE 0 END) + (CASE WHEN a2 IS NOT NULL AND a2 <> '' THEN 1 ELSE 0 END) AS BIGINT) AS n_citations,
  (CASE WHEN a1 <> '' THEN 1 ELSE 0 END) + (CASE WHEN a2 IS NOT NULL AND a2 <> '' THEN 1 ELSE 0 END) >= 1 AS passed
FROM {T.SQL_FINDINGS}""")
def chk_citation(spark, sf_dir):
    df = _findings(spark, sf_dir, [Check("citation_present",
                                         {"field": "$.findings[*].article", "min": 1})])
    return df.select("l_orderkey", "l_linenumber",
                     F.regexp_extract("message", r"^(\d+)", 1).cast("long").alias("n_citations"),
                     "passed")


@query("chk_json_schema", sql=f"""
SELECT l_orderkey, l_linenumber, (v2 <> 'urgent' AND a1 <> '' AND a2 IS NOT NULL) AS passed
FROM {T.SQL_FINDINGS}""")
def chk_json_schema(spark, sf_dir):
    """CHK-2: the flag alone, so nothing is explained."""
    check = [Check("json_schema", {"schema": FINDING_SCHEMA})]
    df = with_schema_results(with_body(T.finding_responses(spark, sf_dir)), check)
    result, = check_columns(check, text=None, latency=None, cost=None, columns=df.columns)
    return df.select("l_orderkey", "l_linenumber", result["passed"].alias("passed"))


@query("chk_schema_violation", sql=f"""
SELECT l_orderkey, l_linenumber,
  CASE WHEN a1 = '' THEN ''''' is too short' WHEN v2 = 'urgent' THEN '''urgent'' is not valid under ''not'''
       WHEN a2 IS NULL THEN 'None is not of type ''string''' ELSE 'matches schema' END AS message,
  CASE WHEN a1 = '' THEN '{{"path":["findings",0,"article"]}}' WHEN v2 = 'urgent' THEN '{{"path":["findings",1,"severity"]}}'
       WHEN a2 IS NULL THEN '{{"path":["findings",1,"article"]}}' END AS evidence
FROM {T.SQL_FINDINGS}""")
def chk_schema_violation(spark, sf_dir):
    """CHK-2 with the first violation's message and place."""
    df = _findings(spark, sf_dir, [Check("json_schema", {"schema": FINDING_SCHEMA})])
    return df.select("l_orderkey", "l_linenumber", "message", "evidence")


@query("chk_citation_resolves", sql=f"""
WITH cited AS (SELECT l_orderkey, a1 AS citation FROM {T.SQL_FINDINGS} WHERE a1 <> ''
               UNION SELECT l_orderkey, a2 FROM {T.SQL_FINDINGS} WHERE a2 <> '')
SELECT l_orderkey, citation FROM cited
WHERE citation NOT IN (SELECT 'Art. ' || CAST(p_partkey * 3 AS VARCHAR) FROM part)""")
def chk_citation_resolves(spark, sf_dir):
    """CHK-14: cited articles that the corpus (three times the number of every part) does not hold."""
    from proofline.functions import jsonpath as jp
    from proofline.operators.checks import unresolved_citations
    r = with_body(T.finding_responses(spark, sf_dir))
    corpus = T.table(spark, sf_dir, "part").select(
        F.concat(F.lit("Art. "), (F.col("p_partkey") * 3).cast("string")).alias("ref"))
    return unresolved_citations(r, jp.matches(F.col("json"), "$.findings[*].article"), ["l_orderkey"], corpus)


@query("chk_enum_equals", sql=f"""
SELECT l_orderkey, l_linenumber, v2 <> 'urgent' AS enum_ok, s1 = 'blocked' AS equals_ok
FROM {T.SQL_FINDINGS}""")
def chk_enum_equals(spark, sf_dir):
    r = with_body(T.finding_responses(spark, sf_dir))
    enum_ok, equals_ok = check_columns([
        Check("enum_value", {"field": "$.findings[*].severity",
                             "values": ["low", "medium", "high", "critical"]}),
        Check("equals", {"field": "$.findings[0].status", "value": "blocked"})],
        text=None, latency=None)
    return r.select("l_orderkey", "l_linenumber", enum_ok["passed"].alias("enum_ok"),
                    equals_ok["passed"].alias("equals_ok"))


@query("chk_cost_bound", sql=f"""
SELECT run_id, CAST(count_if(cost_usd <= 0.05) AS BIGINT) AS passed, CAST(count(*) AS BIGINT) AS cases
FROM {T.SQL_CASE_RESULTS} GROUP BY run_id""")
def chk_cost_bound(spark, sf_dir):
    cr = T.case_results(spark, sf_dir)
    res = apply_checks(cr, [Check("cost_bound", {"max_usd": 0.05})], ["run_id"], text=None,
                       body=None, latency=None)
    return res.groupBy("run_id").agg(F.count_if("passed").alias("passed"),
                                     F.count(F.lit(1)).alias("cases"))


# ---- checks as a table, joined per suite (CHK-20 dispatch + CHK-21 threshold) ------
K_SCHEMA = {"type": "object", "properties": {"k": {"type": "integer", "minimum": 30}}}


def k_share(response: dict, context: dict) -> dict:
    """User check of the dispatch query: k in percent as a score, never passed by itself."""
    return {"passed": False, "score": response["json"]["k"] / 100, "message": "k as a share"}


DISPATCH_ROWS = [
    {"suite_id": "click", "check_index": 0, "uses": "latency_bound", "params": {"max_ms": 20}},
    {"suite_id": "click", "check_index": 1, "uses": "equals", "params": {"field": "$.k", "value": 42}},
    {"suite_id": "click", "check_index": 2, "uses": "regex_match", "params": {"pattern": "[13579]}$"}},
    {"suite_id": "view", "check_index": 0, "uses": "numeric_bound",
     "params": {"field": "$.k", "min": 20, "max": 80}},
    {"suite_id": "view", "check_index": 1, "uses": "enum_value", "params": {"field": "k", "values": [1, 2, 3, 50]}},
    {"suite_id": "purchase", "check_index": 0, "uses": "field_present",
     "params": {"field": "$.k", "min": 1}},
    {"suite_id": "purchase", "check_index": 1, "uses": "numeric_bound",
     "params": {"field": "$.k", "max": 50}, "required": False},
    {"suite_id": "purchase", "check_index": 2, "uses": "json_schema", "params": {"schema_ref": "k"}},
    {"suite_id": "signup", "check_index": 0, "uses": "contains", "params": {"value": "7"}},
    {"suite_id": "signup", "check_index": 1, "uses": "length_bound", "params": {"max": 8}},
    {"suite_id": "signup", "check_index": 2, "uses": "k_share", "type": "generated", "params": {"threshold": 0.5}},
    {"suite_id": "error", "check_index": 0, "uses": "no_such_template"},
    {"suite_id": "error", "check_index": 1, "type": "mystery", "uses": None},
    {"suite_id": "error", "check_index": 2, "type": "judge", "judge": "j", "uses": None},
    {"suite_id": "error", "check_index": 3, "uses": "numeric_bound", "params": {"field": "$.k k"}},
    {"suite_id": "error", "check_index": 4, "uses": "contains"},
    {"suite_id": "view", "check_index": 2, "uses": "numeric_bound", "params": {"field": "$..k", "max": 60}},
    {"suite_id": "view", "check_index": 3, "uses": "field_present", "params": {"field": "$[?(@ >= 25)]"}},
]
_K = "CAST(json_extract(props, '$.k') AS DOUBLE)"


@query("check_dispatch", sql=f"""
WITH r AS (SELECT * FROM (VALUES
  ('click', 0, 'template:latency_bound'), ('click', 1, 'template:equals'), ('click', 2, 'template:regex_match'),
  ('view', 0, 'template:numeric_bound'), ('view', 1, 'template:enum_value'),
  ('view', 2, 'template:numeric_bound'), ('view', 3, 'template:field_present'),
  ('purchase', 0, 'template:field_present'), ('purchase', 1, 'template:numeric_bound'), ('purchase', 2, 'template:json_schema'),
  ('signup', 0, 'template:contains'), ('signup', 1, 'template:length_bound'), ('signup', 2, 'generated:k_share'),
  ('error', 0, 'no_such_template'), ('error', 1, 'mystery'), ('error', 2, 'judge'),
  ('error', 3, 'template:numeric_bound'), ('error', 4, 'template:contains')) t(event_type, check_index, check_id))
SELECT event_id AS case_id, check_index, check_id,
  CASE event_type || check_index
    WHEN 'click0' THEN value <= 20 WHEN 'click1' THEN {_K} = 42 WHEN 'click2' THEN {_K} % 2 = 1
    WHEN 'view0' THEN {_K} BETWEEN 20 AND 80 WHEN 'view1' THEN {_K} IN (1, 2, 3, 50)
    WHEN 'view2' THEN {_K} <= 60 WHEN 'view3' THEN {_K} >= 25
    WHEN 'purchase0' THEN true WHEN 'purchase1' THEN {_K} <= 50 WHEN 'purchase2' THEN {_K} >= 30
    WHEN 'signup0' THEN contains(props, '7') WHEN 'signup1' THEN length(props) <= 8 WHEN 'signup2' THEN {_K} >= 50
    ELSE false END AS passed,
  CASE event_type || check_index WHEN 'error0' THEN 'unknown template: no_such_template'
    WHEN 'error1' THEN 'unknown check type: mystery' WHEN 'error2' THEN 'unknown judge: j'
    WHEN 'error3' THEN 'path not supported in a checks table: $.k k' WHEN 'error4' THEN 'missing parameter: value'
    WHEN 'signup2' THEN 'k as a share' END AS note
FROM events JOIN r USING (event_type)""")
def check_dispatch(spark, sf_dir):
    r = T.json_responses(spark, sf_dir).withColumn("text", F.col("body"))
    res = evaluate_checks(r, checks_table(spark, DISPATCH_ROWS), ["suite_id"],
                          schemas={"k": K_SCHEMA}, user_checks={"k_share": k_share})
    own = (F.col("suite_id") == "error") | (F.col("type") == "generated")
    return res.select("case_id", F.col("check_index").cast("int").alias("check_index"), "check_id", "passed",
                      F.when(own, F.col("message")).alias("note"))


@query("graded_threshold", sql="""
WITH s AS (SELECT event_id, value / 40.0 AS score,
  CASE event_type WHEN 'click' THEN 0.5 WHEN 'view' THEN 0.25 WHEN 'error' THEN 0.0 END AS with_thr,
  CASE WHEN user_id % 2 = 0 THEN 0.75 END AS spec_thr, event_id % 3 = 0 AS raw_passed FROM events)
SELECT event_id AS case_id,
  CASE WHEN score IS NOT NULL AND coalesce(nullif(with_thr, 0.0), spec_thr) IS NOT NULL
       THEN score >= coalesce(nullif(with_thr, 0.0), spec_thr) ELSE raw_passed END AS passed,
  coalesce(nullif(with_thr, 0.0), spec_thr) AS threshold
FROM s""")
def graded_threshold(spark, sf_dir):
    """CHK-21 on scored results: ``with.threshold or spec.threshold`` then
    ``score >= threshold`` replaces the raw flag in both directions."""
    from proofline.operators.evaluate import effective_threshold, graded
    e = T.table(spark, sf_dir, "events")
    with_thr = (F.when(F.col("event_type") == "click", 0.5)
                .when(F.col("event_type") == "view", 0.25)
                .when(F.col("event_type") == "error", 0.0))
    spec_thr = F.when(F.col("user_id") % 2 == 0, F.lit(0.75))
    thr = effective_threshold(with_thr, spec_thr)
    score = F.col("value") / 40.0
    return e.select(F.col("event_id").alias("case_id"),
                    graded(F.col("event_id") % 3 == 0, score, thr).alias("passed"),
                    thr.alias("threshold"))


# ---- a recursive schema (CHK-2) -------------------------------------------------------------
# Per order a tree: a chain of o_orderkey % 6 + 1 nodes with v = o_custkey % 50, each with a second
# child that has no children; the last one's v is a text for every ninth customer, and every
# eleventh order has a member that no node may have.
TREE_SCHEMA = {"$ref": "#/$defs/tree", "$defs": {"tree": {
    "type": "object", "required": ["v"], "additionalProperties": False, "properties": {
        "v": {"type": "integer", "maximum": 40}, "kids": {"type": "array", "items": {"$ref": "#/$defs/tree"}}}}}}


@query("chk_schema_recursive", sql="""
SELECT o_orderkey AS case_id, o_custkey % 50 <= 40 AND o_custkey % 9 <> 0 AND o_orderkey % 11 <> 0 AS passed FROM orders""")
def chk_schema_recursive(spark, sf_dir):
    """CHK-2 with a schema that refers to itself."""
    o = T.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    v = (F.col("o_custkey") % 50).cast("string")
    depth = (F.col("o_orderkey") % 6).cast("int")
    leaf = F.when(F.col("o_custkey") % 9 == 0, '"x"').otherwise(v)
    more = F.when(F.col("o_orderkey") % 11 == 0, ',"w":0').otherwise("")
    body = F.concat(F.repeat(F.lit('{"kids":[{"v":1},'), depth), F.lit('{"v":'), leaf, more, F.lit("}"),
                    F.array_join(F.array_repeat(F.concat(F.lit('],"v":'), v, F.lit("}")), depth), ""))
    r = o.select(F.col("o_orderkey").alias("case_id"), body.alias("body"))
    out = apply_checks(r, [Check("json_schema", {"schema": TREE_SCHEMA})], ["case_id"], text=None, latency=None, cost=None)
    return out.select("case_id", "passed")
