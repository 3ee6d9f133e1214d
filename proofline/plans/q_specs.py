"""Stored configs: reference resolution, dataset binding, case validation, assembly, edits, imports,
rubrics, previews and response paths."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from proofline.functions import jsonpath as jp
from proofline.functions.text import STOPWORDS
from proofline.operators import rubrics as RB
from proofline.operators import specs as SP
from proofline.operators import testsets as TS
from proofline.plans.q_testsets import _rules_sql, keyword_rules
from proofline.plans.registry import query
from proofline.plans.sqltext import SQL_SPLIT, q
from proofline.session import checkpoint_dir
from proofline.sources import tables as T

# ---- TXT-3: references as a model might write them, five per document by the first digits of its
# number: exact, lower case and spaced, with words around the number, only words, nothing known
REFS = ["R1", " r 2 ", "Req 3 - see there", "the words", "R99"]


@query("ref_resolution", sql=f"""
WITH reqs AS ({SQL_SPLIT}),
 x AS (SELECT d.doc_id, i, CASE i WHEN 0 THEN 'R1' WHEN 1 THEN ' r 2 ' WHEN 2 THEN 'Req 3 - see there' WHEN 3 THEN 'the words' ELSE 'R99' END AS ref,
         array_to_string(list_slice(string_split(d.text, ' '), 5, 9), ' ') AS assertion FROM documents d, range(5) t(i)),
 tok AS (SELECT doc_id, req_id, position, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'),
           lambda w: length(w) > 2 AND w NOT IN ({", ".join(q(w) for w in STOPWORDS)}))) AS words FROM reqs),
 want AS (SELECT *, list_distinct(list_filter(regexp_extract_all(lower(trim(ref) || ' ' || assertion), '[a-z0-9]+'),
           lambda w: length(w) > 2 AND w NOT IN ({", ".join(q(w) for w in STOPWORDS)}))) AS wanted FROM x),
 best AS (SELECT doc_id, i, arg_max(req_id, (n, -position)) FILTER (n > 0) AS by_words, count(*) AS n_reqs, min(req_id) AS only_one,
            bool_or(req_id = 'R1') AS r1, bool_or(req_id = 'R2') AS r2, bool_or(req_id = 'R3') AS r3, bool_or(req_id = 'R99') AS r99
          FROM (SELECT w.doc_id, w.i, t.req_id, t.position, len(list_intersect(w.wanted, t.words)) AS n FROM want w JOIN tok t USING (doc_id)) GROUP BY 1, 2)
SELECT doc_id, i, coalesce(CASE i WHEN 0 THEN CASE WHEN r1 THEN 'R1' END WHEN 1 THEN CASE WHEN r2 THEN 'R2' END WHEN 2 THEN CASE WHEN r3 THEN 'R3' END
   WHEN 4 THEN CASE WHEN r99 THEN 'R99' END END, by_words, CASE WHEN n_reqs = 1 THEN only_one END) AS resolved_ref
FROM x LEFT JOIN best USING (doc_id, i)""")
def ref_resolution(spark, sf_dir):
    """TXT-3 / WIN-10: every document's own requirements, five written references each."""
    d = T.table(spark, sf_dir, "documents").select("doc_id", "text")
    words = F.array_join(F.slice(F.split("text", " "), 5, 5), " ")
    x = d.select("doc_id", words.alias("assertion"), F.posexplode(F.array(*[F.lit(r) for r in REFS])).alias("i", "requirement_ref"))
    out = SP.resolve_refs(x, TS.split_requirements(d))
    return out.select("doc_id", F.col("i").cast("long").alias("i"), "resolved_ref")


# ---- SRC-3 / TXT-6: events as a dataset, one JSON object per line; lines by event_id % 10: 0 broken,
# 1 a list, 2 blank, 3 without fields, 4 with an input object, the rest bare
def _dataset_line():
    e, k = F.col("event_id"), F.col("event_id") % 10
    ident = F.concat(F.col("event_type"), F.lit("/"), (e % 25).cast("string"))
    bare = F.to_json(F.struct(ident.alias("id"), F.col("user_id").alias("user"), F.col("event_type").alias("kind")))
    return (F.when(k == 0, F.concat(F.lit("{broken "), e.cast("string"))).when(k == 1, F.lit("[1, 2]")).when(k == 2, F.lit("  "))
            .when(k == 3, F.to_json(F.struct(ident.alias("id"), F.lit("x").alias("kind"))))
            .when(k == 4, F.concat(F.lit('{"id": "../'), e.cast("string"), F.lit('", "input": {"q": "'), F.col("event_type"),
                                   F.lit('"}, "context": {"n": 1}}')))
            .otherwise(bare))


@query("jsonl_quarantine", sql="""
SELECT line, CASE event_id % 10 WHEN 0 THEN 'not valid JSON' WHEN 1 THEN 'expected a JSON object, got array' END AS reason
FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS line FROM events) WHERE event_id % 10 <> 2""")
def jsonl_quarantine(spark, sf_dir):
    """SRC-3: the events written as JSON lines and read back, blank lines counted, bad ones named."""
    path = f"{checkpoint_dir(spark)}/dataset-{uuid.uuid4().hex}"
    e = T.table(spark, sf_dir, "events")
    e.orderBy("event_id").select(_dataset_line().alias("value")).write.text(path)
    out = SP.parsed_rows(SP.jsonl_rows(spark, path, through=True))
    return out.select("line", F.regexp_replace("reason", r"^[^:]*:\d+: ", "").alias("reason"))


def dataset(spark, sf_dir):
    """Rows of one dataset per user, numbered by event: all lines, those that parse."""
    lines = T.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("dataset"), F.col("event_id").alias("i"), _dataset_line().alias("value"),
        F.col("user_id").cast("string").alias("file"), F.col("event_id").alias("line"))
    return SP.parsed_rows(lines).where("reason is null").select("dataset", "i", "value")


_SQL_ROWS = """(SELECT user_id AS dataset, event_id AS i, event_id % 10 AS k, event_type, user_id,
  CASE WHEN event_id % 10 = 4 THEN event_id::VARCHAR ELSE event_type || '-' || event_id % 25 END AS sid FROM events WHERE event_id % 10 > 2)"""


@query("dataset_cases", sql=f"""
WITH s AS (SELECT *, min(i) OVER (PARTITION BY dataset, sid) AS first FROM {_SQL_ROWS})
SELECT dataset, i, CASE WHEN i = first THEN sid ELSE sid || '-' || i END AS case_id,
  CASE k WHEN 3 THEN 'x' WHEN 4 THEN 'dataset' ELSE event_type END AS kind,
  CASE k WHEN 3 THEN NULL WHEN 4 THEN '{{"q":"' || event_type || '"}}' ELSE '{{"user":' || user_id || '}}' END AS input,
  CASE WHEN k = 4 THEN '{{"n":1}}' END AS context, CASE WHEN k = 3 THEN 'dataset row ' || i || ' has no input fields' END AS reason
FROM s""")
def dataset_cases(spark, sf_dir):
    """TXT-6 / WIN-8: ids are safe and unique within each dataset."""
    return SP.dataset_cases(dataset(spark, sf_dir), "dataset", "i")


@query("case_validation", sql="""
WITH x AS (SELECT user_id AS g, event_id AS i, event_id % 6 AS k, CASE event_id % 6 WHEN 1 THEN '../x' ELSE event_type || event_id % 20 END AS id, event_type FROM events),
 f AS (SELECT *, min(i) FILTER (k <> 0) OVER (PARTITION BY g, id) AS first FROM x)
SELECT g, i, CASE WHEN k = 0 THEN 'not an object' WHEN k = 1 THEN 'unusable id' WHEN first < i THEN 'id used more than once'
   WHEN k = 2 THEN 'no input object' WHEN k = 3 THEN 'no known request field' END AS reason,
  CASE WHEN k = 0 THEN 'nominal' WHEN event_type = 'error' THEN 'hostile' ELSE 'nominal' END AS kind FROM f""")
def case_validation(spark, sf_dir):
    """TXT-7: events as written cases; by event_id % 6 a list, a bad id, no input, a foreign field, good."""
    e = T.table(spark, sf_dir, "events")
    k = F.col("event_id") % 6
    ident = F.when(k == 1, "../x").otherwise(F.concat("event_type", (F.col("event_id") % 20).cast("string")))
    kind = F.when(F.col("event_type") == "error", " Hostile ").otherwise(F.col("event_type"))
    data = F.when(k == 2, F.lit("{}")).when(k == 3, F.lit('{"other": 1}')).otherwise(F.lit('{"prompt": "p"}'))
    case = F.when(k == 0, F.lit("[]")).otherwise(F.concat(
        F.lit('{"id": "'), ident, F.lit('", "kind": "'), kind, F.lit('", "input": '), data, F.lit("}")))
    rows = e.select(F.col("user_id").alias("g"), F.col("event_id").alias("i"), case.alias("case"))
    return SP.validate_cases(rows, "g", "i", known_fields=["prompt", "text"]).select("g", "i", "reason", "kind")


# ---- TXT-8, SRC-5, TXT-11, TXT-12: the specs of every document's keyword intents ------------------
def _intents(spark, sf_dir):
    order = F.concat_ws("/", "requirement_ref", "intent_id")
    return keyword_rules(spark, sf_dir).withColumn("intent_order", order)


def _given_cases(intents):
    """Two cases for every template intent of every third document, the second with an empty input."""
    two = F.array(*[F.struct(F.lit(i).alias("case_order"), F.lit(c).alias("case_id"), F.lit(x).alias("input"),
                             F.lit(None).cast("string").alias("context"))
                    for i, (c, x) in enumerate([("a b", '{"prompt":"hi"}'), ("c", "{}")])])
    return intents.where("how = 'template' and doc_id % 3 = 0").select("doc_id", "intent_id", F.inline(two))


def spec_rows(spark, sf_dir):
    checkpoint_dir(spark)
    # kept: the texts are searched once, for the intents and for the cases given to them
    intents = _intents(spark, sf_dir).checkpoint()
    return SP.spec_rows(intents, _given_cases(intents))


_SQL_SPEC = f"""(SELECT doc_id, requirement_ref AS suite_id, intent_id || CASE WHEN how = 'template' AND doc_id % 3 = 0 THEN '-a-b' ELSE '-nominal' END AS case_id,
  CAST(row_number() OVER (PARTITION BY doc_id ORDER BY requirement_ref || '/' || intent_id) - 1 AS INT) AS place,
  CASE WHEN how = 'template' AND doc_id % 3 = 0 THEN '{{"prompt":"hi"}}' ELSE '{{"prompt":"A representative request that should be handled normally. Under test: ' || assertion || '"}}' END AS input,
  how AS type, CASE how WHEN 'template' THEN template END AS uses, CASE how WHEN 'judge' THEN 'generated/rubrics/' || intent_id || '.yaml' END AS rubric,
  CASE how WHEN 'template' THEN params ELSE '{{"threshold":' || threshold || '}}' END AS params
  FROM ({_rules_sql()}) t(doc_id, intent_id, requirement_ref, category, assertion, how, template, params, threshold))"""


@query("spec_assembly", sql=f"SELECT doc_id, suite_id, case_id, place, input, type, uses, rubric, params FROM {_SQL_SPEC}")
def spec_assembly(spark, sf_dir):
    """TXT-8: one case per row, the deterministic one where none with an input is given."""
    return spec_rows(spark, sf_dir).select("doc_id", "suite_id", "case_id", "place", "input", "type", "uses", "rubric",
                                           F.col("with").alias("params"))


def _artifacts(spark, sf_dir, rows):
    """A rubric file for every rubric that a spec of an even document names."""
    return rows.where("rubric is not null and doc_id % 2 = 0").select(
        "doc_id", F.col("rubric").alias("path"), F.concat(F.lit("body of "), "rubric").alias("body"))


@query("config_checks", sql=f"""
SELECT doc_id, suite_id, case_id, 0 AS check_index, type, CASE WHEN type = 'judge' THEN 'stochastic' ELSE 'deterministic' END AS determinism,
  rubric AS key, params, CASE WHEN doc_id % 2 = 0 THEN 'body of ' || rubric END AS artifact FROM {_SQL_SPEC}""")
def config_checks(spark, sf_dir):
    """SRC-5 / CHK-24: the assembled configs flattened again, with the rubrics they name."""
    rows = spec_rows(spark, sf_dir)
    out = SP.config_checks(SP.assemble(rows), "doc_id", _artifacts(spark, sf_dir, rows))
    return out.select("doc_id", "suite_id", "case_id", "check_index", "type", "determinism", "key", "params", "artifact")


# edits: the first check of every document gets new params; every fourth document is no draft, every
# fifth edit names a check index that does not exist
@query("config_edit", sql=f"""
WITH c AS (SELECT * FROM {_SQL_SPEC} WHERE place = 0)
SELECT doc_id AS edit_id, CASE WHEN doc_id % 4 = 0 THEN 'only drafts can be edited, status: active'
  WHEN doc_id % 5 = 0 THEN 'check_index out of range' END AS reason,
  sha256(CASE WHEN doc_id % 4 = 0 OR doc_id % 5 = 0 THEN params ELSE '{{"edited":' || doc_id || '}}' END) AS params_hash FROM c""")
def config_edit(spark, sf_dir):
    """TXT-11 / SCL-3: edits judged, applied to the flattened checks, the result hashed."""
    # kept: read five times
    checks = SP.config_checks(SP.assemble(spec_rows(spark, sf_dir)), "doc_id").checkpoint()
    edits, versions = _edits(checks)
    after, judged = SP.edit_checks(checks, versions, edits, "doc_id")
    new = after.where("suite_pos = 0 and case_pos = 0").select("doc_id", F.sha2("params", 256).alias("params_hash"))
    return judged.select("edit_id", "doc_id", "reason").join(new, "doc_id").select("edit_id", "reason", "params_hash")


def _edits(checks):
    first = checks.where("suite_pos = 0 and case_pos = 0")
    d = F.col("doc_id")
    edits = first.select(d.alias("edit_id"), "doc_id", "suite_id", "case_id", F.when(d % 5 == 0, 7).otherwise(0).alias("check_index"),
                         F.concat(F.lit('{"edited":'), d.cast("string"), F.lit("}")).alias("params"))
    versions = checks.select("doc_id").distinct().withColumn("status", F.when(d % 4 == 0, "active").otherwise("draft"))
    return edits, versions


# Hash trees: check -> case -> suite -> version, a node's hash over its own id and its children's.
_SQL_TREE = """(WITH n AS (SELECT doc_id, suite_id, place, case_id, sha256(case_id || chr(10) || sha256(concat_ws(chr(31), '0', type,
    coalesce(uses, ''), coalesce(rubric, ''), {params}))) AS h FROM {spec}),
  s AS (SELECT doc_id, min(place) AS pos, count(*) AS c, sha256(suite_id || chr(10) || string_agg(h, chr(10) ORDER BY place)) AS h FROM n GROUP BY doc_id, suite_id)
  SELECT doc_id, sha256(string_agg(h, chr(10) ORDER BY pos)) AS h, CAST(sum(c) AS BIGINT) AS c FROM s GROUP BY doc_id)"""
_SQL_EDITED = "CASE WHEN place = 0 AND doc_id % 4 <> 0 AND doc_id % 5 <> 0 THEN '{\"edited\":' || doc_id || '}' ELSE params END"


@query("spec_hashes", sql=f"""
SELECT a.doc_id, a.h AS content_hash, b.h AS edited_hash, a.c AS n_checks
FROM {_SQL_TREE.format(params='params', spec=_SQL_SPEC)} a JOIN {_SQL_TREE.format(params=_SQL_EDITED, spec=_SQL_SPEC)} b USING (doc_id)""")
def spec_hashes(spark, sf_dir):
    """SCL-3 / TXT-11: the content hash of every version, and after the edits of ``config_edit``, for
    which only the nodes on the way from an edited check to its version are hashed again."""
    checkpoint_dir(spark)
    checks = SP.config_checks(SP.assemble(spec_rows(spark, sf_dir)), "doc_id").checkpoint()
    edits, versions = _edits(checks)
    after, judged = SP.edit_checks(checks, versions, edits, "doc_id")
    tree = SP.hash_tree(checks, "doc_id").checkpoint()
    places = judged.where("reason is null").select("doc_id", "suite_id", "case_id", "check_index").distinct()
    new = SP.rehash(tree, after, places, "doc_id")
    one = tree.where("level = 'version'").select("doc_id", F.col("hash").alias("content_hash"), F.col("n").alias("n_checks"))
    two = new.where("level = 'version'").select("doc_id", F.col("hash").alias("edited_hash"))
    return one.join(two, "doc_id").select("doc_id", "content_hash", "edited_hash", "n_checks")


@query("shared_cases", sql=f"""
SELECT h AS hash, count(DISTINCT doc_id) AS versions FROM (
  SELECT doc_id, sha256(case_id || chr(10) || sha256(concat_ws(chr(31), '0', type, coalesce(uses, ''), coalesce(rubric, ''), params))) AS h FROM {_SQL_SPEC})
GROUP BY 1 HAVING count(DISTINCT doc_id) > 1""")
def shared_cases(spark, sf_dir):
    """SCL-3: cases that several versions hold with equal content, by their hash."""
    checks = SP.config_checks(SP.assemble(spec_rows(spark, sf_dir)), "doc_id")
    return SP.shared_nodes(SP.hash_tree(checks, "doc_id"), "doc_id", "case")


@query("version_import", sql=f"""
WITH r AS (SELECT doc_id, count(DISTINCT rubric) FILTER (doc_id % 2 = 0) AS n_rubrics FROM {_SQL_SPEC} GROUP BY 1),
 top AS (SELECT l_orderkey % 30 AS pipeline, max(l_linenumber) AS top FROM lineitem GROUP BY 1)
SELECT doc_id, doc_id % 30 AS pipeline, coalesce(top, 0) + row_number() OVER (PARTITION BY doc_id % 30 ORDER BY doc_id) AS version_number,
  'draft' AS status, CAST(0 AS BIGINT) AS n_sources, n_rubrics FROM r LEFT JOIN top ON top.pipeline = doc_id % 30""")
def version_import(spark, sf_dir):
    """TXT-12: the specs as drafts of thirty pipelines that already have versions."""
    rows = spec_rows(spark, sf_dir)
    specs = SP.assemble(rows).withColumn("pipeline", F.col("doc_id") % 30)
    existing = T.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 30).alias("pipeline"),
                                                         F.col("l_linenumber").alias("version_number"))
    out = SP.import_versions(specs, _artifacts(spark, sf_dir, rows), existing)
    return out.select("doc_id", "pipeline", "version_number", "status", "n_sources", "n_rubrics")


@query("build_preview", sql=f"""
SELECT doc_id, count(*) AS checks, greatest(2, count(*)) AS estimated_minutes
FROM ({_rules_sql()}) t(doc_id, intent_id, requirement_ref, category, assertion, how, template, params, threshold) GROUP BY 1""")
def build_preview(spark, sf_dir):
    """AGG-17."""
    return SP.build_preview(keyword_rules(spark, sf_dir))


# ---- TXT-9 / TXT-10: rubrics ----------------------------------------------------------------------
_GOOD = "names the article it cites in full"


@query("rubric_lint", sql="""
SELECT event_id, CASE event_id % 8 WHEN 0 THEN 0 WHEN 1 THEN 0 ELSE 2 END AS dimensions, event_id % 8 = 7 AS usable,
  CASE event_id % 8 WHEN 0 THEN 'not an object' WHEN 1 THEN 'needs at least 2 dimensions' WHEN 2 THEN 'id is not a slug'
   WHEN 3 THEN 'duplicate id' WHEN 4 THEN 'no usable question' WHEN 5 THEN 'level is not an observable anchor'
   WHEN 6 THEN 'min_score outside the scale' END AS reason FROM events""")
def rubric_lint(spark, sf_dir):
    """TXT-9: a written rubric per event; by event_id % 8 each breaks one rule, the last none."""
    k = F.col("event_id") % 8

    def dim(ident, question, level, low):
        return F.concat(F.lit('{"id": "'), ident, F.lit('", "question": "'), question, F.lit('", "scale": {"0": "'), level,
                        F.lit(f'", "1": "{_GOOD}", "2": "{_GOOD}"}}, "min_score": '), low, F.lit("}"))
    good = dim(F.lit("cites"), F.lit("Does it cite its sources?"), F.lit(_GOOD), F.lit("1"))
    second = dim(F.when(k == 2, "../x").when(k == 3, "cites").otherwise(F.concat(F.lit("d"), F.col("event_id").cast("string"))),
                 F.when(k == 4, "why?").otherwise("Is every claim grounded?"),
                 F.when(k == 5, "mostly good answer").otherwise(_GOOD), F.when(k == 6, "3").otherwise('"2"'))
    body = F.when(k == 0, F.lit("[]")).when(k == 1, F.concat(F.lit('{"dimensions": ['), good, F.lit("]}"))).otherwise(
        F.concat(F.lit('{"dimensions": ['), good, F.lit(", "), second, F.lit("]}")))
    r = T.table(spark, sf_dir, "events").select("event_id", body.alias("rubric"))
    return RB.lint(r, "event_id").select("event_id", F.col("dimensions").cast("int").alias("dimensions"), "usable", "reason")


@query("fallback_rubrics", sql=f"""
SELECT doc_id, intent_id, pos, CASE pos WHEN 0 THEN 'requirement_met' ELSE 'grounded_in_input' END AS dim,
  CASE pos WHEN 0 THEN 'Does the response satisfy: ' || assertion || '?' ELSE {q(RB.FALLBACK_DIMENSIONS[1][1])} END AS question,
  CASE pos WHEN 0 THEN 2 ELSE 1 END AS min_score, 3 AS levels
FROM ({_rules_sql()}) t(doc_id, intent_id, requirement_ref, category, assertion, how, template, params, threshold), range(2) r(pos) WHERE how = 'judge'""")
def fallback_rubrics(spark, sf_dir):
    """TXT-10: two anchored dimensions per judge intent."""
    out = RB.fallback_rubrics(keyword_rules(spark, sf_dir))
    return out.select("doc_id", "intent_id", F.col("pos").cast("long").alias("pos"), "dim", "question", "min_score",
                      F.size("scale").alias("levels"))


# ---- SCL-6, SCL-9, SCL-11 --------------------------------------------------------------------------
@query("template_substitution", sql="""
SELECT event_id, 'user ' || user_id || ' did ' || event_type || ', {{unknown}} {{ event }} {{user' AS rendered FROM events""")
def template_substitution(spark, sf_dir):
    """SCL-6: known names are put in, anything else stays as written."""
    from proofline.functions.text import substitute
    e = T.table(spark, sf_dir, "events")
    values = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("event"), F.col("event_type"))
    return e.select("event_id", substitute(F.lit("user {{user}} did {{event}}, {{unknown}} {{ event }} {{user"), values).alias("rendered"))


@query("visible_request", sql="""
SELECT event_id, '{"event":"' || event_type || '","user":' || user_id || '}' AS request FROM events""")
def visible_request(spark, sf_dir):
    """SCL-9: a request without its members that begin with an underscore."""
    body = F.to_json(F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("event"), F.col("value").alias("_mock")))
    e = T.table(spark, sf_dir, "events")
    return e.select("event_id", SP.object_text(SP.visible(SP.as_object(F.parse_json(body)))).alias("request"))


@query("response_paths", sql="""
SELECT path, count(*) AS responses FROM (
  SELECT unnest(['$.findings', '$.findings[*]', '$.findings[*].article', '$.findings[*].severity', '$.findings[*].status']) AS path FROM lineitem)
GROUP BY path""")
def response_paths(spark, sf_dir):
    """SCL-11 re-aimed at captured responses: every path that occurs, and in how many."""
    r = T.finding_responses(spark, sf_dir).select(jp.strict_json(F.col("body")).alias("json"))
    return jp.path_inventory(r, "json")
