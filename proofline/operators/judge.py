"""Judge verdicts -> check results (JDG-1, JDG-4..14).

Input is a table of verdict samples (one row per case, judge check and sample: what a model
replied). The model call that produces it is a pluggable ``mapInPandas`` stage
(``operators.udf.ask_judge``).

Median per dimension is computed from per-score counts: scores are small integers
(a rubric's scale), so ``(case, dim, score) -> count`` is an algebraic, map-side
combined aggregate, and the median falls out of the cumulative counts of at most a
handful of rows per dimension — exact, and no group is ever collected whole. What is
collected per check is one entry per dimension of its rubric or distinct quote.
"""
from __future__ import annotations

import json
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.functions import jsonpath as jp
from proofline.functions.text import fold, py_repr
from proofline.operators.jsonschema import compile_schema, violations

# ---- fixed values that must equal the reference's --------------------------------
ELLIPSIS = r"\.{3,}|…"
NO_QUOTES = "rubric requires evidence, but the judge quoted nothing"
FABRICATED = "evidence quotes do not appear in the response: "
# -----------------------------------------------------------------------------------


# ---- JDG-1: prompt -------------------------------------------------------------------

def json_string(s: Column) -> Column:
    return F.regexp_replace(F.to_json(F.array(s)), r"^\[|\]$", "")


def build_prompt(dims_text: Column, response_json: Column, response_text: Column,
                 case_input: Column, max_chars: tuple[int, int] | None = None) -> Column:
    """JDG-1: rubric dimension lines, the whole response (JSON body, or the text where there is
    none or an empty one), the whole case input. ``max_chars`` cuts the two where a caller's
    model needs it."""
    empty = response_json.isNull() | response_json.isin("{}", "[]", '""', "0", "false", "null")
    body = F.when(~empty, response_json).otherwise(F.coalesce(json_string(response_text), F.lit("null")))
    given = F.coalesce(case_input, F.lit("null"))
    if max_chars:
        body, given = F.substring(body, 1, max_chars[0]), F.substring(given, 1, max_chars[1])
    return F.concat(F.lit("RUBRIC DIMENSIONS:\n"), dims_text, F.lit("\n\nMODEL RESPONSE:\n"), body,
                    F.lit("\n\nCASE INPUT:\n"), given)


# ---- JDG-4: verdict parsing ------------------------------------------------------------

_OPEN = re.compile(r'\{(?=[ \t\n\r]*["}])')
_NESTS = re.compile(r'"(?:[^"\\]|\\.)*"?|[{}\[\]]', re.S)
_WINDOW = 512


def _decoded(decoder: json.JSONDecoder, text: str, start: int) -> tuple[int | None, int]:
    """(end of the value at ``start``, None if there is none; place of the fault). The text is looked
    at in windows that double, since the library's errors count the lines before the fault."""
    width = _WINDOW
    while True:
        piece = text[start:start + width]
        try:
            return start + decoder.raw_decode(piece)[1], start
        except json.JSONDecodeError as error:
            cut_off = error.msg.startswith("Unterminated string") or error.pos > len(piece) - 16
            if not cut_off or start + width >= len(text):
                return None, start + error.pos
            width *= 2


def _too_deep(text: str, start: int) -> list[int]:
    """Braces from ``start`` on with more levels below them than Spark parses."""
    opened, deep = deque(), []
    for t in _NESTS.finditer(text, start):
        if t[0] in "{[":
            opened.append(t.start())
            if len(opened) > jp.NESTING:
                deep.append(opened.popleft())
        elif t[0] in "}]" and opened:
            opened.pop()
    return deep


def first_object(text: str) -> str | None:
    """The text of the first JSON object in a reply, at whatever brace it starts.

    A try that fails at some place decides more than its own brace: objects that were open there
    fail there too, those closed before it are objects. So no brace that lies outside the
    strings of an earlier try is tried again, and the work is linear in the reply."""
    constants: list[str] = []  # NaN and the like, which are not JSON
    decoder = json.JSONDecoder(parse_constant=constants.append)
    failed: set[int] = set()
    for m in _OPEN.finditer(text):
        start = m.start()
        if start in failed:
            continue
        constants.clear()
        try:
            end, stop = _decoded(decoder, text, start)
        except RecursionError:
            failed.update(_too_deep(text, start))
            continue
        if end is not None:
            if not constants:
                return text[start:end]
            continue
        opened: list[int] = []
        for t in _NESTS.finditer(text, start, stop):
            if t[0] == "{":
                opened.append(t.start())
            elif t[0] == "}" and opened:
                opened.pop()
        failed.update(opened)
    return None


def _found(replies: Column) -> Column:
    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else first_object(t) for t in texts.to_pylist()], pa.string())
    return run(replies)


def parse_verdicts(verdicts: DataFrame, text: str = "verdict", schema=None) -> DataFrame:
    """JDG-4: ``verdict_json`` and ``verdict_error``, never both. A reply that is a JSON object
    is that object; a reply that is no JSON is the first object inside its prose, looked for in
    Python only in such replies; everything else is an error, also JSON that is no object. With
    ``schema`` an object that does not match it is an error too, with the first violation."""
    reply = F.col(text)
    out = verdicts.withColumn("_parsed", jp.strict_json(reply)).withColumn("_kind", jp.variant_kind(F.col("_parsed")))
    prose = F.col("_kind").isNull() & reply.contains("{")
    out = out.withColumn("_inner", _found(F.when(prose, reply)))
    found = F.when(F.col("_kind") == "object", F.col("_parsed")).when(F.col("_kind").isNull(), F.try_parse_json("_inner"))
    out = out.withColumn("_found", found)
    no_object = (F.when(reply.isNull() | (F.trim(reply) == ""), "empty reply")
                 .when(F.col("_kind").isNotNull() & (F.col("_kind") != "object"), F.concat(F.lit("expected an object, got "), "_kind"))
                 .otherwise("no JSON object in the reply"))
    error = F.when(F.col("_found").isNull(), no_object)
    if schema is not None:
        out = out.withColumn("_valid", compile_schema(schema, F.col("_found")))
        first = F.get(violations(schema, F.col("_found")), F.lit(0))["message"]
        error = error.when(~F.col("_valid"), F.concat(F.lit("does not match the schema"), F.coalesce(F.concat(F.lit(": "), first), F.lit(""))))
    out = out.withColumn("verdict_error", error)
    return out.withColumn("verdict_json", F.when(F.col("verdict_error").isNull(), F.to_json("_found"))).select(
        *verdicts.columns, "verdict_json", "verdict_error")


# ---- JDG-5/6: scores --------------------------------------------------------------------

def as_int(v: Column) -> Column:
    """JDG-5 integer coercion of a VARIANT score: "2" -> 2, 1.9 -> 1, true -> 1;
    "2.5", null, objects -> NULL."""
    s = F.schema_of_variant(v)
    as_str = F.try_variant_get(v, "$", "string").try_cast("int")
    as_num = F.try_variant_get(v, "$", "double").try_cast("int")
    return (F.when(v.isNull() | F.is_variant_null(v), F.lit(None).cast("int"))
            .when(s == "STRING", as_str)
            .when(s.startswith("OBJECT") | s.startswith("ARRAY"), F.lit(None).cast("int"))
            .otherwise(as_num))


def explode_scores(verdicts: DataFrame, keys: list[str], scores: str = "scores",
                   sample: str = "sample_no", dims: DataFrame | None = None) -> DataFrame:
    """Verdict rows with a JSON ``scores`` object -> (keys, sample, dim, score). With ``dims``
    (rubric_id, dim) only the dimensions that the rubric of the verdict lists."""
    m = F.try_parse_json(F.col(scores)).try_cast("map<string,variant>")
    own = [*keys, *(["rubric_id"] if dims is not None else [])]
    s = (verdicts.select(*own, sample, F.explode(m).alias("dim", "_v"))
         .select(*own, sample, "dim", as_int(F.col("_v")).alias("score"))
         .where(F.col("score").isNotNull()))
    if dims is not None:
        s = s.join(dims.select("rubric_id", "dim").distinct(), ["rubric_id", "dim"], "left_semi")
    return s.select(*keys, sample, "dim", "score")


def reduce_scores(scores: DataFrame, keys: list[str]) -> DataFrame:
    """JDG-6 per (keys, dim): n, floor(median), spread = max - min, samples (score -> count)."""
    g = keys + ["dim"]
    counts = scores.groupBy(*g, "score").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*g).orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    cum = counts.withColumn("hi", F.sum("c").over(w)).withColumn("lo", F.col("hi") - F.col("c"))
    n = F.sum("c").over(Window.partitionBy(*g))
    cum = cum.withColumn("n", n)
    # order statistics k1 = (n+1)//2 and k2 = n//2 + 1 (1-based); median = mean of the two
    k1 = F.floor((F.col("n") + 1) / 2)
    k2 = F.floor(F.col("n") / 2) + 1
    cum = (cum.withColumn("_a", F.when((F.col("lo") < k1) & (k1 <= F.col("hi")), F.col("score")))
              .withColumn("_b", F.when((F.col("lo") < k2) & (k2 <= F.col("hi")), F.col("score"))))
    return cum.groupBy(*g).agg(
        F.max("n").alias("n"),
        F.floor((F.max("_a") + F.max("_b")) / 2).cast("int").alias("median"),
        (F.max("score") - F.min("score")).cast("int").alias("spread"))


def consistency(reduced: DataFrame, keys: list[str]) -> DataFrame:
    """JDG-6 per check: samples (max n), max spread, agreed, and the block per dimension; only
    when some dimension had more than one sample."""
    return (reduced.groupBy(*keys).agg(
        F.max("n").alias("samples"), F.max("spread").alias("max_spread"),
        F.array_sort(F.collect_list(F.struct("dim", "n", "median", "spread"))).alias("per_dimension"))
        .where(F.col("samples") > 1)
        .withColumn("agreed", F.col("max_spread") == 0))


def dimension_threshold(dim_min: Column, rubric_min: Column, scale_top: Column) -> Column:
    """JDG-7: dimension min_score, else rubric min_score, else top of scale (1)."""
    return F.coalesce(dim_min, rubric_min, scale_top, F.lit(1)).cast("int")


# ---- JDG-8/12/13/14: results --------------------------------------------------------------

def first_rationale(verdicts: DataFrame, keys: list[str], rationale: str = "rationale",
                    sample: str = "sample_no") -> DataFrame:
    """The first non-empty rationale over the samples of each check."""
    said = F.nullif(F.col(rationale), F.lit(""))
    return verdicts.groupBy(*keys).agg(F.min_by(said, F.when(said.isNotNull(), F.col(sample))).alias("rationale"))


def score_checks(reduced: DataFrame, dims: DataFrame, cases: DataFrame, keys: list[str],
                 rationale: DataFrame | None = None, evidence: DataFrame | None = None) -> DataFrame:
    """JDG-8/12/13/14: one judge result per check: keys, passed, score, n_failures, message,
    severity.

    ``dims``: (rubric_id, dim, dim_pos, min_score, rubric_min, scale_top). ``cases``: keys and
    rubric_id of every check that was judged, so one whose judge scored nothing still gets a
    result. ``rationale``: keys, rationale. ``evidence`` (from :func:`evidence_failures`): keys,
    evidence_failure. The message is whole; shorten it where it is shown.
    """
    d = dims.withColumn("threshold", dimension_threshold(
        F.col("min_score"), F.col("rubric_min"), F.col("scale_top")))
    grid = cases.select(*keys, "rubric_id").distinct().join(d, "rubric_id", "left")
    j = grid.join(reduced.select(*keys, "dim", "median"), keys + ["dim"], "left")
    failure = (F.when(F.col("dim").isNull(), F.lit(None))
               .when(F.col("median").isNull(),
                     F.concat(F.lit("judge did not score dimension '"), F.col("dim"), F.lit("'")))
               .when(F.col("median") < F.col("threshold"),
                     F.concat(F.col("dim"), F.lit("="), F.col("median").cast("string"),
                              F.lit(" < min_score "), F.col("threshold").cast("string"))))
    agg = j.groupBy(*keys).agg(
        F.sum(F.coalesce("median", F.lit(0))).alias("_tot"),
        F.sum("scale_top").alias("_max"),
        F.array_sort(F.collect_list(F.when(failure.isNotNull(),
                                           F.struct(F.col("dim_pos"), failure.alias("f"))))).alias("_fails"))
    none = F.lit(None).cast("string")
    agg = agg.join(evidence, keys, "left") if evidence is not None else agg.withColumn("evidence_failure", none)
    agg = agg.join(rationale, keys, "left") if rationale is not None else agg.withColumn("rationale", none)
    fails = F.concat(F.transform("_fails", lambda s: s["f"]), F.filter(
        F.array("evidence_failure"), lambda x: x.isNotNull()))
    out = agg.withColumn("_f", fails)
    passed = F.size("_f") == 0
    said = F.filter(F.array("rationale"), lambda x: x.isNotNull())
    return out.select(*keys, passed.alias("passed"),
                      F.when(F.col("_max") > 0, F.bround(F.col("_tot") / F.col("_max"), 3)).alias("score"),
                      F.size("_f").alias("n_failures"),
                      F.array_join(F.concat("_f", said), "; ").alias("message"),
                      F.when(passed, "info").otherwise("warn").alias("severity"))


# ---- evidence quotes (JDG-9..12) ---------------------------------------------------

def quote_segments(quote: Column) -> Column:
    """A quote split on ellipses, each segment folded, empty segments dropped."""
    return F.filter(F.transform(F.split(quote, ELLIPSIS), fold), lambda s: F.length(s) > 0)


def quote_in(quote: Column, folded_hay: Column) -> Column:
    """JDG-9: every segment occurs in the (folded) response text, in order; a blank
    quote is not evidence."""
    segs = quote_segments(quote)
    end = F.aggregate(segs, F.lit(1), lambda at, s: F.when(
        at == 0, F.lit(0)).otherwise(F.when(
            F.position(s, folded_hay, at) == 0, F.lit(0))
            .otherwise(F.position(s, folded_hay, at) + F.length(s))))
    return (F.size(segs) > 0) & (end > 0)


def _flat(node) -> str:
    """The text of a parsed body; a stack of (is text, item) in place of recursion."""
    out, stack = [], [(False, node)]
    while stack:
        is_text, x = stack.pop()
        if is_text:
            out.append(x)
        elif isinstance(x, (dict, list)):
            pairs = x.items() if isinstance(x, dict) else ((None, v) for v in x)
            below = []
            for k, v in pairs:
                below += [(True, ("\n" if below else "") + ("" if k is None else f"{k} ")), (False, v)]
            stack += reversed(below)
        else:
            out.append(str(x))
    return "".join(out)


def _flat_udf(bodies: Column) -> Column:
    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else _flat(json.loads(t)) for t in texts.to_pylist()], pa.string())
    return run(bodies)


def flattened(v: Column, depth: int | None = None) -> Column:
    """JDG-10: a VARIANT body as text: ``key value`` lines for objects, one line per element for
    arrays, scalars as they print, to any depth. Where a caller gives ``depth``, levels below it
    are taken as their JSON text and no Python runs."""
    if depth is None:
        return _flat_udf(F.to_json(v))
    kind = jp.variant_kind(v)
    scalar = (F.when(kind == "string", F.try_variant_get(v, "$", "string"))
              .when(kind == "null", "None")
              .when(kind == "boolean", F.when(F.try_variant_get(v, "$", "boolean"), "True").otherwise("False"))
              .otherwise(F.to_json(v)))
    if depth == 0:
        return scalar
    obj = F.array_join(F.transform(F.map_entries(v.try_cast("map<string,variant>")), lambda e: F.concat(
        e["key"], F.lit(" "), flattened(e["value"], depth - 1))), "\n")
    arr = F.array_join(F.transform(v.try_cast("array<variant>"), lambda x: flattened(x, depth - 1)), "\n")
    return F.when(kind == "object", obj).when(kind == "array", arr).otherwise(scalar)


def haystack(text: Column, body: Column | None = None, depth: int | None = None) -> Column:
    """JDG-10: everything a judge could have quoted: the text, then the flattened body."""
    parts = [F.nullif(F.coalesce(text, F.lit("")), F.lit(""))]
    if body is not None:
        parts.append(F.nullif(flattened(body, depth), F.lit("")))
    return F.concat_ws("\n", *parts)


def unique_quotes(verdicts: DataFrame, keys: list[str], quotes: str = "evidence_quotes",
                  sample: str = "sample_no") -> DataFrame:
    """JDG-11: (keys, quotes): distinct quotes over the samples of a check, first seen first; no
    row for a check without quotes."""
    ex = verdicts.select(*keys, sample, F.posexplode(quotes).alias("pos", "quote"))
    first = ex.groupBy(*keys, "quote").agg(F.min(F.struct(sample, "pos")).alias("_first"))
    return first.groupBy(*keys).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("_first", "quote"))), lambda s: s["quote"]).alias("quotes"))


def evidence_failures(cases: DataFrame, quotes: DataFrame, keys: list[str],
                      hay: str = "hay") -> DataFrame:
    """JDG-9/12 per check whose rubric requires evidence: verified, unverified (arrays) and
    evidence_failure (NULL: fine). ``cases``: keys and the folded haystack."""
    j = cases.join(quotes, keys, "left").withColumn("quotes", F.coalesce("quotes", F.expr("cast(array() as array<string>)")))
    seen = F.transform("quotes", lambda x: F.struct(x.alias("q"), quote_in(x, F.col(hay)).alias("ok")))
    j = j.withColumn("_s", seen).select(
        *keys, "quotes", F.transform(F.filter("_s", lambda s: s["ok"]), lambda s: s["q"]).alias("verified"),
        F.transform(F.filter("_s", lambda s: ~s["ok"]), lambda s: s["q"]).alias("unverified"))
    bad = F.concat(F.lit(FABRICATED), F.array_join(F.transform("unverified", py_repr), "; "))
    return j.select(*keys, "verified", "unverified", F.when(F.size("quotes") == 0, NO_QUOTES).when(
        F.size("unverified") > 0, bad).alias("evidence_failure"))
