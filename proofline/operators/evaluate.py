"""Apply declared checks to captured responses (CHK-20..24), then gate cases.

Two ways in, one result shape and one meaning per template (``operators.params``):

* :func:`apply_checks` — checks known at plan time (a spec applied to a whole table of
  responses). Every check becomes a Column of the same projection, so there is no
  join and no shuffle; the case gate is a Column too.
* :func:`evaluate_checks` — checks as a table (one row per case and check), joined to the
  responses on the case key. Parameters and JSONPaths stay data; nothing of the table is read
  while the plan is built. Schemas and user checks are code, so the caller names them.

Judge checks are scored from verdict tables (``operators.judge``): :func:`with_judgements` puts
those results in place of the judge rows before the gate.
"""
from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.functions import jsonpath as jp
from proofline.operators import checks as C
from proofline.operators import udf as U
from proofline.operators.jsonschema import explained, has_body, json_schema, result_fields, valid_body, violations
from proofline.operators.params import Data, Literal, compact

RESULT_COLUMNS = ["check_index", "check_id", "type", "passed", "score", "threshold",
                  "severity", "message", "evidence", "required"]


def with_body(responses: DataFrame, body: str = "body") -> DataFrame:
    """Parse the raw body text once into a VARIANT column ``json`` (SCL-2)."""
    return responses.withColumn("json", jp.strict_json(F.col(body)))


def _resp(text, latency, cost, columns=None, body=None) -> dict:
    def col(name, typ):
        present = name and (columns is None or name in columns)
        return F.col(name) if present else F.lit(None).cast(typ)
    own = {k: F.col(k) for k in ("raw", "tool_calls", "usage", "status", "error") if columns and k in columns}
    return {"text": col(text, "string"), "json": F.col("json"), "body": F.col(body) if body else None,
            "latency_ms": col(latency, "double"), "cost_usd": col(cost, "double"), **own}


def _has(df: DataFrame, name: str | None) -> str | None:
    return name if name and name in df.columns else None


def effective_threshold(with_threshold, spec_threshold):
    """``with.threshold or spec.threshold`` — a falsy (0 / missing) value falls through."""
    if isinstance(with_threshold, Column) or isinstance(spec_threshold, Column):
        w = with_threshold if isinstance(with_threshold, Column) else F.lit(with_threshold)
        s = spec_threshold if isinstance(spec_threshold, Column) else F.lit(spec_threshold)
        return F.coalesce(F.nullif(w.cast("double"), F.lit(0.0)), s.cast("double"))
    return with_threshold or spec_threshold


def graded(passed: Column, score: Column, threshold: Column) -> Column:
    """CHK-21: with a score and a threshold, ``score >= threshold`` replaces the flag."""
    return F.when(score.isNotNull() & threshold.isNotNull(), score >= threshold) \
        .otherwise(F.coalesce(passed, F.lit(False)))


def _struct(index: int, check_id: str, ctype: str, raw: dict, threshold, required) -> Column:
    thr = threshold if isinstance(threshold, Column) else F.lit(threshold).cast("double")
    return F.struct(
        F.lit(index).cast("long").alias("check_index"),
        F.lit(check_id).alias("check_id"),
        F.lit(ctype).alias("type"),
        graded(raw["passed"], raw["score"], thr).alias("passed"),
        raw["score"].cast("double").alias("score"),
        thr.alias("threshold"),
        raw["severity"].alias("severity"),
        raw["message"].alias("message"),
        raw["evidence"].alias("evidence"),
        F.lit(bool(required)).alias("required"))


def _failed(message: str) -> dict:
    return {"passed": F.lit(False), "score": F.lit(None).cast("double"),
            "severity": F.lit("fail"), "message": F.lit(message),
            "evidence": F.lit(None).cast("string")}


def check_columns(checks: list[C.Check], *, text="text", latency="latency_ms",
                  cost="cost_usd", user_checks=None, context: Column | None = None,
                  schemas: dict | None = None, columns=None, body: str | None = None) -> list[Column]:
    """One result struct Column per declared check (requires a ``json`` column). ``schemas``:
    the schemas that ``schema_ref`` names; ``context``: JSON text given to user checks."""
    r = _resp(text, latency, cost, columns, body)
    paths = {}
    out = []
    for i, chk in enumerate(checks):
        chk.validate()
        thr = effective_threshold((chk.params or {}).get("threshold"), chk.threshold)
        if chk.type == "template" and chk.uses == "json_schema":
            ready = f"_schema_ok_{i}" in (columns or ())
            raw = (explained(F.col("json"), F.col(f"_schema_ok_{i}"), F.col(f"_schema_first_{i}")) if ready
                   else result_fields(json_schema(r, _schema_of(chk.params, schemas))))
            out.append(_struct(i, "template:json_schema", "template", raw, thr, chk.required))
        elif chk.type == "template" and chk.uses in C.BUILDERS:
            p, m = Literal(chk.params), None
            if chk.uses in C.PATH_TEMPLATES:
                path = chk.params["field"]
                if path not in paths:
                    paths[path] = p.matches(F.col("json"))
                m = paths[path]
            out.append(_struct(i, f"template:{chk.uses}", "template", C.BUILDERS[chk.uses](r, p, m), thr, chk.required))
        elif chk.type == "template":
            out.append(_struct(i, chk.uses or chk.type, "template",
                               _failed(f"unknown template: {chk.uses}"), None, chk.required))
        elif chk.type == "generated":
            raw = U.run_user_check(chk.uses, r, context, user_checks)
            out.append(_struct(i, f"generated:{chk.uses}", "generated", raw, thr, chk.required))
        elif chk.type == "judge":
            out.append(_struct(i, chk.uses or "judge", "judge",
                               _failed(f"unknown judge: {chk.judge}"), thr, chk.required))
        else:
            out.append(_struct(i, chk.uses or chk.type, chk.type,
                               _failed(f"unknown check type: {chk.type}"), None, chk.required))
    return out


def with_schema_results(df: DataFrame, checks: list[C.Check], schemas: dict | None = None) -> DataFrame:
    """The verdict of every json_schema check and the first violation of bodies that fail, as
    columns of their own: judged once, and the violation not at all where nobody reads it."""
    for i, chk in enumerate(checks):
        if chk.type == "template" and chk.uses == "json_schema":
            chk.validate()
            schema = _schema_of(chk.params, schemas)
            df = df.withColumn(f"_schema_ok_{i}", valid_body(F.col("json"), schema))
            df = df.withColumn(f"_schema_first_{i}", F.when(
                has_body(F.col("json")) & ~F.col(f"_schema_ok_{i}"), F.get(violations(schema, F.col("json")), F.lit(0))))
    return df


def _schema_of(params: dict, schemas: dict | None):
    if params.get("schema") is not None:
        return params["schema"]
    ref = params.get("schema_ref")
    if ref not in (schemas or {}):
        raise KeyError(f"schema_ref {ref!r} is not among the schemas given")
    return schemas[ref]


def apply_checks(responses: DataFrame, checks: list[C.Check], keys: list[str], *,
                 text="text", body: str | None = "body", latency="latency_ms",
                 cost="cost_usd", user_checks=None, context: Column | None = None,
                 schemas: dict | None = None) -> DataFrame:
    """Long-form ``check_results``: one row per (case, check). No join, no shuffle."""
    df = with_body(responses, body) if body else responses.withColumn(
        "json", F.lit(None).cast("variant"))
    df = with_schema_results(df, checks, schemas)
    cols = check_columns(checks, text=_has(df, text), latency=_has(df, latency), cost=_has(df, cost),
                         user_checks=user_checks, context=context, schemas=schemas, columns=df.columns, body=body)
    return df.select(*keys, F.inline(F.array(*cols)))


def with_judgements(check_results: DataFrame, judgements: DataFrame, keys: list[str]) -> DataFrame:
    """Check results in which every judge check has the result of its verdicts. ``judgements``:
    keys, check_index, judge, passed, score, message, severity, evidence (from
    ``judge.score_checks``). A judge check without one stays failed."""
    j = judgements.select(*keys, "check_index", F.struct(
        "judge", "passed", F.col("score").cast("double").alias("score"), "severity", "message",
        F.col("evidence").cast("string").alias("evidence")).alias("_j"))
    out = check_results.join(j, [*keys, "check_index"], "left")
    use = (F.col("type") == "judge") & F.col("_j").isNotNull()

    def pick(name: str) -> Column:
        return F.when(use, F.col("_j")[name]).otherwise(F.col(name)).alias(name)
    passed = F.when(use, graded(F.col("_j.passed"), F.col("_j.score"), F.col("threshold"))).otherwise(F.col("passed"))
    return out.select(*keys, "check_index",
                      F.when(use, F.concat(F.lit("judge:"), F.col("_j.judge"))).otherwise(F.col("check_id")).alias("check_id"),
                      "type", passed.alias("passed"), pick("score"), "threshold", pick("severity"),
                      pick("message"), pick("evidence"), "required")


def gate_column(results: list[Column]) -> Column:
    """CHK-22 on result structs of one row: every *required* check passes."""
    ok = F.lit(True)
    for s in results:
        ok = ok & (~s["required"] | s["passed"])
    return ok


def apply_and_gate(responses: DataFrame, checks: list[C.Check], keys: list[str], *,
                   text="text", body: str | None = "body", latency="latency_ms",
                   cost="cost_usd", extra: list[str] = ()) -> DataFrame:
    """One row per case with its gate (``passed``) and failed-check count, in one pass."""
    df = with_body(responses, body) if body else responses.withColumn(
        "json", F.lit(None).cast("variant"))
    df = with_schema_results(df, checks)
    cols = check_columns(checks, text=_has(df, text), latency=_has(df, latency),
                         cost=_has(df, cost), columns=df.columns)
    n_failed = sum((F.when(c["passed"], 0).otherwise(1) for c in cols), F.lit(0))
    return df.select(*keys, *extra, gate_column(cols).alias("passed"),
                     n_failed.cast("long").alias("failed_checks"))


def case_gate(check_results: DataFrame, keys: list[str],
              cases: DataFrame | None = None) -> DataFrame:
    """CHK-22 over long-form results: ``bool_and(passed) FILTER (WHERE required)``.

    With ``cases``, every case is kept (left join): a case without required results
    passes. The aggregate is algebraic, so skewed cases combine map-side.
    """
    agg = check_results.groupBy(*keys).agg(
        F.expr("bool_and(passed) FILTER (WHERE required)").alias("_gate"))
    if cases is not None:
        agg = cases.select(*keys).join(agg, keys, "left")
    return agg.select(*keys, F.coalesce(F.col("_gate"), F.lit(True)).alias("passed"))


# ---- checks as a table ------------------------------------------------------------

def checks_table(spark, rows: list[dict]) -> DataFrame:
    """Flattened spec rows -> a ``checks`` DataFrame (params kept as JSON text)."""
    schema = ("suite_id string, case_id string, check_index long, type string, uses string, "
              "judge string, rubric string, params string, required boolean, threshold double")
    data = [(r.get("suite_id"), r.get("case_id"), int(r.get("check_index", i)),
             r.get("type", "template"), r.get("uses"), r.get("judge"), r.get("rubric"),
             json.dumps(r.get("params") or r.get("with") or {}),
             bool(r.get("required", True)), r.get("threshold")) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, schema)


def evaluate_checks(responses: DataFrame, checks: DataFrame, on: list[str], *,
                    text="text", body: str | None = "body", latency="latency_ms",
                    cost="cost_usd", schemas: dict | None = None, user_checks: dict | None = None,
                    context: Column | None = None) -> DataFrame:
    """CHK-20/21 with checks as data: ``responses ⋈ checks`` on the case key.

    ``schemas``: schemas by name; a row of ``json_schema`` names one by ``schema_ref`` or holds
    one of them as ``schema``. ``user_checks``: functions by name for rows of type
    ``generated``. Both are code given by the caller, so their number is that of the code, not
    of the table's rows; a row that names another one fails with a message.
    """
    df = with_body(responses, body) if body else responses.withColumn(
        "json", F.lit(None).cast("variant"))
    spec = checks.withColumnRenamed("type", "check_type").withColumn("_p", F.try_parse_json("params"))
    spec = spec.drop(*[c for c in ("suite_id", "case_id") if c not in on and c in spec.columns])
    p = Data(F.col("_p"))
    uses, kind = F.col("uses"), F.col("check_type")
    # what the parameters alone decide is worked out once per check, before it meets responses
    required = {name: C.REQUIRED_PARAMS.get(name, ()) for name in C.BUILDERS}
    problem = None
    for needed in sorted(set(required.values())):
        mine = uses.isin([n for n in required if required[n] == needed])
        problem = F.when(mine, p.problem(needed)) if problem is None else problem.when(mine, p.problem(needed))
    spec = spec.withColumn("_steps", F.when((kind == "template") & uses.isin(list(C.PATH_TEMPLATES)), p.steps()))
    spec = spec.withColumn("_problem", F.when(kind == "template", problem))
    # one extraction per row, whichever path template it is for
    joined = df.join(spec, on, "inner").withColumn(
        "_m", F.when(F.col("_steps").isNotNull(), p.matches(F.col("json"), F.col("_steps"))))
    r = _resp(text, latency, cost, df.columns, body)
    branches: list[tuple[Column, dict]] = [(F.col("_problem").isNotNull(), _failed_column(F.col("_problem")))]
    for name, fn in C.BUILDERS.items():
        m = F.col("_m") if name in C.PATH_TEMPLATES else None
        branches.append(((kind == "template") & (uses == name), fn(r, p, m)))
    for name, schema in (schemas or {}).items():
        named = (p.string("schema_ref") == name) | (F.to_json(F.try_variant_get(F.col("_p"), "$.schema", "variant"))
                                                    == compact(schema))
        branches.append(((kind == "template") & (uses == "json_schema") & named, result_fields(json_schema(r, schema))))
    branches.append(((kind == "template") & (uses == "json_schema"), _failed("schema is not among those given")))
    known_checks = dict(user_checks or {})
    for name in known_checks:
        mine = (kind == "generated") & (uses == name)
        branches.append((mine, U.run_user_check(name, r, context, known_checks)))
    branches.append((kind == "generated", _failed_column(F.concat(
        F.lit("no check function registered as "), F.lit("'"), uses, F.lit("'")))))
    branches.append((kind == "judge", _failed_column(F.concat(
        F.lit("unknown judge: "), F.coalesce("judge", F.lit("None"))))))
    branches.append((kind == "template", _failed_column(F.concat(
        F.lit("unknown template: "), F.coalesce(uses, F.lit("None"))))))
    other = _failed_column(F.concat(F.lit("unknown check type: "), kind))

    def result(raw: dict) -> Column:
        return F.struct(*[raw[k].alias(k) for k in ("passed", "severity", "message", "evidence")],
                        raw["score"].cast("double").alias("score"))
    chosen = None
    for cond, raw in branches:
        cond = F.coalesce(cond, F.lit(False))
        chosen = F.when(cond, result(raw)) if chosen is None else chosen.when(cond, result(raw))
    chosen = chosen.otherwise(result(other))

    known = (kind == "template") & uses.isin([*C.BUILDERS, "json_schema"])
    thr = effective_threshold(F.try_variant_get(F.col("_p"), "$.threshold", "double"), F.col("threshold"))
    thr = F.when(known | kind.isin("generated", "judge"), thr)
    return joined.withColumn("_r", chosen).select(
        *on, *[c for c in ("run_id", "suite_id", "case_id") if c not in on and c in responses.columns],
        F.col("check_index"),
        F.when(known, F.concat(F.lit("template:"), uses)).when(kind == "generated", F.concat(F.lit("generated:"), uses))
         .otherwise(F.coalesce(uses, kind)).alias("check_id"),
        kind.alias("type"), graded(F.col("_r.passed"), F.col("_r.score"), thr).alias("passed"),
        F.col("_r.score").alias("score"), thr.alias("threshold"), F.col("_r.severity").alias("severity"),
        F.col("_r.message").alias("message"), F.col("_r.evidence").alias("evidence"), F.col("required"))


def _failed_column(message: Column) -> dict:
    return dict(_failed(""), message=message)
