"""User code plug points (UDF-1..4, JDG-2), all Arrow-batched.

* user checks — ``check(response: dict, context: dict) -> dict``; registered by name,
  evaluated by a pandas UDF over Arrow batches. A missing function, an exception or a
  non-dict result becomes a *failed result*, never a failed job. Stored source text
  is never executed (deviation D-6): only importable, registered functions run.
* providers — a judge or target model is a function over a pandas batch of prompts,
  run with ``mapInPandas``.
"""
from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT_TYPE = "passed boolean, score double, severity string, message string, evidence string"
# Fields of the response a user check is given, in this order.
RESPONSE_FIELDS = ("text", "json", "raw", "tool_calls", "usage", "latency_ms", "cost_usd", "status", "error")
_JSON_FIELDS = ("json", "raw", "tool_calls", "usage")
_CHECKS: dict[str, Callable[[dict, dict], dict]] = {}
_EVIDENCE = json.JSONEncoder(default=str).encode
_RESULT_ARROW = [pa.bool_(), pa.float64(), pa.string(), pa.string(), pa.string()]


def register_check(name: str, fn: Callable[[dict, dict], dict]) -> None:
    _CHECKS[name] = fn


def _missing(v) -> bool:
    return v is None or (isinstance(v, float) and pd.isna(v))


def _loads(s):
    if _missing(s):
        return None
    try:
        return json.loads(s)
    except (TypeError, ValueError):
        return None


def _result(raw) -> tuple:
    if not isinstance(raw, dict):
        return (False, None, "fail", "check returned no result", None)
    score, evidence = raw.get("score"), raw.get("evidence")
    return (bool(raw.get("passed", False)),
            float(score) if isinstance(score, (int, float)) and not isinstance(score, bool) else None,
            str(raw.get("severity", "info")), str(raw.get("message", "")),
            _EVIDENCE(evidence) if evidence else "{}")


def _contexts(texts: list):
    """The context of each row. An equal text is parsed once if its members are plain values, which
    a copy of the object does not share."""
    plain: dict[str, dict] = {}
    for text in texts:
        known = plain.get(text)
        if known is not None:
            yield known.copy()
            continue
        value = _loads(text) or {}
        if isinstance(value, dict) and not any(isinstance(v, (dict, list)) for v in value.values()):
            plain[text] = value.copy()
        yield value


def check_udf(fn: Callable[[dict, dict], dict] | None, name: str):
    """Arrow UDF applying one user check to a response struct and its context (JSON text). Fields that the
    struct lacks are None."""
    empty = dict.fromkeys(RESPONSE_FIELDS)

    @F.arrow_udf(RESULT_TYPE)
    def run(response: pa.Array, context: pa.Array) -> pa.Array:
        out = [[] for _ in _RESULT_ARROW]
        if fn is None:
            rows = [(False, None, "fail", f"no check function registered as {name!r}", None)] * len(response)
        else:
            rows = _results(fn, response, context, empty)
        passed, score, severity, message, evidence = (x.append for x in out)
        for r in rows:
            passed(r[0]), score(r[1]), severity(r[2]), message(r[3]), evidence(r[4])
        # as in pandas, a score that is not a number is no score
        return pa.StructArray.from_arrays([pa.array(c, t, from_pandas=True) for c, t in zip(out, _RESULT_ARROW, strict=True)],
                                          names=["passed", "score", "severity", "message", "evidence"])
    return run


def _results(fn: Callable[[dict, dict], dict], response: pa.Array, context: pa.Array, empty: dict):
    """The result of the check for each row; only the row at hand is held parsed."""
    fields = [(f.name, f.name in _JSON_FIELDS, values.to_pylist())
              for f, values in zip(response.type, response.flatten(), strict=True) if values.null_count < len(values)]
    for i, ctx in enumerate(_contexts(context.to_pylist())):
        resp = empty.copy()
        for k, is_json, values in fields:
            v = values[i]
            resp[k] = _loads(v) if is_json else None if _missing(v) else v
        resp["latency_ms"] = resp["latency_ms"] or 0.0
        try:
            yield _result(fn(resp, ctx))
        except Exception as exc:  # a failing check is a failed result
            yield (False, None, "fail", f"check raised {type(exc).__name__}: {exc}", None)


def run_user_check(name: str, r: dict, context: Column | None, user_checks=None) -> dict:
    """Result columns of the check ``name``. ``r``: the response columns; ``r['body']``, the
    text that ``json`` was parsed from, is passed on as it is where there is one."""
    fn = (user_checks or {}).get(name) or _CHECKS.get(name)
    null = F.lit(None).cast("string")
    body = r.get("body")
    fields = {k: r[k] for k in RESPONSE_FIELDS if r.get(k) is not None}
    fields["json"] = body if body is not None else F.to_json(r["json"])
    for k in ("latency_ms", "cost_usd"):
        if k in fields:
            fields[k] = fields[k].cast("double")
    response = F.struct(*[v.alias(k) for k, v in fields.items()])
    s = check_udf(fn, name)(response, context if context is not None else null)
    return {k: s[k] for k in ("passed", "score", "severity", "message", "evidence")}


# ---- an example user check: every finding names its article ---------------------------

def articles_named(response: dict, context: dict) -> dict:
    """Share of the findings in the body that name an article; all of them must."""
    body = response.get("json")
    rows = body.get("findings") if isinstance(body, dict) else None
    rows = [x for x in rows if isinstance(x, dict)] if isinstance(rows, list) else []
    named = sum(1 for x in rows if isinstance(x.get("article"), str) and x["article"])
    share = named / len(rows) if rows else 1.0
    return {"passed": named == len(rows), "score": share, "severity": "info" if named == len(rows) else "fail",
            "message": f"{named} of {len(rows)} findings name an article",
            "evidence": {"suite": context.get("suite")}}


def articles_named_native(body: Column) -> Column:
    """The same rule as a Column (no Python): the preferred form when expressible."""
    findings = F.filter(F.coalesce(F.try_variant_get(body, "$.findings", "array<variant>"),
                                   F.expr("cast(array() as array<variant>)")),
                        lambda f: f.try_cast("map<string,variant>").isNotNull())
    return F.forall(findings, lambda f: F.coalesce(
        (F.schema_of_variant(F.try_variant_get(f, "$.article", "variant")) == "STRING")
        & (F.try_variant_get(f, "$.article", "string") != ""), F.lit(False)))


register_check("articles_named", articles_named)


# ---- model providers (judge / target) --------------------------------------------------

def ask_judge(requests: DataFrame, provider: Callable[[pd.DataFrame], pd.Series],
              keys: list[str], samples: int = 1) -> DataFrame:
    """JDG-2 / UDF-3: ``samples`` requests per prompt, each answered by ``provider`` over Arrow
    batches; returns (keys, sample_no, verdict)."""
    if samples < 1:
        raise ValueError("samples is at least 1")
    exploded = requests.select(*keys, "prompt", F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("sample_no"))
    out_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in
                           exploded.schema.fields if f.name in keys) + ", sample_no int, verdict string"

    def batches(it):
        for pdf in it:
            res = pdf[[*keys, "sample_no"]].copy()
            res["verdict"] = provider(pdf).astype(object).values
            yield res
    return exploded.mapInPandas(batches, out_schema)
