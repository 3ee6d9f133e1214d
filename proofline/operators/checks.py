"""The template checks (CHK-1..16) as Column builders.

Every builder takes the response columns ``r`` (``text`` string, ``json`` VARIANT,
``latency_ms`` double, ``cost_usd`` double), the check's parameters ``p`` (``params.Literal`` or
``params.Data``) and, for path-based checks, the ``array<variant>`` of matches of the check's
JSONPath. It returns a dict of Columns: ``passed``, ``severity``, ``message``, ``evidence``
(JSON text or NULL) and ``score`` (NULL for templates).
"""
from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofline.functions import jsonpath as jp
from proofline.functions.text import py_repr
from proofline.operators.params import INFINITY
from proofline.session import partitions_for

# ---- fixed values that must equal the reference's --------------------------------
# Default markers of the refusal detector (matched against the lowercased text;
# the markers themselves are not lowercased).
REFUSAL_MARKERS = ["i can't", "i cannot", "i'm unable", "cannot help", "not able to",
                   "i won't"]
# Personal-data patterns of pii_absent, in Python regex dialect, in report order.
PII_PATTERNS = {
    "email": r"[\w.+-]+@[\w-]+\.[\w.-]+",
    "iban": r"\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b",
    "card": r"\b(?:\d[ -]*?){13,16}\b",
}
# Names of the vetted templates.
TEMPLATES = ("valid_json", "json_schema", "contains", "not_contains", "regex_match",
             "numeric_bound", "latency_bound", "field_present", "citation_present",
             "refusal_detector", "pii_absent")
# Designed-only templates that this library also provides.
EXTRA_TEMPLATES = ("equals", "cost_bound", "enum_value", "length_bound")
# Templates whose parameters name a JSONPath in ``field``.
PATH_TEMPLATES = ("numeric_bound", "field_present", "citation_present", "equals",
                  "enum_value")
# -----------------------------------------------------------------------------------

REQUIRED_PARAMS = {
    "contains": ("value",), "not_contains": ("value",), "regex_match": ("pattern",),
    "numeric_bound": ("field",), "latency_bound": ("max_ms",), "field_present": ("field",),
    "citation_present": ("field",), "equals": ("field", "value"), "cost_bound": ("max_usd",),
    "enum_value": ("field", "values"),
}


@dataclass(frozen=True)
class Check:
    """One declared check (a row of the flattened spec)."""
    uses: str | None = None
    params: dict[str, Any] = field(default_factory=dict)
    type: str = "template"
    required: bool = True
    threshold: float | None = None
    judge: str | None = None
    rubric: str | None = None

    def validate(self) -> None:
        """Plan-time parameter validation (deviation D-1: bad params raise early)."""
        if self.type == "template" and self.uses in REQUIRED_PARAMS:
            missing = [k for k in REQUIRED_PARAMS[self.uses] if k not in self.params]
            if missing:
                raise KeyError(f"{self.uses}: missing parameter(s) {missing}")
        if self.uses == "json_schema" and not (self.params.get("schema") or
                                               self.params.get("schema_ref")):
            raise KeyError("json_schema: needs 'schema' or 'schema_ref'")


def _sev(ok: Column) -> Column:
    return F.when(ok, F.lit("info")).otherwise(F.lit("fail"))


def _result(ok, message, evidence=None, severity=None, score=None) -> dict:
    return {"passed": ok, "severity": severity if severity is not None else _sev(ok),
            "message": message,
            "evidence": evidence if evidence is not None else F.lit(None).cast("string"),
            "score": score if score is not None else F.lit(None).cast("double")}


def _text(r) -> Column:
    return F.coalesce(r["text"], F.lit(""))


def valid_json(r, p, m=None) -> dict:
    ok = r["json"].isNotNull() & ~F.coalesce(F.is_variant_null(r["json"]), F.lit(False))
    return _result(ok, F.when(ok, F.lit("response body is valid JSON"))
                   .otherwise(F.lit("response is not valid JSON")))


def contains(r, p, m=None) -> dict:
    needle = p.string("value")
    ok = F.contains(_text(r), needle)
    return _result(ok, F.concat(F.lit("text "), F.when(ok, F.lit("contains"))
                                .otherwise(F.lit("missing")), F.lit(": "), py_repr(needle)))


def not_contains(r, p, m=None) -> dict:
    needle = p.string("value")
    ok = ~F.contains(_text(r), needle)
    return _result(ok, F.concat(F.lit("forbidden string "), F.when(ok, F.lit("absent"))
                                .otherwise(F.lit("present")), F.lit(": "), py_repr(needle)))


def regex_match(r, p, m=None) -> dict:
    ok = F.regexp_like(_text(r), p.pattern("pattern"))
    return _result(ok, F.concat(F.lit("pattern "), F.when(ok, F.lit("matched"))
                                .otherwise(F.lit("no match")), F.lit(": "), py_repr(p.string("pattern"))))


def _number_text(v: Column) -> Column:
    kind = jp.variant_kind(v)
    return (F.when(kind == "boolean", F.when(F.try_variant_get(v, "$", "boolean"),
                                             F.lit("True")).otherwise(F.lit("False")))
            .when(kind == "string", F.try_variant_get(v, "$", "string"))
            .when(kind == "null", F.lit("None"))
            .otherwise(F.to_json(v)))


def numeric_bound(r, p, m) -> dict:
    fld = p.string("field")
    first = F.get(m, F.lit(0))
    is_num = ~F.schema_of_variant(first).isin("STRING", "VOID") & first.try_cast("double").isNotNull()
    v = F.try_variant_get(first, "$", "double")
    inside = is_num & (v >= p.number("min", -INFINITY)) & (v <= p.number("max", INFINITY))
    found = F.size(m) > 0
    vtxt = _number_text(first)
    msg = (F.when(~found, F.concat(F.lit("field not found: "), fld))
           .when(~is_num, F.concat(fld, F.lit("="), vtxt, F.lit(" is not a number")))
           .when(inside, F.concat(fld, F.lit("="), vtxt, F.lit(" within ["), p.shown("min", "-inf"),
                                  F.lit(","), p.shown("max", "inf"), F.lit("]")))
           .otherwise(F.concat(fld, F.lit("="), vtxt, F.lit(" out of bounds"))))
    return _result(found & F.coalesce(inside, F.lit(False)), msg)


def latency_bound(r, p, m=None) -> dict:
    v = F.coalesce(r["latency_ms"], F.lit(0.0))
    ok = v <= p.number("max_ms", INFINITY)
    msg = F.concat(F.lit("latency "), F.bround(v, 0).cast("long").cast("string"),
                   F.lit("ms "), F.when(ok, F.lit("<=")).otherwise(F.lit(">")),
                   F.lit(" "), p.shown("max_ms", "inf"), F.lit("ms"))
    return _result(ok, msg, evidence=F.to_json(F.struct(v.alias("latency_ms"))))


def field_present(r, p, m) -> dict:
    n = F.size(m)
    return _result(n >= p.number("min", 1), F.concat(n.cast("string"), F.lit(" match(es) for "), p.string("field")))


def citation_present(r, p, m) -> dict:
    kept = F.filter(m, lambda x: ~jp.is_empty_value(x))
    n = F.size(kept)
    ev = F.concat(F.lit('{"citations":['), F.array_join(
        F.transform(kept, lambda x: F.to_json(x)), ","), F.lit("]}"))
    return _result(n >= p.number("min", 1), F.concat(n.cast("string"), F.lit(" citation(s) found at "),
                                                     p.string("field")), evidence=ev)


def refusal_detector(r, p, m=None) -> dict:
    low = F.lower(_text(r))
    refused = F.exists(p.strings("markers", REFUSAL_MARKERS), lambda mk: F.contains(low, mk))
    want = p.flag("expect_refusal", True)
    pyb = lambda b: F.when(b, F.lit("True")).otherwise(F.lit("False"))
    return _result(refused == want, F.concat(F.lit("refusal="), pyb(refused), F.lit(", expected="), pyb(want)))


def pii_hits(text: Column) -> dict:
    """All hits of each personal-data class (Python-dialect patterns, Unicode classes)."""
    return {k: F.regexp_extract_all(text, F.lit("(?U)" + v), 0) for k, v in PII_PATTERNS.items()}


def pii_absent(r, p=None, m=None, hits: dict | None = None) -> dict:
    hits = hits or pii_hits(_text(r))
    found = F.map_filter(F.create_map(*[x for k, v in hits.items() for x in (F.lit(k), v)]),
                         lambda k, v: F.size(v) > 0)
    names = F.map_keys(found)
    ok = F.size(names) == 0
    msg = F.when(ok, F.lit("no PII detected")).otherwise(F.concat(
        F.lit("PII detected: ["),
        F.array_join(F.transform(names, lambda k: F.concat(F.lit("'"), k, F.lit("'"))), ", "),
        F.lit("]")))
    return _result(ok, msg, evidence=F.to_json(found))


# ---- designed-only templates -----------------------------------------------------

def equals(r, p, m) -> dict:
    ok = F.coalesce(F.to_json(F.get(m, F.lit(0))) == p.json_value("value"), F.lit(False))
    return _result(ok, F.concat(p.string("field"), F.when(ok, F.lit(" equals expected"))
                                .otherwise(F.lit(" differs from expected"))))


def cost_bound(r, p, m=None) -> dict:
    v = F.coalesce(r["cost_usd"], F.lit(0.0))
    ok = v <= p.number("max_usd", INFINITY)
    return _result(ok, F.concat(F.lit("cost "), F.format_string("%.6f", v),
                                F.when(ok, F.lit(" <= ")).otherwise(F.lit(" > ")), p.shown("max_usd", "inf")))


def enum_value(r, p, m) -> dict:
    allowed = p.json_values("values")
    ok = (F.size(m) > 0) & F.forall(m, lambda x: F.array_contains(allowed, F.to_json(x)))
    return _result(F.coalesce(ok, F.lit(False)),
                   F.concat(F.size(m).cast("string"), F.lit(" value(s) checked at "), p.string("field")))


def length_bound(r, p, m=None) -> dict:
    n = F.length(_text(r))
    ok = (n >= p.number("min", 0)) & (n <= p.number("max", INFINITY))
    return _result(ok, F.concat(F.lit("length "), n.cast("string"),
                                F.when(ok, F.lit(" within bounds")).otherwise(F.lit(" out of bounds"))))


def unresolved_citations(results, field_matches: Column, keys: list[str], corpus, ref: str = "ref"):
    """CHK-14: (keys, citation) of every cited reference that the corpus (a table with column
    ``ref``) does not hold. A cited reference is compared as text; empty ones cite nothing. The corpus is the side
    kept in memory, so a reference that many cite is only read through; what stays is made distinct in as many
    partitions as its rows need."""
    spark = results.sparkSession
    n = partitions_for(spark, 2 * results.count())
    value = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))
    texts = F.transform(F.filter(field_matches, lambda x: ~jp.is_empty_value(x)), value)
    cited = results.select(*keys, F.explode(F.array_distinct(texts)).alias("citation"))
    known = corpus.select(F.col(ref).alias("citation")).distinct()
    left = cited.join(known.hint("shuffle_hash"), "citation", "left_anti").select(*keys, "citation")
    return left.repartition(n, *keys, "citation").distinct()


BUILDERS = {
    "valid_json": valid_json, "contains": contains, "not_contains": not_contains,
    "regex_match": regex_match, "numeric_bound": numeric_bound,
    "latency_bound": latency_bound, "field_present": field_present,
    "citation_present": citation_present, "refusal_detector": refusal_detector,
    "pii_absent": pii_absent, "equals": equals, "cost_bound": cost_bound,
    "enum_value": enum_value, "length_bound": length_bound,
}
