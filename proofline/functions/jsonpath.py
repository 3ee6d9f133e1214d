"""JSON bodies as VARIANT, and JSONPath multi-match extraction as Columns.

A body is parsed once per response (``strict_json``); each distinct JSONPath used by
any check is compiled once into an ``array<variant>`` of matches. Missing members are
dropped, an explicit JSON ``null`` is kept as a match (a VARIANT null), which is what
counting checks such as ``field_present`` need.

Descendants reach every level: Spark itself parses values of up to ``NESTING`` levels.

Paths: names, quoted names, indexes, slices, wildcards (elements of an array, values of an
object), descendants (``..name``, ``..*``) and comparisons (``[?(@.a.b > 1)]``); the leading
``$.`` may be left out. Anything else raises when the path is compiled.
"""
from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofline.functions.columns import let

# Spark parses no JSON value with more levels than this.
NESTING = 1000

# One step of a path; also matched by Spark on paths that are data (see matches_by_data).
STEP = (r"""\.\.(?:[A-Za-z_][A-Za-z0-9_\-]*|\*)"""      # ..name  ..*
        r"""|\.?(?:[A-Za-z_][A-Za-z0-9_\-]*)"""         # .name, or name at the start
        r"""|\.?\*"""                                   # .*
        r"""|\[\s*\*\s*\]"""                            # [*]
        r"""|\[\s*-?\d+\s*\]"""                         # [3]
        r"""|\[\s*-?\d*\s*:\s*-?\d*\s*\]"""             # [1:3]
        r"""|\[\s*'[^']*'\s*\]|\[\s*"[^"]*"\s*\]"""     # ['name']
        )
_STEP = re.compile(STEP)
# A comparison: its three groups are the names, the operator and the value.
FILTER = (r"""\[\s*\?\s*\(?\s*@({g}(?:\.[A-Za-z_][A-Za-z0-9_\-]*)*)\s*({g}==|=|!=|>=|<=|>|<)\s*"""
          r"""({g}'[^']*'|"[^"]*"|-?\d+(?:\.\d+)?|true|false|null)\s*\)?\s*\]""")
_FILTER = re.compile(FILTER.format(g=""))


class PathError(ValueError):
    """A path outside the supported grammar."""


def parse_path(path: str) -> list[tuple[str, object]]:
    """Split a JSONPath into (kind, argument) steps; raises :class:`PathError`."""
    if not isinstance(path, str) or not path.strip():
        raise PathError(f"not a JSONPath: {path!r}")
    text = path.strip()
    pos, steps = (1 if text.startswith("$") else 0), []
    while pos < len(text):
        m = _FILTER.match(text, pos)
        if m:
            names = [n for n in m.group(1).split(".") if n]
            raw = m.group(3)
            value = raw[1:-1] if raw[0] in "'\"" else json.loads(raw)
            steps.append(("filter", (names, "==" if m.group(2) == "=" else m.group(2), value)))
            pos = m.end()
            continue
        m = _STEP.match(text, pos)
        if not m or (pos > 0 and m.group()[0] not in ".["):
            raise PathError(f"unsupported JSONPath: {path!r} at {text[pos:]!r}")
        t = m.group()
        inner = t[1:-1].strip() if t[0] == "[" else t.lstrip(".")
        if t.startswith(".."):
            steps.append(("descend", None))
        if inner == "*":
            steps.append(("all", None))
        elif t[0] != "[":
            steps.append(("key", inner))
        elif inner[0] in "'\"":
            steps.append(("key", inner[1:-1]))
        elif ":" in inner:
            lo, hi = (int(x) if x.strip() else None for x in inner.split(":"))
            steps.append(("slice", (lo, hi)))
        else:
            steps.append(("index", int(inner)))
        pos = m.end()
    return steps


def _key_path(name: str) -> str:
    return "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"


def no_variants() -> Column:
    return F.expr("cast(array() as array<variant>)")


def _elements(x: Column) -> Column:
    return F.coalesce(x.try_cast("array<variant>"), no_variants())


def _children(x: Column) -> Column:
    return F.coalesce(x.try_cast("array<variant>"), F.map_values(x.try_cast("map<string,variant>")), no_variants())


def levels_of(arr: Column) -> Column:
    """At least the number of levels of the values in ``arr``: their opening brackets (those
    inside strings only add to it), and no more than Spark parses."""
    def openers(x: Column) -> Column:
        text = F.to_json(x)
        return F.length(text) - F.length(F.translate(text, "[{", ""))
    return F.least(F.aggregate(arr, F.lit(0), lambda n, x: n + F.coalesce(openers(x), F.lit(0))), F.lit(NESTING))


def _descendants(arr: Column) -> Column:
    """Every value of ``arr`` and everything below it, level by level until one is empty."""
    def level(acc: Column, _: Column) -> Column:
        below = F.flatten(F.transform(acc["now"], _children))
        return F.when(F.size(acc["now"]) == 0, acc).otherwise(
            F.struct(F.concat(acc["all"], below).alias("all"), below.alias("now")))
    return let(arr, lambda a: F.aggregate(F.sequence(F.lit(0), levels_of(a)), F.struct(a.alias("all"), a.alias("now")),
                                          level, lambda acc: acc["all"]))


def _sliced(xs: Column, lo, hi) -> Column:
    n = F.size(xs)
    start = F.lit(0) if lo is None else F.lit(lo) if lo >= 0 else F.greatest(n + lo, F.lit(0))
    end = n if hi is None else F.least(F.lit(hi), n) if hi >= 0 else n + hi
    return F.when(end > start, F.slice(xs, start + 1, end - start)).otherwise(no_variants())


def _compared(x: Column, names: list[str], op: str, value) -> Column:
    for n in names:
        x = F.try_variant_get(x, _key_path(n), "variant")
    kind = F.schema_of_variant(x)
    if value is None:
        same = F.is_variant_null(x)
    elif isinstance(value, bool):
        same = (kind == "BOOLEAN") & (F.try_variant_get(x, "$", "boolean") == value)
    elif isinstance(value, str):
        v = F.try_variant_get(x, "$", "string")
        same = (kind == "STRING") & {"==": v == value, "!=": v == value, ">": v > value, "<": v < value,
                                     ">=": v >= value, "<=": v <= value}[op]
    else:
        v = F.try_variant_get(x, "$", "double")
        number = ~kind.isin("STRING", "BOOLEAN", "VOID") & ~kind.startswith("OBJECT") & ~kind.startswith("ARRAY")
        same = number & {"==": v == value, "!=": v == value, ">": v > value, "<": v < value,
                         ">=": v >= value, "<=": v <= value}[op]
    same = F.coalesce(same, F.lit(False))
    return (x.isNotNull() & ~same) if op == "!=" else same


def strict_json(text: Column) -> Column:
    """Parse a JSON document strictly: NULL unless the whole string is one value.

    ``try_parse_json`` accepts trailing garbage, so the text is wrapped in ``[...]``
    and must come back as a one-element array.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).try_cast("array<variant>")
    return F.when(F.size(wrapped) == 1, F.element_at(wrapped, 1))


def matches(body: Column, path: str) -> Column:
    """``array<variant>`` of every value ``path`` selects in ``body``."""
    arr = F.when(body.isNotNull(), F.array(body)).otherwise(no_variants())
    for kind, arg in parse_path(path):
        if kind == "all":
            arr = F.flatten(F.transform(arr, _children))
        elif kind == "descend":
            arr = _descendants(arr)
        elif kind == "slice":
            arr = F.flatten(F.transform(arr, _slicer(*arg)))
        elif kind == "filter":
            arr = F.filter(F.flatten(F.transform(arr, _children)), _comparer(*arg))
        else:
            arr = F.filter(F.transform(arr, _step(kind, arg)), lambda x: x.isNotNull())
    return arr


def _slicer(lo, hi):
    return lambda x: _sliced(_elements(x), lo, hi)


def _comparer(names, op, value):
    return lambda x: _compared(x, names, op, value)


def _step(kind: str, arg):
    """One-argument lambda taking a VARIANT to the value one step down (or NULL)."""
    if kind == "key":
        path = _key_path(arg)
        return lambda x: F.try_variant_get(x, path, "variant")
    if arg >= 0:
        path = f"$[{arg}]"
        return lambda x: F.try_variant_get(x, path, "variant")
    return lambda x: F.try_element_at(_elements(x), F.lit(arg))


# ---- paths that are data ---------------------------------------------------------------

def path_supported(path: Column) -> Column:
    """True for a path in the grammar of :func:`parse_path`."""
    return F.coalesce(path.rlike(r"^\s*(?:\$|[A-Za-z_][A-Za-z0-9_\-]*)(?:\.{1,2}(?:[A-Za-z_][A-Za-z0-9_\-]*|\*)"
                                 r"|\[\s*(?:\*|-?\d+|-?\d*\s*:\s*-?\d*|'[^']*'|\"[^\"]*\")\s*\]|"
                                 + FILTER.format(g="?:") + r")*\s*$"), F.lit(False))


def path_steps(path: Column) -> Column:
    """A path that is data as an array of steps, read once (of a checks table: once per check, not
    per response); NULL where it is not supported."""
    found = F.regexp_extract_all(F.regexp_replace(F.trim(path), r"^\$", ""),
                                 F.lit("(" + STEP + "|" + FILTER.format(g="?:") + ")"), 1)

    def read(s: Column) -> Column:
        inner = F.regexp_replace(F.regexp_replace(s, r"^\.{1,2}", ""), r"^\[\s*|\s*\]$", "")
        return let(inner, lambda t: F.struct(
            s.startswith("..").alias("down"),
            F.when(t == "*", "all").when(t.startswith("?"), "filter").when(t.rlike(r"^-?\d+$"), "index")
            .when(t.rlike(r"^-?\d*\s*:\s*-?\d*$"), "slice").otherwise("key").alias("kind"),
            F.regexp_replace(t, "^['\"]|['\"]$", "").alias("name"), t.try_cast("int").alias("i"),
            F.regexp_extract(t, r"^(-?\d*)", 1).try_cast("int").alias("lo"),
            F.regexp_extract(t, r"(-?\d*)$", 1).try_cast("int").alias("hi"),
            F.filter(F.split(F.regexp_extract(s, FILTER.format(g=""), 1), r"\."), lambda n: n != "").alias("names"),
            F.regexp_replace(F.regexp_extract(s, FILTER.format(g=""), 2), "^=$", "==").alias("op"),
            F.regexp_extract(s, FILTER.format(g=""), 3).alias("raw")))
    return F.when(path_supported(path), F.transform(found, read))


def _compared_by_step(x: Column, step: Column) -> Column:
    """:func:`_compared` for a step that is data."""
    at = F.aggregate(step["names"], x, lambda v, n: F.try_element_at(v.try_cast("map<string,variant>"), n))
    op, raw = step["op"], step["raw"]

    def by_op(a: Column, c: Column) -> Column:
        return F.when(op.isin("==", "!="), a == c).when(op == ">", a > c).when(op == "<", a < c).when(
            op == ">=", a >= c).when(op == "<=", a <= c)

    def judged(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        number = ~kind.isin("STRING", "BOOLEAN", "VOID") & ~kind.startswith("OBJECT") & ~kind.startswith("ARRAY")
        same = F.coalesce(
            F.when(raw == "null", F.is_variant_null(v))
            .when(raw.isin("true", "false"), (kind == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == (raw == "true")))
            .when(raw.rlike("^['\"]"), (kind == "STRING") & by_op(F.try_variant_get(v, "$", "string"),
                                                                 F.regexp_replace(raw, "^['\"]|['\"]$", "")))
            .otherwise(number & by_op(F.try_variant_get(v, "$", "double"), raw.try_cast("double"))), F.lit(False))
        return F.when(op == "!=", v.isNotNull() & ~same).otherwise(same)
    return let(at, judged)


def matches_by_steps(body: Column, steps: Column) -> Column:
    """Like :func:`matches` for a path read by :func:`path_steps`; NULL where that is."""
    def apply(arr: Column, step: Column) -> Column:
        return let(F.when(step["down"], _descendants(arr)).otherwise(arr), lambda a: taken(a, step))

    def taken(arr: Column, step: Column) -> Column:
        kind, i = step["kind"], step["i"]

        def one(x: Column) -> Column:
            xs = _elements(x)
            n = F.size(xs)
            lo, hi = F.coalesce(step["lo"], F.lit(0)), F.coalesce(step["hi"], n)
            lo = F.when(lo < 0, F.greatest(n + lo, F.lit(0))).otherwise(lo)
            hi = F.when(hi < 0, n + hi).otherwise(F.least(hi, n))
            at = F.when(i >= 0, i).otherwise(n + i)
            member = F.when(kind == "index", F.get(xs, F.when(at >= 0, at).otherwise(n))).otherwise(
                F.try_element_at(x.try_cast("map<string,variant>"), step["name"]))
            return (F.when(kind == "all", _children(x))
                    .when(kind == "filter", F.filter(_children(x), lambda v: _compared_by_step(v, step)))
                    .when(kind == "slice", F.when(hi > lo, F.slice(xs, lo + 1, F.greatest(hi - lo, F.lit(0)))).otherwise(no_variants()))
                    .otherwise(F.filter(F.array(member), lambda v: v.isNotNull())))
        return F.flatten(F.transform(arr, one))
    root = F.when(body.isNotNull(), F.array(body)).otherwise(no_variants())
    return F.when(steps.isNotNull(), F.aggregate(steps, root, apply))


def matches_by_data(body: Column, path: Column) -> Column:
    """Like :func:`matches` for a path that is a column; NULL where it is not supported."""
    return matches_by_steps(body, path_steps(path))


# ---- types -----------------------------------------------------------------------------

def variant_kind(v: Column) -> Column:
    """Coarse JSON type of a VARIANT: null/boolean/number/string/array/object.

    Containers are recognised by cast (cheap); ``schema_of_variant`` is only asked of
    scalars, where it does not have to describe a whole nested document.
    """
    sv = F.schema_of_variant(v)
    return (F.when(v.isNull(), F.lit(None))
            .when(F.is_variant_null(v), F.lit("null"))
            .when(v.try_cast("map<string,variant>").isNotNull(), F.lit("object"))
            .when(v.try_cast("array<variant>").isNotNull(), F.lit("array"))
            .when(sv == "BOOLEAN", F.lit("boolean"))
            .when(sv == "STRING", F.lit("string"))
            .otherwise(F.lit("number")))


def is_empty_value(v: Column) -> Column:
    """True for JSON null, "" and [] (the values a citation must not be): each prints as one
    short text, so one look at the printed value is enough."""
    return F.to_json(v).isin("null", '""', "[]") | F.is_variant_null(v)


def path_inventory(rows, body: str, depth: int | None = None):
    """SCL-11: (path, responses): every JSONPath below the root that occurs in a column of VARIANT
    bodies (to ``depth`` steps, if given), and in how many bodies. Levels are walked with arrays: a step
    takes each (path, value) to its members (``.key``) or elements (``[*]``)."""
    pair = "array<struct<path:string,value:variant>>"
    empty = F.expr(f"cast(array() as {pair})")

    def below(p: Column) -> Column:
        members = F.transform(F.map_entries(p["value"].try_cast("map<string,variant>")), lambda e: F.struct(
            F.concat(p["path"], F.lit("."), e["key"]).alias("path"), e["value"].alias("value")))
        elements = F.transform(p["value"].try_cast("array<variant>"), lambda v: F.struct(
            F.concat(p["path"], F.lit("[*]")).alias("path"), v.alias("value")))
        return F.coalesce(members, elements, empty)

    def step(acc: Column, _: Column) -> Column:
        found = F.flatten(F.transform(acc["now"], below))
        return F.when(F.size(acc["now"]) == 0, acc).otherwise(F.struct(
            F.array_union(acc["paths"], F.transform(found, lambda p: p["path"])).alias("paths"), found.alias("now")))
    start = F.struct(F.expr("cast(array() as array<string>)").alias("paths"), F.array(F.struct(
        F.lit("$").alias("path"), F.col(body).alias("value"))).alias("now"))
    bound = levels_of(F.array(F.col(body))) if depth is None else F.lit(depth - 1)
    paths = F.aggregate(F.sequence(F.lit(0), bound), start, step, lambda acc: acc["paths"])
    return rows.select(F.explode(paths).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("responses"))
