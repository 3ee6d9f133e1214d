"""JSON Schema compiled, at plan time, into Column predicates over VARIANT.

Supported keywords: type (name or list), required, properties, patternProperties, propertyNames,
additionalProperties, minProperties, maxProperties, dependentRequired, dependentSchemas, items
(one schema, a list of them, or a boolean), prefixItems, additionalItems, contains, minContains,
maxContains, uniqueItems, enum, const, minimum, maximum, exclusiveMinimum, exclusiveMaximum
(number, or boolean beside minimum/maximum), multipleOf, minLength, maxLength, pattern, minItems,
maxItems, allOf, anyOf, oneOf, not, if/then/else, and $ref into the schema itself ("#", "#/..."). Any
other validation keyword raises at plan time, so a schema is never half-checked.

``compile_schema`` answers valid or not, with one cheap type test per node; ``violations``
explains, and is only evaluated for bodies that are not valid.

References that do not lead back to themselves are put in place. A recursive schema (a tree whose
children are trees) has no finite expression over the body, so it is judged from the leaves
upwards: the body is cut into its levels, and from the last level to the first every value gets
one flag per schema node that some parent asks its children for, read off the flags of its own
children. That is as many steps as the body has levels, in one row, without a join.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofline.functions import jsonpath as jp
from proofline.functions.columns import let
from proofline.functions.regex import to_java
from proofline.functions.text import py_repr
from proofline.operators.params import compact

_ANNOTATIONS = {"$schema", "$id", "id", "title", "description", "default", "examples",
                "$comment", "format", "definitions", "$defs"}
_SUPPORTED = {"type", "required", "properties", "patternProperties", "propertyNames", "additionalProperties",
              "minProperties", "maxProperties", "dependentRequired", "dependentSchemas", "items",
              "prefixItems", "additionalItems", "contains", "minContains", "maxContains", "uniqueItems",
              "enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf",
              "minLength", "maxLength", "pattern", "minItems", "maxItems", "allOf", "anyOf", "oneOf", "not",
              "if", "then", "else"} | _ANNOTATIONS
# Keywords that hold schemas: of the same value, and of its members or elements.
_HERE_LISTS, _HERE, _BELOW_LISTS = ("allOf", "anyOf", "oneOf"), ("not", "if", "then", "else"), ("prefixItems",)
_BELOW = ("items", "additionalItems", "contains", "additionalProperties", "propertyNames")
_BELOW_MAPS, _HERE_MAPS = ("properties", "patternProperties"), ("dependentSchemas",)


def _check(schema) -> None:
    if not isinstance(schema, (dict, bool)):
        raise ValueError(f"not a JSON schema: {schema!r}")
    if isinstance(schema, dict) and (unknown := set(schema) - _SUPPORTED):
        raise ValueError(f"unsupported JSON-Schema keyword(s): {sorted(unknown)}")


# ---- references ----------------------------------------------------------------------------

def _target(root, ref: str):
    """The schema that a local reference names."""
    if not isinstance(ref, str) or not (ref == "#" or ref.startswith("#/")):
        raise ValueError(f"only references into the schema itself are supported: {ref!r}")
    at = root
    for part in ref.split("/")[1:]:
        part = part.replace("~1", "/").replace("~0", "~")
        try:
            at = at[int(part)] if isinstance(at, list) else at[part]
        except (KeyError, IndexError, ValueError, TypeError):
            raise ValueError(f"reference to nothing: {ref!r}") from None
    return at


def _mapped(schema, fn):
    """The schema with ``fn`` applied to the schemas directly inside it."""
    if not isinstance(schema, dict):
        return schema
    out = {}
    for k, v in schema.items():
        if k in _BELOW_MAPS + _HERE_MAPS and isinstance(v, dict):
            v = {n: fn(x) for n, x in v.items()}
        elif k in _HERE_LISTS + _BELOW_LISTS or (k == "items" and isinstance(v, list)):
            v = [fn(x) for x in v]
        elif k in _HERE + _BELOW:
            v = fn(v)
        out[k] = v
    return out


def _deref(schema, root, one):
    """``schema`` with ``$ref`` in it replaced through ``one(reference)``, beside its other keywords."""
    if not isinstance(schema, dict) or "$ref" not in schema:
        return schema
    rest = {k: v for k, v in schema.items() if k != "$ref"}
    target = one(schema["$ref"])
    return {**rest, "allOf": [target, *rest.get("allOf", [])]} if set(rest) - _ANNOTATIONS else target


def resolved(schema):
    """The schema without references, or None if one leads back to itself."""
    def put(node, root, open_refs: tuple[str, ...]):
        def one(ref):
            if ref in open_refs:
                raise RecursionError(ref)
            return put(_target(root, ref), root, (*open_refs, ref))
        if isinstance(node, dict) and "$ref" in node:
            inner = {k: v for k, v in node.items() if k != "$ref"}
            return _deref({**_mapped(inner, lambda x: put(x, root, open_refs)), "$ref": node["$ref"]}, root, one)
        return _mapped(node, lambda x: put(x, root, open_refs))
    try:
        return put(schema, schema, ("#",))
    except RecursionError:
        return None


def _is(v: Column, name: str) -> Column:
    if name == "object":
        return v.try_cast("map<string,variant>").isNotNull()
    if name == "array":
        return v.try_cast("array<variant>").isNotNull()
    if name == "null":
        return F.is_variant_null(v)
    kind = F.schema_of_variant(v)
    if name == "string":
        return kind == "STRING"
    if name == "boolean":
        return kind == "BOOLEAN"
    number = ~kind.isin("STRING", "BOOLEAN", "VOID") & ~kind.startswith("OBJECT") & ~kind.startswith("ARRAY")
    if name == "number":
        return number
    if name == "integer":
        d = F.try_variant_get(v, "$", "double")
        return number & (d == F.floor(d))
    raise ValueError(f"unknown JSON-Schema type {name!r}")


def _any(conds: list[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def _types(schema) -> list[str]:
    return schema["type"] if isinstance(schema["type"], list) else [schema["type"]]


def _bounds(schema) -> list[tuple[str, float]]:
    """(operator a valid number satisfies, limit)."""
    out = []
    for key, op, strict in (("minimum", ">=", ">"), ("maximum", "<=", "<")):
        ex = schema.get("exclusiveMinimum" if key == "minimum" else "exclusiveMaximum")
        if key in schema:
            out.append((strict if ex is True else op, schema[key]))
        if ex is not None and not isinstance(ex, bool):
            out.append((strict, ex))
    return out


def _holds(a: Column, op: str, limit: float) -> Column:
    b = F.lit(float(limit))
    return {">=": a >= b, ">": a > b, "<=": a <= b, "<": a < b}[op]


def _let(value: Column, fn) -> Column:
    """Bind ``value`` once and evaluate the boolean ``fn`` of it.

    Catalyst does not share sub-expressions inside lambdas, and a schema refers to the
    same node many times; binding through a one-element ``forall`` keeps the compiled
    expression linear in the size of the schema instead of exponential in its depth.
    """
    return F.forall(F.array(value), fn)


def _member(v: Column, name: str) -> Column:
    return F.try_variant_get(v, jp._key_path(name), "variant")


def compile_schema(schema, v: Column, missing_ok: bool = False) -> Column:
    """Boolean Column: ``v`` (a VARIANT) is valid under ``schema``.

    With ``missing_ok`` a SQL NULL (an absent member) is valid; otherwise it is not.
    """
    flat = resolved(schema)
    if flat is None:
        valid = _recursive(schema, v)
        return v.isNull() | valid if missing_ok else v.isNotNull() & valid
    return _compiled(flat, v, missing_ok)


def _compiled(schema, v: Column, missing_ok: bool = False) -> Column:
    _check(schema)
    if schema is False:
        return v.isNull() if missing_ok else F.lit(False)
    if schema is True or not set(schema) - _ANNOTATIONS:
        return F.lit(True) if missing_ok else v.isNotNull()

    def bound(x: Column) -> Column:
        valid = F.coalesce(_valid(schema, x, _Direct(x)), F.lit(False))
        return x.isNull() | valid if missing_ok else x.isNotNull() & valid
    return F.coalesce(_let(v, bound), F.lit(False))


class _Direct:
    """A value's members and elements, judged by compiling their schemas in place."""

    def __init__(self, v: Column):
        self.v, self.arr, self.map = v, v.try_cast("array<variant>"), v.try_cast("map<string,variant>")
        self.keys = F.map_keys(self.map)

    def here(self, schema) -> Column:
        return _compiled(schema, self.v)

    def n_elements(self) -> Column:
        return F.size(self.arr)

    def element(self, i: int, schema) -> Column:
        return _compiled(schema, F.get(self.arr, F.lit(i)), missing_ok=True)

    def every_element(self, schema, start: int) -> Column:
        rest = self.arr if not start else F.slice(self.arr, start + 1, F.greatest(F.size(self.arr) - start, F.lit(0)))
        return F.forall(rest, lambda x: _compiled(schema, x))

    def count_elements(self, schema) -> Column:
        return F.size(F.filter(self.arr, lambda x: _compiled(schema, x)))

    def member(self, name: str, schema, missing_ok: bool) -> Column:
        return _compiled(schema, _member(self.v, name), missing_ok)

    def has(self, name: str) -> Column:
        return _member(self.v, name).isNotNull()

    def every_member(self, of, schema) -> Column:
        return F.forall(F.filter(self.keys, of), lambda k: _compiled(schema, F.element_at(self.map, k)))


def _valid(schema, v: Column, below) -> Column:
    """Every keyword of ``schema`` holds for ``v``; ``below`` judges its members and elements."""
    conds: list[Column] = []
    kinds = _types(schema) if "type" in schema else []

    def only(name: str, cond: Column) -> Column:
        """``cond`` for values of one type; other types pass here (or fail by ``type``)."""
        return cond if kinds == [name] else ~_is(v, name) | cond
    if kinds:
        conds.append(_any([_is(v, n) for n in kinds]))
    if "enum" in schema:
        conds.append(F.to_json(v).isin([compact(x) for x in schema["enum"]]))
    if "const" in schema:
        conds.append(F.to_json(v) == compact(schema["const"]))
    number = F.try_variant_get(v, "$", "double")
    for op, limit in _bounds(schema):
        conds.append(only("number", _holds(number, op, limit)))
    if "multipleOf" in schema:
        times = number / F.lit(float(schema["multipleOf"]))
        conds.append(only("number", times == F.floor(times)))
    s = F.try_variant_get(v, "$", "string")
    if "minLength" in schema:
        conds.append(only("string", F.length(s) >= schema["minLength"]))
    if "maxLength" in schema:
        conds.append(only("string", F.length(s) <= schema["maxLength"]))
    if "pattern" in schema:
        conds.append(only("string", s.rlike("(?U)" + to_java(schema["pattern"]))))
    conds += [only("array", c) for c in _of_array(schema, v, below)]
    conds += [only("object", c) for c in _of_object(schema, below)]
    conds += [below.here(sub) for sub in schema.get("allOf", [])]
    if "anyOf" in schema:
        conds.append(_any([below.here(sub) for sub in schema["anyOf"]]))
    if "oneOf" in schema:
        conds.append(sum((F.when(below.here(sub), 1).otherwise(0) for sub in schema["oneOf"]), F.lit(0)) == 1)
    if "not" in schema:
        conds.append(~below.here(schema["not"]))
    if "if" in schema:
        conds.append(F.when(below.here(schema["if"]), below.here(schema.get("then", True))).otherwise(
            below.here(schema.get("else", True))))
    out = F.lit(True)
    for c in conds:
        out = out & c
    return out


def _of_array(schema, v: Column, below) -> list[Column]:
    conds, n = [], below.n_elements()
    if "minItems" in schema:
        conds.append(n >= schema["minItems"])
    if "maxItems" in schema:
        conds.append(n <= schema["maxItems"])
    if schema.get("uniqueItems"):
        printed = F.transform(v.try_cast("array<variant>"), lambda x: F.to_json(x))
        conds.append(F.size(F.array_distinct(printed)) == n)
    listed = schema["items"] if isinstance(schema.get("items"), list) else None
    first = schema.get("prefixItems", listed or [])
    conds += [below.element(i, sub) for i, sub in enumerate(first)]
    rest = schema.get("additionalItems", True) if listed is not None else schema.get("items", True)
    if rest is False:
        conds.append(n <= len(first))
    elif rest is not True:
        conds.append(below.every_element(rest, len(first)))
    if "contains" in schema:
        hits = below.count_elements(schema["contains"])
        conds.append(hits >= schema.get("minContains", 1))
        if "maxContains" in schema:
            conds.append(hits <= schema["maxContains"])
    return conds


def _matching(patterns) -> list[str]:
    return ["(?U)" + to_java(p) for p in patterns]


def _of_object(schema, below) -> list[Column]:
    props, patterns = schema.get("properties") or {}, schema.get("patternProperties") or {}
    conds = [below.has(n) for n in schema.get("required", []) if n not in props]
    for name, sub in props.items():
        # a required property is looked up once: it must be there and valid
        conds.append(below.member(name, sub, missing_ok=name not in schema.get("required", [])))
    for pattern, sub in patterns.items():
        conds.append(below.every_member(_key_like(pattern), sub))
    if schema.get("additionalProperties", True) is not True:
        conds.append(below.every_member(_key_beside(props, patterns), schema["additionalProperties"]))
    if "propertyNames" in schema:
        names = F.transform(below.keys, lambda k: F.try_parse_json(F.regexp_replace(F.to_json(F.array(k)), r"^\[|\]$", "")))
        conds.append(F.forall(names, lambda x: _compiled(_names_only(schema["propertyNames"]), x)))
    if "minProperties" in schema:
        conds.append(F.size(below.keys) >= schema["minProperties"])
    if "maxProperties" in schema:
        conds.append(F.size(below.keys) <= schema["maxProperties"])
    for name, needed in (schema.get("dependentRequired") or {}).items():
        conds += [~below.has(name) | below.has(n) for n in needed]
    for name, sub in (schema.get("dependentSchemas") or {}).items():
        conds.append(~below.has(name) | below.here(sub))
    return conds


def _names_only(schema):
    flat = resolved(schema)
    if flat is None:
        raise ValueError("propertyNames cannot be recursive")
    return flat


def _key_like(pattern: str):
    return lambda k: k.rlike(_matching([pattern])[0])


def _key_beside(props, patterns):
    """Keys that neither ``properties`` nor ``patternProperties`` speak of."""
    def beside(k: Column) -> Column:
        out = ~k.isin(list(props)) if props else F.lit(True)
        for p in _matching(patterns):
            out = out & ~k.rlike(p)
        return out
    return beside


# ---- recursive schemas ---------------------------------------------------------------------

_NODE = "struct<value:variant,names:array<string>,first:int,n:int>"


def _body_levels(v: Column) -> Column:
    """array<array<node>>: the values of a body level by level; a node knows the names of its
    members and where its children start in the next level."""
    def cut(now: Column) -> Column:
        def offsets(sizes: Column) -> Column:
            start = F.struct(F.expr("cast(array() as array<int>)").alias("out"), F.lit(0).alias("at"))
            return F.aggregate(sizes, start, lambda a, n: F.struct(
                F.concat(a["out"], F.array(a["at"])).alias("out"), (a["at"] + n).alias("at")), lambda a: a["out"])

        def nodes(b: Column) -> Column:
            return F.transform(now, lambda x, i: F.struct(
                x.alias("value"), F.map_keys(x.try_cast("map<string,variant>")).alias("names"),
                F.get(b["first"], i).alias("first"), F.get(b["n"], i).alias("n")))
        return let(F.transform(now, lambda x: F.size(jp._children(x))),
                   lambda n: let(F.struct(offsets(n).alias("first"), n.alias("n")), nodes))

    def step(acc: Column, _: Column) -> Column:
        below = F.flatten(F.transform(acc["now"], jp._children))
        return F.when(F.size(acc["now"]) == 0, acc).otherwise(F.struct(
            F.concat(acc["levels"], F.array(cut(acc["now"]))).alias("levels"), below.alias("now")))
    start = F.struct(F.expr(f"cast(array() as array<array<{_NODE}>>)").alias("levels"), F.array(v).alias("now"))
    return F.aggregate(F.sequence(F.lit(0), jp.levels_of(F.array(v)) + 1), start, step, lambda a: a["levels"])


class _Flags:
    """A node's members and elements, judged by the flags that their own level got."""

    def __init__(self, schemas: _Schemas, flags: Column, node: Column, open_refs: tuple[str, ...] = ()):
        self.schemas, self.flags, self.node, self.open_refs = schemas, flags, node, open_refs
        self.keys = node["names"]
        self.own = F.slice(flags, node["first"] + 1, node["n"])

    def here(self, schema) -> Column:
        """The same value under another schema: in place; a reference may not come back here."""
        refs = self.open_refs
        if isinstance(schema, dict) and "$ref" in schema:
            if schema["$ref"] in refs:
                raise ValueError(f"{schema['$ref']!r} refers to itself for the same value")
            refs = (*refs, schema["$ref"])
            schema = _deref(schema, self.schemas.root, lambda ref: _target(self.schemas.root, ref))
            return _Flags(self.schemas, self.flags, self.node, refs).here(schema)
        _check(schema)
        if isinstance(schema, bool):
            return F.lit(schema)
        return F.coalesce(_valid(schema, self.node["value"], self), F.lit(False))

    def n_elements(self) -> Column:
        return self.node["n"]

    def element(self, i: int, schema) -> Column:
        return F.coalesce(F.get(F.get(self.own, F.lit(i)), F.lit(self.schemas.number(schema))), F.lit(True))

    def every_element(self, schema, start: int) -> Column:
        k = self.schemas.number(schema)
        rest = self.own if not start else F.slice(self.own, start + 1, F.greatest(self.node["n"] - start, F.lit(0)))
        return F.forall(rest, lambda x: F.get(x, F.lit(k)))

    def count_elements(self, schema) -> Column:
        k = self.schemas.number(schema)
        return F.size(F.filter(self.own, lambda x: F.get(x, F.lit(k))))

    def member(self, name: str, schema, missing_ok: bool) -> Column:
        at = F.array_position(self.keys, name).cast("int")
        flag = F.get(F.get(self.own, at - 1), F.lit(self.schemas.number(schema)))
        return F.when(F.coalesce(at, F.lit(0)) == 0, F.lit(missing_ok)).otherwise(flag)

    def has(self, name: str) -> Column:
        return F.array_contains(self.keys, name)

    def every_member(self, of, schema) -> Column:
        k = self.schemas.number(schema)
        return F.forall(F.zip_with(self.keys, self.own, lambda name, x: ~of(name) | F.get(x, F.lit(k))), lambda ok: ok)


class _Schemas:
    """The schema nodes that children are judged by, numbered as they are met."""

    def __init__(self, root):
        self.root, self.nodes, self.numbers = root, [], {}
        self.number(root)

    def number(self, schema) -> int:
        key = compact(schema)
        if key not in self.numbers:
            self.numbers[key] = len(self.nodes)
            self.nodes.append(schema)
        return self.numbers[key]

    def flags(self, flags: Column, node: Column) -> Column:
        """array<boolean>: one flag per schema node; compiling one may number further ones."""
        out = []
        while len(out) < len(self.nodes):
            out.append(_Flags(self, flags, node).here(self.nodes[len(out)]))
        return F.array(*out)


def _recursive(schema, v: Column) -> Column:
    schemas = _Schemas(schema)

    def judged(levels: Column) -> Column:
        none = F.expr("cast(array() as array<array<boolean>>)")
        top = F.aggregate(F.reverse(levels), none, lambda flags, level: F.transform(
            level, lambda node: schemas.flags(flags, node)))
        return F.get(F.get(top, F.lit(0)), F.lit(0))
    return F.coalesce(F.when(v.isNotNull(), let(_body_levels(v), judged)), F.lit(False))


# ---- explanations --------------------------------------------------------------------------

def _shown(v: Column) -> Column:
    """A JSON value as Python prints it (containers as their JSON text)."""
    kind = F.schema_of_variant(v)
    return (F.when(F.is_variant_null(v), "None").when(kind == "STRING", py_repr(F.try_variant_get(v, "$", "string")))
            .when(kind == "BOOLEAN", F.when(F.try_variant_get(v, "$", "boolean"), "True").otherwise("False"))
            .otherwise(F.to_json(v)))


def _alone(schema, v: Column, *keys: str) -> Column:
    """A few keywords of a schema by themselves."""
    return _compiled({k: schema[k] for k in keys if k in schema}, v)


def violations(schema, v: Column, path: Column | None = None) -> Column:
    """array<struct<path, message>>: the keywords of ``schema`` that ``v`` breaks, outer ones
    first; path: JSON text of keys and indexes, without the brackets. A recursive schema is not
    explained."""
    schema = resolved(schema)
    if schema is None:
        return F.expr("cast(array() as array<struct<path:string,message:string>>)")
    _check(schema)
    path = F.lit("") if path is None else path
    return let(F.struct(v.alias("v"), path.alias("p")), lambda b: _violations(schema, b["v"], b["p"]))


def _violations(schema, v: Column, path: Column) -> Column:
    none = F.expr("cast(array() as array<struct<path:string,message:string>>)")
    if schema is True:
        return none

    def one(ok: Column, message: Column) -> Column:
        return F.when(F.coalesce(ok, F.lit(False)), none).otherwise(
            F.array(F.struct(path.alias("path"), message.alias("message"))))

    def at(step: Column) -> Column:
        return F.concat(path, F.when(path == "", "").otherwise(","), step)
    if schema is False:
        return one(v.isNull(), F.concat(F.lit("False schema does not allow "), _shown(v)))
    parts: list[Column] = []
    shown = _shown(v)
    if "type" in schema:
        parts.append(one(_any([_is(v, n) for n in _types(schema)]), F.concat(
            shown, F.lit(" is not of type " + ", ".join(repr(n) for n in _types(schema))))))
    if "enum" in schema:
        parts.append(one(F.to_json(v).isin([compact(x) for x in schema["enum"]]),
                         F.concat(shown, F.lit(f" is not one of {schema['enum']!r}"))))
    if "const" in schema:
        parts.append(one(F.to_json(v) == compact(schema["const"]), F.lit(f"{schema['const']!r} was expected")))
    words = {">=": "less than the minimum of", ">": "less than or equal to the minimum of",
             "<=": "greater than the maximum of", "<": "greater than or equal to the maximum of"}
    for op, limit in _bounds(schema):
        parts.append(one(~_is(v, "number") | _holds(F.try_variant_get(v, "$", "double"), op, limit),
                         F.concat(shown, F.lit(f" is {words[op]} {limit}"))))
    s, is_str = F.try_variant_get(v, "$", "string"), _is(v, "string")
    arr, is_arr = v.try_cast("array<variant>"), _is(v, "array")
    for key, cond, text in (("minLength", lambda n: ~is_str | (F.length(s) >= n), " is too short"),
                            ("maxLength", lambda n: ~is_str | (F.length(s) <= n), " is too long"),
                            ("minItems", lambda n: ~is_arr | (F.size(arr) >= n), " is too short"),
                            ("maxItems", lambda n: ~is_arr | (F.size(arr) <= n), " is too long")):
        if key in schema:
            parts.append(one(cond(schema[key]), F.concat(shown, F.lit(text))))
    if "pattern" in schema:
        parts.append(one(~is_str | s.rlike("(?U)" + to_java(schema["pattern"])),
                         F.concat(shown, F.lit(f" does not match {schema['pattern']!r}"))))
    is_obj = _is(v, "object")
    for name in schema.get("required", []):
        parts.append(one(~is_obj | _member(v, name).isNotNull(), F.lit(f"{name!r} is a required property")))
    if schema.get("additionalProperties", True) is not True:
        parts.append(one(~is_obj | _alone(schema, v, "additionalProperties", "properties", "patternProperties"),
                         F.lit("additional properties are not allowed or not valid")))
    if "multipleOf" in schema:
        parts.append(one(_alone(schema, v, "multipleOf"), F.concat(shown, F.lit(f" is not a multiple of {schema['multipleOf']}"))))
    for name, needed in (schema.get("dependentRequired") or {}).items():
        for n in needed:
            parts.append(one(~is_obj | _member(v, name).isNull() | _member(v, n).isNotNull(),
                             F.lit(f"{n!r} is a dependency of {name!r}")))
    for keys, text in ((("uniqueItems",), " has non-unique elements"), (("minProperties",), " does not have enough properties"),
                       (("maxProperties",), " has too many properties"), (("propertyNames",), " has a name that is not valid"),
                       (("contains", "minContains", "maxContains"), " does not contain as many valid items as it must"),
                       (("patternProperties",), " is not valid under 'patternProperties'"),
                       (("dependentSchemas",), " is not valid under 'dependentSchemas'"),
                       (("if", "then", "else"), " is not valid under 'if'")):
        if keys[0] in schema:
            parts.append(one(_alone(schema, v, *keys), F.concat(shown, F.lit(text))))
    for key in ("allOf", "anyOf", "oneOf", "not"):
        if key in schema:
            parts.append(one(_alone(schema, v, key), F.concat(shown, F.lit(f" is not valid under {key!r}"))))

    def member(name: str, sub):
        return let(_member(v, name), lambda m: F.when(
            m.isNotNull(), violations(sub, m, at(F.lit(compact(name))))).otherwise(none))
    for name, sub in (schema.get("properties") or {}).items():
        parts.append(F.when(is_obj, member(name, sub)).otherwise(none))
    items = schema.get("items", True)
    first, rest = (items, schema.get("additionalItems", True)) if isinstance(items, list) else ([], items)
    first = schema.get("prefixItems", first)
    for i, sub in enumerate(first):
        x = F.get(arr, F.lit(i))
        parts.append(F.when(x.isNotNull(), violations(sub, x, at(F.lit(str(i))))).otherwise(none))
    if rest is not True:
        parts.append(F.coalesce(F.flatten(F.transform(arr, lambda x, i: F.when(
            i >= len(first), violations(rest, x, at(i.cast("string")))).otherwise(none))), none))
    return F.concat(*parts) if parts else none


def has_body(body: Column) -> Column:
    return body.isNotNull() & ~F.coalesce(F.is_variant_null(body), F.lit(False))


def valid_body(body: Column, schema) -> Column:
    """CHK-2's flag: no body fails; otherwise the body must validate against the schema."""
    return has_body(body) & compile_schema(schema, body)


def explained(body: Column, ok: Column, first: Column) -> dict:
    """CHK-2's result from its flag and the first violation (NULL if valid): message and evidence
    path are those of that violation."""
    msg = (F.when(~has_body(body), F.lit("no JSON body to validate")).when(ok, F.lit("matches schema"))
           .otherwise(F.coalesce(first["message"], F.lit("does not match schema"))))
    evidence = F.when(first.isNotNull(), F.concat(F.lit('{"path":['), first["path"], F.lit("]}")))
    return {"passed": ok, "severity": F.when(ok, F.lit("info")).otherwise(F.lit("fail")), "message": msg,
            "evidence": evidence, "score": F.lit(None).cast("double")}


def json_schema(r, schema) -> Column:
    """CHK-2 as one struct (passed, severity, message, evidence), for a branch of a larger
    expression: the body is judged once, violations are looked for in bodies that fail only."""
    body = r["json"]

    def judged(ok: Column) -> Column:
        first = F.when(has_body(body) & ~ok, F.get(violations(schema, body), F.lit(0)))
        return let(F.struct(ok.alias("ok"), first.alias("first")), lambda b: F.struct(*[
            c.alias(k) for k, c in explained(body, b["ok"], b["first"]).items() if k != "score"]))
    return let(valid_body(body, schema), judged)


def result_fields(result: Column) -> dict:
    """A result struct as the dict of Columns that the other builders return."""
    return {k: result[k] for k in ("passed", "severity", "message", "evidence")} | {"score": F.lit(None).cast("double")}
