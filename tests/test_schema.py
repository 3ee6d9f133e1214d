"""JSON Schema keyword by keyword, references and recursion against plain Python."""
import json
import random

import pytest
from pyspark.sql import functions as F

from proofline.functions import jsonpath as jp
from proofline.operators.jsonschema import compile_schema, resolved, violations

GOLDEN = [
    ({"multipleOf": 3}, ["9", "0", "-6", '"x"'], ["10", "1.5"]), ({"multipleOf": 0.5}, ["1.5", "2"], ["1.2"]),
    ({"uniqueItems": True}, ["[1,2]", "[]", '[{"a":1},{"a":2}]', "3"], ["[1,1]", '[{"a":1,"b":2},{"b":2,"a":1}]']),
    ({"contains": {"type": "string"}}, ['[1,"a"]', "{}"], ["[]", "[1]"]),
    ({"contains": {"type": "integer"}, "minContains": 2, "maxContains": 3}, ["[1,2]", "[1,2,3]"], ["[1]", "[1,2,3,4]"]),
    ({"contains": {}, "minContains": 0}, ["[]"], []),
    ({"prefixItems": [{"type": "string"}, {"minimum": 2}], "items": {"type": "null"}}, ['["a",2,null]', '["a"]', "[]"], ["[1]", '["a",1]', '["a",2,3]']),
    ({"items": [{"type": "string"}], "additionalItems": False}, ['["a"]', "[]"], ['["a",1]', "[1]"]),
    ({"patternProperties": {"^n_": {"type": "integer"}}, "additionalProperties": False}, ['{"n_a":1}', "{}", "[]"], ['{"n_a":"x"}', '{"b":1}']),
    ({"patternProperties": {"^n": {"minimum": 1}}, "additionalProperties": {"type": "string"}}, ['{"n":1,"s":"x"}'], ['{"n":0}', '{"s":1}']),
    ({"propertyNames": {"pattern": "^[a-z]+$", "maxLength": 3}}, ['{"abc":1}', "{}"], ['{"abcd":1}', '{"A":1}']),
    ({"minProperties": 1, "maxProperties": 2}, ['{"a":1}', "[]"], ["{}", '{"a":1,"b":2,"c":3}']),
    ({"dependentRequired": {"a": ["b", "c"]}}, ['{"a":1,"b":1,"c":1}', '{"b":1}'], ['{"a":1,"b":1}']),
    ({"dependentSchemas": {"a": {"required": ["z"]}}}, ['{"a":1,"z":1}', "{}"], ['{"a":1}']),
    ({"if": {"properties": {"k": {"const": "n"}}, "required": ["k"]}, "then": {"required": ["v"]}, "else": {"maxProperties": 1}},
     ['{"k":"n","v":1}', '{"x":1}'], ['{"k":"n"}', '{"x":1,"y":2}']),
    ({"if": {"type": "string"}, "else": {"minimum": 5}}, ['"a"', "5"], ["4"]),
    ({"$ref": "#/$defs/p", "$defs": {"p": {"type": "integer"}}}, ["1"], ['"a"']),
    ({"properties": {"a": {"$ref": "#/definitions/p", "minimum": 3}}, "definitions": {"p": {"type": "integer"}}}, ['{"a":3}', "{}"], ['{"a":2}', '{"a":"3"}']),
    ({"items": {"$ref": "#/$defs/a~1b"}, "$defs": {"a/b": {"$ref": "#/$defs/c"}, "c": {"enum": [1]}}}, ["[1]"], ["[2]"]),
]
TREE = {"$ref": "#/$defs/t", "$defs": {
    "t": {"type": "object", "required": ["v"], "properties": {"v": {"type": "integer"}, "kids": {"type": "array", "items": {"$ref": "#/$defs/t"}},
                                                              "named": {"additionalProperties": {"$ref": "#/$defs/t"}, "type": "object"}}}}}
# An expression is a number or [operator, expression, expression ...]; both rules refer to each other.
EXPR = {"$ref": "#/$defs/e", "$defs": {
    "e": {"oneOf": [{"type": "number"}, {"$ref": "#/$defs/call"}]},
    "call": {"type": "array", "minItems": 2, "prefixItems": [{"enum": ["+", "*"]}], "items": {"$ref": "#/$defs/e"}}}}
SELF = {"type": ["object", "null"], "properties": {"next": {"$ref": "#"}}, "patternProperties": {"^k": {"type": "integer"}}, "additionalProperties": False}


def _flags(spark, schema, bodies):
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, b string").withColumn("v", jp.strict_json(F.col("b")))
    rows = df.select("i", compile_schema(schema, F.col("v")).alias("ok"), violations(schema, F.col("v")).alias("why")).orderBy("i").collect()
    return [r.ok for r in rows], [r.why for r in rows]


@pytest.mark.parametrize("schema,good,bad", GOLDEN, ids=[next(iter(g[0])) + str(i) for i, g in enumerate(GOLDEN)])
def test_keywords(spark, schema, good, bad):
    ok, why = _flags(spark, schema, good + bad)
    assert ok == [True] * len(good) + [False] * len(bad)
    assert [bool(w) for w in why] == [not x for x in ok]  # every refusal is explained


def _tree(x):
    return (isinstance(x, dict) and isinstance(x.get("v"), int) and not isinstance(x.get("v"), bool)
            and isinstance(x.get("kids", []), list) and all(map(_tree, x.get("kids", [])))
            and isinstance(x.get("named", {}), dict) and all(map(_tree, x.get("named", {}).values())))


def _expr(x):
    if isinstance(x, list):
        return len(x) >= 2 and x[0] in ("+", "*") and isinstance(x[0], str) and all(map(_expr, x[1:]))
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def _self(x):
    return x is None or (isinstance(x, dict) and all(
        (_self(v) if k == "next" else k.startswith("k") and isinstance(v, int) and not isinstance(v, bool)) for k, v in x.items()))


def _random(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.2:
        return rng.choice([1, 2, "x", None, [], {}, True, {"v": 1}])
    if kind < 0.5:
        return [rng.choice(["+", "*", "+", "?"])] + [_random(rng, depth - 1) for _ in range(rng.randrange(4))]
    keys = rng.sample(["v", "kids", "named", "next", "k1"], rng.randrange(4))
    return {k: rng.choice([1, 2, "x"]) if k in ("v", "k1") and rng.random() < 0.9 else
            [_random(rng, depth - 1) for _ in range(rng.randrange(3))] if k == "kids" else _random(rng, depth - 1) for k in keys}


def _good(rng, depth):
    """A body that is valid but for a rare fault."""
    fault = rng.random() < 0.03
    tree = {"v": "x" if fault else 1}
    if depth:
        tree["kids"] = [_good(rng, depth - 1) for _ in range(rng.randrange(3))]
        tree["named"] = {str(i): _good(rng, depth - 1) for i in range(rng.randrange(2))}
    return tree


@pytest.mark.parametrize("schema,judge", [(TREE, _tree), (EXPR, _expr), (SELF, _self)])
def test_recursive_schemas(spark, schema, judge):
    assert resolved(schema) is None
    rng = random.Random(7)
    bodies = [_random(rng, 4) for _ in range(150)] + [_good(rng, 4) for _ in range(60)]
    bodies += [["+", 1, ["*", 2, 3]], ["+", 1, ["?", 2]], {"next": {"next": None, "k2": 1}}, {"next": {"next": 1}}, 5]
    deep, bad = {"v": 1}, {"v": "x"}
    chain, sums = {"k0": 1}, 1
    for _ in range(100):  # 200 levels and more
        deep, bad, chain, sums = {"v": 1, "kids": [deep]}, {"v": 1, "kids": [{"v": 2}, bad]}, {"next": chain}, ["+", sums, 2]
    bodies += [deep, bad, chain, sums]
    ok, _ = _flags(spark, schema, [json.dumps(b) for b in bodies])
    want = [judge(b) for b in bodies]
    assert ok == want and True in want and False in want


def test_references_that_cannot_be_followed_raise():
    v = F.lit(None).cast("variant")
    for schema in ({"$ref": "http://x/y"}, {"$ref": "#/nothing"}, {"$ref": "#/$defs/a", "$defs": {"a": {"$ref": "#/$defs/a"}}},
                   {"unevaluatedProperties": False}):
        with pytest.raises(ValueError):
            compile_schema(schema, v)
