"""A check means the same declared in a spec and as a row of a checks table."""
import pytest
from pyspark.sql import functions as F

from proofline.functions import jsonpath as jp
from proofline.operators.checks import Check
from proofline.operators.evaluate import apply_checks, case_gate, checks_table, evaluate_checks, with_judgements

SCHEMA = {"type": "object", "required": ["a"], "properties": {
    "a": {"enum": ["é", "x"]}, "l": {"type": "array", "items": {"type": "integer", "minimum": 2}}}}
CHECKS = [
    Check("valid_json"), Check("contains", {"value": "he'l"}), Check("not_contains", {"value": "zz"}),
    Check("regex_match", {"pattern": r"(?P<k>h)e.*\Z"}), Check("numeric_bound", {"field": "$.n", "min": 1, "max": 5}),
    Check("numeric_bound", {"field": "$.n"}), Check("latency_bound", {"max_ms": 10}),
    Check("field_present", {"field": "$.l[*]", "min": 2}), Check("field_present", {"field": "$.o.*"}),
    Check("field_present", {"field": "l[0:2]"}), Check("field_present", {"field": "$.l[-1]"}),
    Check("citation_present", {"field": "$.c[*]"}), Check("refusal_detector"),
    Check("refusal_detector", {"expect_refusal": False, "markers": ["he"]}), Check("pii_absent"),
    Check("equals", {"field": "$.a", "value": "é"}), Check("equals", {"field": "$.n", "value": 3}),
    Check("equals", {"field": "$.o", "value": {"y": 1, "x": None}}), Check("cost_bound", {"max_usd": 0.5}),
    Check("enum_value", {"field": "$.l[*]", "values": [1, 2, 3]}), Check("length_bound", {"max": 5}),
    Check("length_bound", {"min": 3}), Check("json_schema", {"schema": SCHEMA}), Check("json_schema", {"schema_ref": "s"}),
    Check("nope"), Check(type="mystery"), Check(type="judge", judge="j"), Check("u", type="generated"),
    Check("u", type="generated", threshold=0.9), Check("gone", type="generated"),
]
ROWS = [(1, "he'l lo\nx a.b@c.de", '{"a":"é","n":3,"l":[1,2],"c":["A","",null,[]],"o":{"x":null,"y":1}}', 9.5, 0.2),
        (2, None, '{"a":"q","l":[1,5.5,"z"]}', None, None), (3, "zz", "not json", 99.0, 1.0),
        (4, "i cannot", '{"n":"3","a":null}', 1.0, 0.1)]


def test_both_forms_agree(spark):
    def u(response, context):
        return {"passed": True, "score": 0.8, "message": ",".join(sorted(k for k, v in response.items() if v is not None))}
    df = spark.createDataFrame(ROWS, "case_id long, text string, body string, latency_ms double, cost_usd double")
    given = dict(user_checks={"u": u}, schemas={"s": SCHEMA})
    a = apply_checks(df, CHECKS, ["case_id"], **given).orderBy("case_id", "check_index").collect()
    t = checks_table(spark, [dict(check_index=i, type=c.type, uses=c.uses, params=c.params, judge=c.judge, threshold=c.threshold)
                             for i, c in enumerate(CHECKS)]).drop("case_id")
    per_case = t.withColumn("case_id", F.explode(F.array(*[F.lit(r[0]).cast("long") for r in ROWS])))
    b = evaluate_checks(df, per_case, ["case_id"], **given).orderBy("case_id", "check_index").collect()
    assert [r.asDict() for r in a] == [{k: r[k] for k in a[0].asDict()} for r in b]
    by = {(r.case_id, r.check_index): r for r in a}
    assert by[1, 15].passed and by[1, 17].passed and not by[2, 15].passed
    assert by[1, 22].message == "1 is less than the minimum of 2" and by[1, 22].evidence == '{"path":["l",0]}'
    assert by[2, 22].message == "'q' is not one of ['é', 'x']"
    assert by[1, 27].passed and not by[1, 28].passed and by[1, 27].message == "cost_usd,json,latency_ms,text"
    assert by[1, 26].check_id == "judge" and by[1, 26].message == "unknown judge: j"


def test_table_rows_that_cannot_be_checked_say_so(spark):
    df = spark.createDataFrame(ROWS[:1], "case_id long, text string, body string, latency_ms double, cost_usd double")
    rows = [("contains", "{}"), ("numeric_bound", '{"field": "$.n m"}'), ("json_schema", '{"schema": {"type": "null"}}'), ("contains", "oops")]
    t = spark.createDataFrame([(1, i, "template", n, None, p, True, None) for i, (n, p) in enumerate(rows)],
                              "case_id long, check_index long, type string, uses string, judge string, params string, required boolean, threshold double")
    got = [r.message for r in evaluate_checks(df, t, ["case_id"]).orderBy("check_index").collect()]
    assert got == ["missing parameter: value", "path not supported in a checks table: $.n m", "schema is not among those given",
                   "parameters are not JSON"]


def test_judge_results_reach_the_gate(spark):
    df = spark.createDataFrame([(1, "ok", None, 1.0), (2, "ok", None, 1.0), (3, "ok", None, 1.0)], "case_id long, text string, body string, latency_ms double")
    res = apply_checks(df, [Check("contains", {"value": "ok"}), Check(type="judge", judge="j", threshold=0.5)], ["case_id"])
    j = spark.createDataFrame([(1, 1, "j", False, 0.7, "m", "warn", None), (2, 1, "j", True, 0.4, "m", "info", None)],
                              "case_id long, check_index long, judge string, passed boolean, score double, message string, severity string, evidence string")
    out = with_judgements(res, j, ["case_id"])
    ids = {r.case_id: r.check_id for r in out.where("type = 'judge'").collect()}
    assert ids == {1: "judge:j", 2: "judge:j", 3: "judge"}
    assert {r.case_id: r.passed for r in case_gate(out, ["case_id"]).collect()} == {1: True, 2: False, 3: False}


BODY = '{"a": {"x": 1, "b": {"x": 2}}, "l": [{"x": 3, "s": "p"}, {"x": 4}, 5], "y": null}'


@pytest.mark.parametrize("path,expected", [
    ("$.a.x", ["1"]), ("a.x", ["1"]), ("$['a']['x']", ["1"]), ("$.l[0].x", ["3"]), ("$.l[-1]", ["5"]), ("$.l[0:2].x", ["3", "4"]),
    ("$.l[1:]", ['{"x":4}', "5"]), ("$.a.*", ['{"x":2}', "1"]), ("$.a[*]", ['{"x":2}', "1"]), ("$..x", ["1", "2", "3", "4"]),
    ("$.l[?(@.x > 3)].x", ["4"]), ("$.l[?(@.x >= 3)].x", ["3", "4"]), ("$.l[?(@.x = 3)].s", ['"p"']), ("$.l[?(@.s != 'p')]", []),
    ("$.l[?(@.x != 3)].x", ["4"]), ("$.l[?(@.s < 'q')].x", ["3"]), ("$.*[?(@.x == 2)].x", ["2"]),
    ("$..l[?(@.x < 4)].x", ["3"]), ("$.l[?(@.x == null)]", []), ("$.l[?(@.x == true)]", []), ("$..*", [
        '{"b":{"x":2},"x":1}', "1", '{"x":2}', "2", '[{"s":"p","x":3},{"x":4},5]', '{"s":"p","x":3}', "3", '"p"', '{"x":4}', "4", "5", "null"]), ("$.l[?(@.s == 'p')].x", ["3"]), ("$.y", ["null"]), ("$.missing", []), ("$.l[9]", [])])
def test_paths(spark, path, expected):
    df = spark.createDataFrame([(BODY, path)], "b string, p string").withColumn("v", jp.strict_json(F.col("b")))
    got = df.select(F.transform(jp.matches(F.col("v"), path), lambda x: F.to_json(x)).alias("m")).first().m
    assert sorted(got) == sorted(expected)
    data = df.select(F.transform(jp.matches_by_data(F.col("v"), F.col("p")), lambda x: F.to_json(x)).alias("m")).first().m
    assert data == got


@pytest.mark.parametrize("path", ["$.a..", "$[?(@.x =~ 'a')]", "$.a b", "", "$.a[", None])
def test_paths_outside_the_grammar_raise(path):
    with pytest.raises(jp.PathError):
        jp.parse_path(path)


@pytest.mark.parametrize("depth", [1, 81, 200, 990])
def test_descendants_reach_every_level(spark, depth):
    """A value hundreds of levels down is found, by a path in code and one that is data."""
    body = '{"a":[' * (depth // 2) + '{"x":1}' + "]}" * (depth // 2)
    df = spark.createDataFrame([(body, "$..x")], "b string, p string").withColumn("v", jp.strict_json(F.col("b")))
    one, two = df.select(F.size(jp.matches(F.col("v"), "$..x")), F.size(jp.matches_by_data(F.col("v"), F.col("p")))).first()
    assert one == two == 1
    check = Check("field_present", {"field": "$..x"})
    assert apply_checks(df, [check], ["p"], body="b", text=None, latency=None).first().passed
    paths = {r.path: r.responses for r in jp.path_inventory(df, "v").collect()}
    assert paths["$" + ".a[*]" * (depth // 2) + ".x"] == 1 and len(paths) == depth // 2 * 2 + 1
    assert len(jp.path_inventory(df, "v", depth=3).collect()) == min(3, depth // 2 * 2 + 1)


def test_a_check_on_data_paths_with_descendants_and_comparisons(spark):
    rows = [(1, "t", '{"f":[{"k":{"s":"bad","n":3}},{"k":{"s":"ok"}}],"deep":[[[{"s":"bad"}]]]}'), (2, "t", '{"f":[]}')]
    df = spark.createDataFrame(rows, "case_id long, text string, body string")
    checks = [Check("field_present", {"field": "$..s", "min": 3}), Check("field_present", {"field": "$.f[?(@.k.s == 'bad')]"}),
              Check("numeric_bound", {"field": "$..n", "min": 3}), Check("field_present", {"field": "$..k[?(@ == 3)]"}),
              Check("citation_present", {"field": "$.f[?(@.k.n >= 3)].k.s"})]
    a = apply_checks(df, checks, ["case_id"], latency=None).orderBy("case_id", "check_index").collect()
    t = checks_table(spark, [dict(check_index=i, uses=c.uses, params=c.params) for i, c in enumerate(checks)]).drop("case_id")
    t = t.withColumn("case_id", F.explode(F.array(F.lit(1), F.lit(2)).cast("array<bigint>")))
    b = evaluate_checks(df.withColumns({"latency_ms": F.lit(0.0), "cost_usd": F.lit(0.0)}), t, ["case_id"]).orderBy("case_id", "check_index").collect()
    assert [(r.passed, r.message) for r in a] == [(r.passed, r.message) for r in b]
    assert [r.passed for r in a] == [True] * 5 + [False] * 5
