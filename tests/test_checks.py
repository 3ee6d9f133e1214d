"""Template checks against literal responses (CHK-1..16, CHK-21)."""
import json

import pytest
from pyspark.sql import functions as F

from proofline import session
from proofline.functions import jsonpath as jp
from proofline.operators.checks import Check, unresolved_citations
from proofline.operators.evaluate import apply_checks, graded, effective_threshold, with_body


def run(spark, rows, checks, schema="case_id long, text string, body string, latency_ms double"):
    df = spark.createDataFrame(rows, schema)
    out = apply_checks(df, checks, ["case_id"]).orderBy("case_id", "check_index").collect()
    return [(r.case_id, r.check_index, r.passed, r.message) for r in out]


def test_contains_and_not_contains(spark):
    rows = [(1, "hello World", None, 1.0), (2, None, None, 1.0)]
    res = run(spark, rows, [Check("contains", {"value": "World"}),
                            Check("not_contains", {"value": "it's"}),
                            Check("contains", {"value": ""})])
    assert res[0][2:] == (True, "text contains: 'World'")
    assert res[1][2:] == (True, "forbidden string absent: \"it's\"")
    assert res[2][2] is True                     # empty needle passes
    assert res[3][2:] == (False, "text missing: 'World'")   # NULL text is ""


def test_regex_python_semantics(spark):
    rows = [(1, "x\r\ny", None, 0.0), (2, "ab\nCD", None, 0.0), (3, "tok=12", None, 0.0)]
    res = run(spark, rows, [Check("regex_match", {"pattern": "x$"}),
                            Check("regex_match", {"pattern": "^CD"}),
                            Check("regex_match", {"pattern": r"(?P<k>tok)=\d+\Z"})])
    by = {(r[0], r[1]): r[2] for r in res}
    assert by[(1, 0)] is False       # $ does not match before \r (Python)
    assert by[(2, 1)] is True        # MULTILINE
    assert by[(3, 2)] is True        # named group + \Z translated


def test_valid_json_and_paths(spark):
    rows = [(1, None, '{"a": {"b": 3}, "l": [{"x": 1}, {"x": null}, {}]}', 0.0),
            (2, None, "null", 0.0), (3, None, '{"a": 1} trailing', 0.0),
            (4, None, '{"a": {"b": "7"}}', 0.0), (5, None, '{"a": {"b": true}}', 0.0)]
    res = run(spark, rows, [Check("valid_json"),
                            Check("field_present", {"field": "$.l[*].x", "min": 2}),
                            Check("numeric_bound", {"field": "$.a.b", "min": 1, "max": 5})])
    by = {(r[0], r[1]): r for r in res}
    assert by[(1, 0)][2] is True and by[(2, 0)][2] is False and by[(3, 0)][2] is False
    assert by[(1, 1)][2] is True and by[(1, 1)][3] == "2 match(es) for $.l[*].x"  # null counts
    assert by[(1, 2)][2:] == (True, "$.a.b=3 within [1,5]")
    assert by[(4, 2)][2] is False                   # a string is not a number (D-1)
    assert by[(5, 2)][2] is True                    # true counts as 1
    assert by[(2, 2)][3] == "field not found: $.a.b"


def test_citation_present_skips_empty(spark):
    body = '{"findings": [{"article": "A"}, {"article": ""}, {"article": null}, {"article": []}, {"article": 0}]}'
    res = run(spark, [(1, None, body, 0.0)],
              [Check("citation_present", {"field": "$.findings[*].article", "min": 2})])
    assert res[0][2:] == (True, "2 citation(s) found at $.findings[*].article")


def test_latency_refusal_pii(spark):
    rows = [(1, "Sorry, I CANNOT help. mail a.b@x.org, card 4111 1111 1111 1111", None, 12.5),
            (2, "IBAN DE44500105175407324931 ok", None, None)]
    res = run(spark, rows, [Check("latency_bound", {"max_ms": 12}),
                            Check("refusal_detector"), Check("pii_absent")])
    by = {(r[0], r[1]): r for r in res}
    assert by[(1, 0)][2:] == (False, "latency 12ms > 12ms")     # half-even like Python
    assert by[(2, 0)][2:] == (True, "latency 0ms <= 12ms")      # absent latency = 0
    assert by[(1, 1)][2:] == (True, "refusal=True, expected=True")
    assert by[(2, 1)][2] is False
    assert by[(1, 2)][3] == "PII detected: ['email', 'card']"
    assert by[(2, 2)][3] == "PII detected: ['iban']"


def test_json_schema(spark):
    from proofline.plans.q_checks import FINDING_SCHEMA
    good = '{"findings": [{"status": "blocked", "severity": "high", "article": "MiCA Art. 60"}]}'
    bad_enum = '{"findings": [{"status": "blocked", "severity": "urgent", "article": "x"}]}'
    missing = '{"findings": [{"status": "blocked", "severity": "low"}]}'
    res = run(spark, [(1, None, good, 0.0), (2, None, bad_enum, 0.0), (3, None, missing, 0.0),
                      (4, None, "not json", 0.0), (5, None, '{"findings": "no"}', 0.0)],
              [Check("json_schema", {"schema": FINDING_SCHEMA})])
    assert [r[2] for r in res] == [True, False, False, False, False]
    assert res[3][3] == "no JSON body to validate"


def test_unknown_template_fails(spark):
    res = run(spark, [(1, "x", None, 0.0)], [Check("nope"), Check(type="weird")])
    assert res[0][2:] == (False, "unknown template: nope")
    assert res[1][2:] == (False, "unknown check type: weird")


def test_missing_param_raises_at_plan_time(spark):
    with pytest.raises(KeyError):
        run(spark, [(1, "x", None, 0.0)], [Check("contains")])


@pytest.mark.parametrize("passed,score,with_thr,spec_thr,expected", [
    (False, 0.85, 0.80, None, True), (True, 0.72, 0.80, None, False),
    (True, 0.30, None, None, True), (False, 0.9, 0.0, 0.95, False), (True, None, 0.5, None, True)])
def test_threshold_truth_table(spark, passed, score, with_thr, spec_thr, expected):
    thr = effective_threshold(with_thr, spec_thr)
    df = spark.range(1).select(graded(F.lit(passed), F.lit(score).cast("double"),
                                      F.lit(thr).cast("double")).alias("p"))
    assert df.first().p is expected


def test_unresolved_citations_in_as_many_tasks_as_rows_need(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_PARTITION", 50)
    rows = [(i % 900, f'{{"a": ["x{i % 3}", "x{i % 3}", "", null, {i % 7}, {{"k": {i % 2}}}]}}') for i in range(1000)]
    r = with_body(spark.createDataFrame(rows, "k long, body string"))
    corpus = spark.createDataFrame([("x1",), ("x1",), ("5",), (None,)], "ref string")
    out = unresolved_citations(r, jp.matches(F.col("json"), "$.a[*]"), ["k"], corpus)
    want = {(k, c) for k, b in rows for x in json.loads(b)["a"] if x not in ("", None, {}) for c in [x if isinstance(x, str) else json.dumps(x, separators=(",", ":"))]}
    got = [tuple(x) for x in out.collect()]
    assert len(got) == len(set(got)) and set(got) == {x for x in want if x[1] not in ("x1", "5")}
    assert out.rdd.getNumPartitions() == 40
