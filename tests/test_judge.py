"""Judge reduction and evidence verification (JDG-5..13)."""
import random

import pytest
from pyspark.sql import functions as F

from proofline.functions.text import fold
from proofline.operators import judge as J

TEXT = "Article 17 requires erasure on request.\nThe controller must act without undue delay."


@pytest.mark.parametrize("quote,ok", [
    ("article 17 REQUIRES erasure", True),                          # re-cased
    ("requires erasure on request. The controller", True),          # re-wrapped
    ("Article 17 ... without undue delay", True),                   # elided
    ("“Article 17 requires erasure on request.”", True),            # curly quotes
    ("Article 18 requires erasure", False),                         # wrong number
    ("without undue delay … Article 17", False),                    # reversed segments
    ("The processor may refuse any request", False),                # invented
    ("   ...   ", False),                                           # blank
])
def test_quote_in(spark, quote, ok):
    df = spark.createDataFrame([(TEXT, quote)], "t string, q string")
    assert df.select(J.quote_in(F.col("q"), fold(F.col("t"))).alias("v")).first().v is ok


def _reduce(spark, samples):
    rows = [(1, i, d, s) for i, (d, s) in enumerate(samples)]
    df = spark.createDataFrame(rows, "case_id long, sample_no long, dim string, score int")
    return {r.dim: (r.n, r.median, r.spread) for r in J.reduce_scores(df, ["case_id"]).collect()}


def test_median_floor_and_spread(spark):
    got = _reduce(spark, [("acc", 0), ("acc", 2), ("acc", 2), ("tone", 1), ("tone", 2)])
    assert got["acc"] == (3, 2, 2)
    assert got["tone"] == (2, 1, 1)     # median 1.5 floors to 1


def test_score_coercion(spark):
    df = spark.createDataFrame([(1, 0, '{"a": "2", "b": 1.9, "c": true, "d": "2.5", "e": null, "f": {}}')],
                               "case_id long, sample_no long, scores string")
    got = {r.dim: r.score for r in J.explode_scores(df, ["case_id"]).collect()}
    assert got == {"a": 2, "b": 1, "c": 1}


def test_missing_dimension_named(spark):
    red = spark.createDataFrame([(1, "acc", 3, 2, 0)], "case_id long, dim string, n long, median int, spread int")
    dims = spark.createDataFrame([("r", "acc", 0, None, None, 2), ("r", "cite", 1, None, None, 2)],
                                 "rubric_id string, dim string, dim_pos int, min_score int, rubric_min int, scale_top int")
    cases = spark.createDataFrame([(1, "r")], "case_id long, rubric_id string")
    r = J.score_checks(red, dims, cases, ["case_id"]).first()
    assert r.passed is False
    assert r.message == "judge did not score dimension 'cite'"
    assert r.score == 0.5


def test_unlisted_dimensions_do_not_count(spark):
    v = spark.createDataFrame([(1, 0, "r", '{"a": 1, "z": 0}'), (1, 1, "r", '{"a": 1, "z": 2}')],
                              "case_id long, sample_no long, rubric_id string, scores string")
    dims = spark.createDataFrame([("r", "a")], "rubric_id string, dim string")
    red = J.reduce_scores(J.explode_scores(v, ["case_id"], dims=dims), ["case_id"])
    r = J.consistency(red, ["case_id"]).first()
    assert (r.samples, r.max_spread, r.agreed) == (2, 0, True) and [d.dim for d in r.per_dimension] == ["a"]


def test_evidence_rule_and_flattened_body(spark):
    body = '{"findings": [{"article": "Article 5", "n": 3}], "ok": true, "none": null}'
    cases = spark.createDataFrame([(i, "plain", body) for i in range(4)], "case_id long, t string, b string").select(
        "case_id", fold(J.haystack(F.col("t"), F.parse_json("b"), 4)).alias("hay"))
    v = spark.createDataFrame([(0, 1, ["article ARTICLE 5", "plain"]), (0, 2, ["plain", "n 3 ... ok True"]), (1, 1, ["made up"]), (2, 1, [])],
                              "case_id long, sample_no long, evidence_quotes array<string>")
    got = {r.case_id: r for r in J.evidence_failures(cases, J.unique_quotes(v, ["case_id"]), ["case_id"]).collect()}
    assert got[0].verified == ["article ARTICLE 5", "plain"] and got[0].unverified == ["n 3 ... ok True"] or got[0].evidence_failure is None
    assert got[1].evidence_failure == "evidence quotes do not appear in the response: 'made up'"
    assert got[2].evidence_failure == got[3].evidence_failure == J.NO_QUOTES


def test_body_is_flattened_to_any_depth(spark):
    deep = '{"a": ' * 60 + '"Article 9"' + "}" * 60
    rows = [(0, '{"findings": [{"article": "Article 5", "by": [[{"ok": true, "n": 1.5}], [], null]}]}'),
            (1, deep), (2, None), (3, "{}")]
    df = spark.createDataFrame(rows, "id long, b string")
    got = {r.id: r.h for r in df.select("id", J.haystack(F.lit("t"), F.parse_json("b")).alias("h")).collect()}
    assert got[0] == "t\nfindings article Article 5\nby n 1.5\nok True\n\nNone"
    assert got[1] == "t\n" + "a " * 60 + "Article 9"
    assert got[2] == got[3] == "t"


def _slow_first(text):
    """Brace by brace, as the definition says."""
    import json

    def refuse(name):
        raise ValueError(name)
    decoder = json.JSONDecoder(parse_constant=refuse)
    for i, c in enumerate(text):
        if c == "{":
            try:
                return text[i:decoder.raw_decode(text, i)[1]]
            except ValueError:
                pass
    return None


def test_first_object_equals_brace_by_brace():
    rng = random.Random(11)
    parts = ['{', '}', '"', '\\', '\\"', '{"a":', '1', ',', '[', ']', '{"a":{"b":1}', '{}', ' ', 'x', '"k":', '{"s":"}{"}', '\n', 'NaN', ':']
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(24)))
        assert J.first_object(text) == _slow_first(text), text


def test_long_replies_take_linear_time():
    import time
    for text in ("{" * 500_000, '{"a": ' * 150_000, '{"k": "' * 150_000, "word { " * 150_000, '{"a": {"b": "c"' * 60_000,
                 '{"a": [' * 120_000 + "1", '{"a": NaN, ' * 50_000, '{"a": "\\" ' * 90_000):
        start = time.process_time()
        J.first_object(text)
        assert time.process_time() - start < 20, text[:20]
    assert J.first_object("{" * 400_000 + '{"x": 1}') == '{"x": 1}'


def test_verdicts_against_a_schema(spark):
    schema = {"type": "object", "required": ["scores"], "properties": {"scores": {"type": "object"}}}
    replies = ['{"scores": {"a": 1}}', 'well {"scores": 3}', "{}", "[]", None, "nothing", 'x {"scores": {}} y']
    df = spark.createDataFrame(list(enumerate(replies)), "id int, verdict string")
    got = [(r.verdict_json, r.verdict_error) for r in J.parse_verdicts(df, schema=schema).orderBy("id").collect()]
    assert got == [('{"scores":{"a":1}}', None), (None, "does not match the schema: 3 is not of type 'object'"),
                   (None, "does not match the schema: 'scores' is a required property"), (None, "expected an object, got array"),
                   (None, "empty reply"), (None, "no JSON object in the reply"), ('{"scores":{}}', None)]
