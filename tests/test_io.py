"""Report writing, the lossless stream, user-check failures, judge providers, verdict parsing."""
import hashlib
import html
import os
import shutil

import pandas as pd
import pytest
from pyspark.sql import functions as F

from proofline.operators import judge as J
from proofline.operators import report as RP
from proofline.operators import udf as U
from proofline.operators.checks import Check
from proofline.operators.evaluate import apply_checks
from proofline.streaming import progress as P

SF = "/root/testdata/sf0.001"


def read_run(folder, run):
    path = os.path.join(folder, run)
    return "".join(open(os.path.join(path, f)).read() for f in sorted(os.listdir(path)) if f.startswith("part-"))


def test_reports_are_written_in_order(spark, tmp_path):
    import __spark_entry__ as E
    lines = E.queries()["report_markdown"](spark, SF).cache()
    RP.write_lines(lines, str(tmp_path / "md"))
    runs = sorted(d for d in os.listdir(tmp_path / "md") if d.startswith("run_id="))
    text = read_run(tmp_path / "md", runs[0])
    assert text.startswith("# Evaluation report") and "- **Trigger:** batch by builder" in text
    order = [text.index(x) for x in ("**Summary:**", "## Requirement coverage", "requirements covered (", "`R1`", "NOT COVERED",
                                     "requirement(s) have no test", "## Cases", "### [")]
    assert order == sorted(order)
    RP.write_lines(RP.html_lines(lines), str(tmp_path / "html"))
    page = read_run(tmp_path / "html", runs[0])
    assert page.startswith("<!DOCTYPE html>") and page.rstrip().endswith("</pre></body></html>")
    assert html.unescape(page.split("<pre>\n", 1)[1].rsplit("</pre>", 1)[0]) == text


def test_packed_reports(spark, tmp_path):
    rows = [(f"run{r}", s, "", "", k, f"{r}-{s}-{k}") for r in range(200) for s in (0, 5) for k in range(1 + 3000 * (r == 7))]
    lines = spark.createDataFrame(rows, "run_id string, section int, k1 string, k2 string, k3 long, line string").repartition(7, "line")
    path = str(tmp_path / "packed")
    RP.write_packed(lines, path)
    assert len([f for f in os.listdir(path) if f.endswith(".parquet")]) == 1
    RP.write_packed(lines, path, file_bytes=100_000)
    assert 2 <= len([f for f in os.listdir(path) if f.endswith(".parquet")]) <= 7
    want = [x for r, *_, x in sorted(rows) if r == "run7"]
    one = RP.read_run(spark, path, "run7")
    assert [r.line for r in one.collect()] == want and "EqualTo(run_id,run7)" in one._jdf.queryExecution().toString()
    got = {r.run_id: (r.lines, r.digest) for r in RP.run_digests(spark.read.parquet(path)).collect()}

    def h(parts):
        return hashlib.sha256("\n".join(parts).encode()).hexdigest()
    assert got["run7"] == (6002, h([h([h(want[i:i + 1024]) for i in range(0, 6002, 1024)])])) and len(got) == 200
    assert RP.run_digests(lines.where("false")).count() == 0


def stream(spark, path, schema):
    return P.checked(P.response_stream(spark, path, schema, files_per_trigger=1), [Check("latency_bound", {"max_ms": 25})],
                     ["run_id", "case_id"])


@pytest.fixture
def responses(spark):
    e = spark.read.parquet(f"{SF}/events.parquet")
    return e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("case_id"), F.col("props").alias("body"),
                    F.col("value").alias("latency_ms"), "ts")


def test_stream_loses_nothing_and_counts_once(spark, responses, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    k = F.col("case_id") % 4
    newest_first = responses.orderBy(F.desc("ts"))
    for i, part in enumerate([newest_first.where(k == 0), newest_first.where(k == 1), newest_first.where(k == 0)]):
        part.coalesce(1).write.mode("append").parquet(f"{src}")  # the third drop repeats the first
    P.store_results(stream(spark, src, responses.schema), out, ck)
    totals = responses.groupBy("run_id").agg(F.count(F.lit(1)).alias("cases_total"))
    first = P.progress(P.stored_cases(spark, out, ["run_id", "case_id"]), totals)
    assert first.agg(F.sum("done")).first()[0] == responses.where(k < 2).count()
    assert first.where("state = 'ready_for_review'").count() < first.count()
    # hours behind the newest, after a restart on the same checkpoint
    responses.where(k > 1).orderBy("ts").coalesce(1).write.mode("append").parquet(src)
    P.store_results(stream(spark, src, responses.schema), out, ck)
    cases = P.stored_cases(spark, out, ["run_id", "case_id"])
    assert cases.select(F.explode("checks.check_id")).distinct().collect()[0][0] == "template:latency_bound"
    done = P.progress(cases, totals)
    assert done.agg(F.sum("done")).first()[0] == responses.count()
    assert done.where("state <> 'ready_for_review'").count() == 0
    want = responses.where("latency_ms <= 25").count()
    assert done.agg(F.sum("passed")).first()[0] == want
    # nothing new: another restart changes nothing; a batch written twice replaces itself
    batches = sorted(os.listdir(out))
    P.store_results(stream(spark, src, responses.schema), out, ck)
    assert sorted(os.listdir(out)) == batches
    again = spark.read.parquet(f"{out}/batch_id=0")
    keep = str(tmp_path / "copy")
    again.write.parquet(keep)
    P.store_batch(spark.read.parquet(keep), 0, out)
    assert P.stored_cases(spark, out, ["run_id", "case_id"]).count() == responses.count()


def test_run_without_responses_is_pending(spark, responses, tmp_path):
    src = str(tmp_path / "src")
    os.makedirs(src)
    shutil.copy(f"{SF}/events.parquet", os.path.join(src, "e.parquet"))
    e = spark.read.parquet(src)
    s = P.checked(spark.readStream.schema(e.schema).parquet(src).withColumnsRenamed(
        {"user_id": "run_id", "event_id": "case_id", "props": "body", "value": "latency_ms"}), [Check("valid_json")], ["run_id", "case_id"])
    P.store_results(s, str(tmp_path / "o"), str(tmp_path / "c"))
    totals = spark.createDataFrame([(-1, 3)], "run_id long, cases_total long")
    assert P.progress(P.stored_cases(spark, str(tmp_path / "o"), ["run_id", "case_id"]), totals).first().asDict() == {
        "run_id": -1, "done": 0, "passed": 0, "cases_total": 3, "state": "pending"}


def test_user_check_errors_become_failed_results(spark):
    def boom(resp, ctx):
        raise RuntimeError("n" * 500)

    def sees(resp, ctx):
        return {"passed": ctx == {"suite": "s"} and set(resp) == set(U.RESPONSE_FIELDS) and resp["usage"] == {"n": 1}}
    df = spark.createDataFrame([(1, "x", None, 1.0, '{"n": 1}')], "case_id long, text string, body string, latency_ms double, usage string")
    r = apply_checks(df, [Check("boom", type="generated"), Check("missing", type="generated"), Check("sees", type="generated")],
                     ["case_id"], user_checks={"boom": boom, "sees": sees}, context=F.lit('{"suite": "s"}')
                     ).orderBy("check_index").collect()
    assert [x.passed for x in r] == [False, False, True]
    assert r[0].message == "check raised RuntimeError: " + "n" * 500 and r[0].check_id == "generated:boom"
    assert "no check function" in r[1].message


def test_judge_provider(spark):
    df = spark.createDataFrame([(1, "p1"), (2, "p2")], "case_id long, prompt string")

    def provider(pdf):
        return pd.Series([f"{p}/{n}" for p, n in zip(pdf["prompt"], pdf["sample_no"], strict=True)])
    got = {(r.case_id, r.sample_no): r.verdict for r in U.ask_judge(df, provider, ["case_id"], samples=12).collect()}
    assert got == {(c, n): f"p{c}/{n}" for c in (1, 2) for n in range(1, 13)}
    with pytest.raises(ValueError):
        U.ask_judge(df, provider, ["case_id"], samples=0)


def test_prompt_holds_the_whole_response(spark):
    long = "x" * 20_000
    df = spark.createDataFrame([(long, None), (long, "{}"), ("t", '{"a":1}')], "t string, j string")
    out = [r.p for r in df.select(J.build_prompt(F.lit("- d"), F.col("j"), F.col("t"), F.lit('{"q": 1}')).alias("p")).collect()]
    assert long in out[0] and long in out[1] and 'MODEL RESPONSE:\n{"a":1}\n' in out[2] and out[2].endswith('CASE INPUT:\n{"q": 1}')


def test_parse_verdicts(spark):
    df = spark.createDataFrame([('{"s": {"a": 1}}',), ('Here {x}: {"s": {"a": 2}} thanks {"b": 1}',), ("no json",), ('[{"a":1}]',), (None,), (" ",), ("3",)],
                               "verdict string")
    got = [(r.verdict_json, r.verdict_error) for r in J.parse_verdicts(df).collect()]
    assert got == [('{"s":{"a":1}}', None), ('{"s":{"a":2}}', None), (None, "no JSON object in the reply"),
                   (None, "expected an object, got array"), (None, "empty reply"), (None, "empty reply"), (None, "expected an object, got number")]


def test_schema_faults_are_explained(spark):
    from proofline.operators.jsonschema import compile_schema
    schema = {"type": "object", "properties": {"n": {"type": "number", "minimum": 1, "exclusiveMinimum": True},
                                               "t": {"items": [{"type": "string"}, {"type": "integer"}]}, "w": {"const": "ö"}}}
    df = spark.createDataFrame([(b,) for b in ('{"n": 1}', '{"n": 1.5, "w": "ö"}', '{"t": ["a", "b"]}', '{"t": ["a", 2, null]}', '{"w": "o"}', "3")],
                               "body string")
    out = [(r.passed, r.evidence) for r in apply_checks(df, [Check("json_schema", {"schema": schema})], ["body"], text=None, latency=None).collect()]
    assert out == [(False, '{"path":["n"]}'), (True, None), (False, '{"path":["t",1]}'), (True, None), (False, '{"path":["w"]}'), (False, '{"path":[]}')]
    with pytest.raises(ValueError):
        compile_schema({"unevaluatedItems": False}, F.lit(None).cast("variant"))


def test_a_user_check_sees_one_parsed_row_and_its_own_context(monkeypatch):
    import pyarrow as pa

    from proofline.operators import udf as U
    read = []
    monkeypatch.setattr(U, "_loads", lambda s, loads=U._loads: read.append(s) or loads(s))

    def check(response, context):
        seen = dict(context)
        context["more"] = response["json"]
        return {"passed": response["latency_ms"] == 0.0 and response["status"] in (200, None), "score": float("nan"), "evidence": seen}
    response = pa.StructArray.from_arrays([pa.array(["[1]", None, "{"]), pa.array([200, None, 200])], names=["json", "status"])
    rows = U._results(check, response, pa.array(['{"s": 1}', '{"s": 1}', None]), dict.fromkeys(U.RESPONSE_FIELDS))
    first = next(rows)
    assert sorted(read) == ["[1]", '{"s": 1}']
    got = [first, *rows]
    assert [r[0] for r in got] == [True, True, True] and [r[4] for r in got] == ['{"s": 1}', '{"s": 1}', "{}"]
    assert read.count('{"s": 1}') == 1
