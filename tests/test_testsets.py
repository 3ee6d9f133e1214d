"""Requirement splitting, keyword intents, ids, references, datasets, cases, specs, rubrics."""
import json
import random
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from proofline.operators import rubrics as RB
from proofline.operators import specs as SP
from proofline.operators import testsets as TS


def split(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {}
    for r in TS.split_requirements(df).orderBy("doc_id", "position").collect():
        out.setdefault(r.doc_id, []).append((r.req_id, r.text, r.section))
    return out


def test_split_goldens(spark):
    got = split(spark, [
        "# Scope\nR1. The body is JSON.\nR2. It cites\n   an article.\n",
        "- one\n* two\n\n## Other ##\n1. three\ncontinues here\nand ends.\nA new one.",
        "No markers here.\nA second sentence that\nwraps around.",
        "", None, "   ", "# Only a heading", "R1. a\nR1. b", "R07. a\nR9. b",
        "R99999999999999999999. text", "one\x0btwo.\x85three"])
    assert got[0] == [("R1", "The body is JSON.", "Scope"), ("R2", "It cites an article.", "Scope")]
    assert got[1] == [("R1", "one", None), ("R2", "two", None),
                      ("R3", "three continues here and ends.", "Other"), ("R4", "A new one.", "Other")]
    assert got[2] == [("R1", "No markers here.", None), ("R2", "A second sentence that wraps around.", None)]
    assert 3 not in got and 4 not in got and 5 not in got
    assert got[6] == [("R1", "# Only a heading", None)]
    assert [r[0] for r in got[7]] == ["R1", "R2"] and [r[0] for r in got[8]] == ["R7", "R9"]
    assert got[9] == [("R99999999999999999999", "text", None)]
    assert got[10] == [("R1", "one two.", None), ("R2", "three", None)]


LINES = st.lists(st.sampled_from(["# h", "- item", "R3. lab", "  indented", "plain", "ends.", "", "2) two", "word; x"]), max_size=9)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(docs=st.lists(LINES, min_size=1, max_size=8))
def test_split_keeps_every_word_once_and_in_order(spark, docs):
    got = split(spark, ["\n".join(d) for d in docs])
    for i, lines in enumerate(docs):
        body = [re.sub(r"^\s*(?:[-*+]|\d+[.)]|[Rr]\d+\s*[.):])\s+", "", x) for x in lines
                if x.strip() and not x.startswith("#")]
        found = got.get(i, [])
        if body:
            assert " ".join(t for _, t, _ in found).split() == " ".join(body).split()
        ids = [r for r, _, _ in found]
        assert len(ids) == len(set(ids))


def test_keyword_intents_baseline_only_without_hits(spark):
    rows = [(1, "R1", "must be json", 1), (1, "R2", "nothing", 2), (2, "R1", "nothing", 1), (2, "R2", "more", 2)]
    df = spark.createDataFrame(rows, "doc_id long, req_id string, text string, position int")
    got = sorted((r.doc_id, r.intent_id) for r in TS.keyword_intents(df).collect())
    assert got == [(1, "H-R1-json"), (2, "H-R1-json"), (2, "H-R1-latency")]


def sequential_ids(ids):
    used, out = set(), []
    for i, x in ids:
        while x in used:
            x = f"{x}-{i}"
        used.add(x)
        out.append(x)
    return out


def test_ids_of_any_chain_end_unique(spark):
    chain = ["a"] + ["a" + "".join(f"-{j}" for j in range(2, k)) for k in range(2, 16)]
    groups = {1: chain, 2: ["x", "x-2", "x", "x-3", "x"], 3: ["same"] * 40, 4: ["b", "b", "b-2", "b-2"]}
    rows = [(g, i, x) for g, xs in groups.items() for i, x in enumerate(xs, 1)]
    df = spark.createDataFrame(rows, "g long, _i long, case_id string").repartition(4)
    got = {}
    for r in TS.dedup_ids(df, within=["g"]).orderBy("g", "_i").collect():
        got.setdefault(r.g, []).append(r.case_id)
    assert got == {g: sequential_ids(list(enumerate(xs, 1))) for g, xs in groups.items()}


def test_unsafe_ids(spark):
    rows = spark.createDataFrame([(1, "../../etc/passwd"), (2, "dup"), (3, "dup"), (4, None), (5, "x" * 90)], "i long, raw string")
    got = {r.i: r.case_id for r in TS.dedup_ids(TS.safe_ids(rows, F.col("raw"), F.col("i"))).collect()}
    assert got == {1: "etc-passwd", 2: "dup", 3: "dup-3", 4: "row-4", 5: "x" * 90}


def test_variant_inputs(spark):
    df = spark.createDataFrame([("it holds",)], "assertion string")

    def inputs(**kw):
        return [(r.case_id, json.loads(r.input)) for r in TS.deterministic_cases(df, **kw).collect()]
    assert inputs(n=1) == [("nominal", {"prompt": "A representative request that should be handled normally. Under test: it holds"})]
    got = dict(inputs(n=6, adversarial=True, body={"query": "", "locale": "", "k": 3}))
    assert got["empty"] == {"query": "", "locale": "", "k": 3}
    assert got["hostile"]["locale"] == "test" and got["hostile"]["k"] == 3 and "Ignore all" in got["hostile"]["query"]
    assert set(got) == {"nominal", "hostile", "empty", "boundary", "nominal-5", "nominal-6"}


def test_intent_validation(spark):
    rows = [("A b", " Template ", "valid_json", None, "{}", None, "cat"), (None, "judge", None, 1.7, None, "says", None),
            ("x", "nope", None, None, None, None, None), ("y", "template", "missing", None, "[1]", None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)],
                               "i long, id string, how string, template string, threshold double, params string, assertion string, category string")
    got = {r.i: r for r in TS.validate_intents(df).collect()}
    assert got[1].case_id == "A-b" and got[1].assertion_filled == "intent A-b" and got[1].params_checked == "{}"
    assert got[2].case_id == "I2" and got[2].threshold_clamped == 1.0 and got[2].category_filled == "auto"
    assert got[3].reject_reason.startswith("how=nope") and got[4].reject_reason == "unknown template missing"


def test_reference_cascade(spark):
    reqs = spark.createDataFrame([(1, "R1", "The body is valid JSON", 1), (1, "R2", "Answers cite an article", 2), (2, "R5", "Only one", 1)],
                                 "doc_id long, req_id string, text string, position int")
    refs = [(1, "R2", ""), (1, "r 1", ""), (1, "Req 02", ""), (1, "auto", "cites the article"), (1, "R9", "unrelated"), (2, "??", ""), (3, "R1", "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(refs)], "n long, doc_id long, requirement_ref string, assertion string")
    got = {r.n: (r.resolved_ref, r.ref_reject is None) for r in SP.resolve_refs(df, reqs).collect()}
    assert got == {0: ("R2", True), 1: ("R1", True), 2: ("R2", True), 3: ("R2", True), 4: (None, False), 5: ("R5", True), 6: (None, False)}


def test_jsonl_lines_are_numbered_over_splits(spark, tmp_path):
    lines = [json.dumps({"id": str(i)}) if i % 7 else "" if i % 2 else "oops" for i in range(1, 4001)]
    (tmp_path / "d.jsonl").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = {r.line: r for r in SP.parsed_rows(SP.jsonl_rows(spark, str(tmp_path))).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {n for n, r in rows.items() if r.reason is None} == {i for i in range(1, 4001) if i % 7}
    bad = [n for n, r in rows.items() if r.reason]
    assert bad and all(rows[n].reason == f"d.jsonl:{n}: not valid JSON" and n % 14 == 0 for n in bad)


def test_dataset_rows_to_cases(spark):
    rows = ['{"id": "../../etc/passwd", "input": {"q": 1}, "context": {"k": "v"}}', '{"id": "dup", "a": 1, "kind": "edge"}',
            '{"id": "dup", "b": null}', '{"id": "x", "kind": "y", "context": {}}', '{"z": {"n": [1]}, "input": {}}']
    df = spark.createDataFrame([("d", i, r) for i, r in enumerate(rows, 1)], "ds string, i long, value string")
    got = {r.i: (r.case_id, r.kind, r.input, r.context, r.reason) for r in SP.dataset_cases(df, "ds", "i").collect()}
    assert got[1] == ("etc-passwd", "dataset", '{"q":1}', '{"k":"v"}', None)
    assert got[2] == ("dup", "edge", '{"a":1}', None, None) and got[3] == ("dup-3", "dataset", '{"b":null}', None, None)
    assert got[4][2] is None and got[4][4] == "dataset row 4 has no input fields"
    assert got[5] == ("row-5", "dataset", '{"input":{},"z":{"n":[1]}}', None, None)


def test_rubric_lint_names_the_first_fault(spark):
    level = "the response names the article"
    good = {"id": "ok1", "question": "Is it grounded?", "scale": {"0": level, "1": level, "2": level}}
    cases = [({"dimensions": [good, dict(good, id="ok2", min_score="1")]}, None), ({"dimensions": [good]}, "needs at least 2 dimensions"),
             ({"dimensions": [good, 3]}, "not an object"), ({"dimensions": [good, dict(good, id="a/b")]}, "id is not a slug"),
             ({"dimensions": [good, good]}, "duplicate id"), ({"dimensions": [good, dict(good, id="ok2", question="why")]}, "no usable question"),
             ({"dimensions": [good, dict(good, id="ok2", scale={"0": level, "1": level})]}, "missing scale level"),
             ({"dimensions": [good, dict(good, id="ok2", scale={"0": level, "1": "mostly good at all", "2": level})]}, "level is not an observable anchor"),
             ({"dimensions": [good, dict(good, id="ok2", min_score="x")]}, "non-numeric min_score"),
             ({"dimensions": [good, dict(good, id="ok2")], "min_score": 5}, "min_score outside the scale"), ([], "not an object")]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)], "k long, rubric string")
    got = {r.k: (r.usable, r.reason) for r in RB.lint(df, "k").collect()}
    assert got == {i: (why is None, why) for i, (_, why) in enumerate(cases)}


def test_config_edit_and_hash(spark):
    intents = spark.createDataFrame([(1, "I1", 1, "R1", "template", "valid_json", "{}", None, "a"), (1, "I2", 2, None, "judge", None, None, 0.8, "b")],
                                    "doc_id long, intent_id string, intent_order int, requirement_ref string, how string, template string, "
                                    "params string, threshold double, assertion string")
    none = spark.createDataFrame([], "doc_id long, intent_id string, case_order int, case_id string, input string, context string")
    checks = SP.config_checks(SP.assemble(SP.spec_rows(intents, none)), "doc_id")
    assert [(r.suite_id, r.case_id, r.type, r.params) for r in checks.orderBy("suite_pos").collect()] == [
        ("R1", "I1-nominal", "template", "{}"), ("unmapped", "I2-nominal", "judge", '{"threshold":0.8}')]
    versions = spark.createDataFrame([(1, "draft")], "doc_id long, status string")
    edits = spark.createDataFrame([(1, 1, "R1", "I1-nominal", 0, '{"a":1}'), (2, 1, "R1", "I1-nominal", 0, '{"a":2}'),
                                   (3, 1, "R1", "I1-nominal", 4, "{}"), (4, 1, "R9", "x", 0, "{}"), (5, 7, "R1", "x", 0, "{}")],
                                  "edit_id long, doc_id long, suite_id string, case_id string, check_index int, params string")
    after, judged = SP.edit_checks(checks, versions, edits, "doc_id")
    assert {r.edit_id: r.reason for r in judged.collect()} == {
        1: None, 2: None, 3: "check_index out of range", 4: "check not found", 5: "version not found"}
    assert after.where("suite_id = 'R1'").first().params == '{"a":2}'
    h = [SP.content_hashes(c, "doc_id").first() for c in (checks, after)]
    assert h[0].n_checks == 2 and h[0].content_hash != h[1].content_hash


def test_rehash_equals_a_new_tree(spark):
    """Hashing the path of an edit gives the tree that hashing everything gives; the rest is untouched."""
    rows = [(d, s, c, x, f"S{s}", f"C{s}-{c}", "template", "contains", None, f'{{"value":{x}}}')
            for d in (1, 2, 3) for s in range(3) for c in range(2) for x in range(2)]
    schema = ("doc_id long, suite_pos int, case_pos int, check_index int, suite_id string, case_id string, type string, uses string, "
              "rubric string, params string")
    checks = spark.createDataFrame(rows, schema)
    edited = spark.createDataFrame([(2, "S1", "C1-0", 1)], "doc_id long, suite_id string, case_id string, check_index int")
    after = spark.createDataFrame([(*r[:9], "new") if (r[0], r[4], r[5], r[3]) == (2, "S1", "C1-0", 1) else r for r in rows], schema)
    tree = SP.hash_tree(checks, "doc_id")
    cols = ["doc_id", "level", "suite_pos", "case_pos", "check_index", "hash", "n"]

    def nodes(t):
        return {tuple(r) for r in t.select(cols).collect()}
    new = nodes(SP.rehash(tree, after, edited, "doc_id"))
    assert new == nodes(SP.hash_tree(after, "doc_id")) and len(new) == 3 * (12 + 6 + 3 + 1)
    changed = new - nodes(tree)
    assert {(d, lv) for d, lv, *_ in changed} == {(2, "check"), (2, "case"), (2, "suite"), (2, "version")} and len(changed) == 4
    # versions 1 and 3 are equal, so are their roots; the edited one shares all cases but one
    assert [r.versions for r in SP.shared_nodes(SP.rehash(tree, after, edited, "doc_id"), "doc_id", "version").collect()] == [2]
    assert sorted(r.versions for r in SP.shared_nodes(SP.rehash(tree, after, edited, "doc_id"), "doc_id", "case").collect()) == [2, 3, 3, 3, 3, 3]


def test_running_numbers(spark):
    from proofline.operators.numbering import numbered
    df = spark.range(5000).selectExpr("case when id % 3 = 0 then id % 50 end as g", "(id * 7919) % 5000 as k").repartition(6)
    got = {}
    for r in numbered(df, "g", "k", "nth").collect():
        got.setdefault(r.g, []).append((r.nth, r.k))
    for rows in got.values():  # two thirds in one (null) group
        assert [n for n, _ in sorted(rows)] == list(range(1, len(rows) + 1))
        assert [k for _, k in sorted(rows)] == sorted(k for _, k in rows)
    assert len(got[None]) > 3000


def test_keywords_are_found_as_by_their_patterns(spark):
    words = ["json", "jsonb", "schema", "Latency", "ms", "items", "p95", "p9x", "under 5", "under", "city", "cites", "CITATION", "personal", "info", "pii", "storage",
             "completed the", "task", "finish", "\n", "déclined", "decline", ""]
    rng = random.Random(4)
    texts = [(i, " ".join(rng.choices(words, k=rng.randint(0, 5)))) for i in range(200)] + [(999, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("low", F.lower("text"))
    patterns = [x[0] for x in TS.TEMPLATE_RULES + TS.JUDGE_RULES] + ["a.c|", "x+"]
    got = df.select("doc_id", *[TS._found(F.col("low"), p).alias(f"p{i}") for i, p in enumerate(patterns)])
    text = dict(texts)
    for row in got.collect():
        want = [None if text[row.doc_id] is None else bool(re.search(p, text[row.doc_id].lower())) for p in patterns]
        assert list(row)[1:] == want
