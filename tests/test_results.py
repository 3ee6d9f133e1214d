"""Gates, policies, coverage, adjudication (CHK-22, AGG-3..8, WIN-7, JON-6/7/12)."""
import random

from pyspark.sql import functions as F

from proofline import session
from proofline.operators import coverage as COV
from proofline.operators import results as RS
from proofline.operators import review as RV
from proofline.operators.evaluate import case_gate


def test_case_gate_required_only_and_empty(spark):
    res = spark.createDataFrame([(1, True, True), (1, False, False), (2, False, True)],
                                "case_id long, passed boolean, required boolean")
    cases = spark.createDataFrame([(1,), (2,), (3,)], "case_id long")
    got = {r.case_id: r.passed for r in case_gate(res, ["case_id"], cases).collect()}
    assert got == {1: True, 2: False, 3: True}


def test_policies(spark):
    reports = spark.createDataFrame([(10, 1), (11, 2)], "report_id long, run_id long")
    cases = spark.createDataFrame([(1, True, "R1"), (1, False, "R2")],
                                  "run_id long, effective_passed boolean, requirement_ref string")
    def v(policy):
        return {r.report_id: r.suggested_verdict
                for r in RS.suggested_verdict(reports, cases, policy).collect()}
    assert v({"type": "all_required"}) == {10: "fail", 11: "pass"}   # empty run passes
    assert v({"type": "threshold", "value": 0.5}) == {10: "pass", 11: "pass"}
    assert v({"type": "must_pass_tags", "tags": ["R1"]}) == {10: "pass", 11: "pass"}
    assert v({"type": "must_pass_tags", "tags": ["R2"]}) == {10: "fail", 11: "pass"}




def test_coverage_both_directions(spark):
    reqs = spark.createDataFrame([("R1", "a", None), ("R2", "b", None), ("R3", "c", None)],
                                 "req_id string, text string, section string")
    cases = spark.createDataFrame([("R1", True), ("R2", False), ("R9", True), (None, True), ("", False)],
                                  "requirement_ref string, passed boolean")
    by = {r.req_id: (r.total, r.passed, r.covered) for r in COV.by_requirement(reqs, cases).collect()}
    assert by == {"R1": (1, 1, True), "R2": (1, 0, True), "R3": (0, 0, False)}
    assert [r.req_id for r in COV.uncovered(reqs, cases).collect()] == ["R3"]
    assert sorted(r.ref for r in COV.orphans(reqs, cases).collect()) == ["(unmapped)", "R9"]


def test_coverage_per_run(spark):
    req = spark.createDataFrame([(1, f"R{i}", f"t{i}", None, i) for i in range(1, 17)] + [(2, "R1", "a", None, 1)],
                                "run_id long, req_id string, text string, section string, position int")
    cases = spark.createDataFrame([(1, "R2", True), (1, "R2", False), (1, "R99", True), (1, None, True), (4, "R1", True)],
                                  "run_id long, requirement_ref string, passed boolean")
    runs = spark.createDataFrame([(1,), (2,), (3,), (4,)], "run_id long")
    got = {r.run_id: r for r in COV.per_run(req, cases, runs).collect()}
    assert (got[1].requirements_covered, got[1].requirements_total, got[1].covered_pct) == (1, 16, 6.2)   # half-even
    assert got[1].uncovered == ["R1"] + [f"R{i}" for i in range(3, 17)] and got[1].orphans == ["(unmapped)", "R99"]
    assert got[2].covered_pct == 0.0 and got[2].uncovered == ["R1"] and got[2].known_requirements
    assert got[3].covered_pct is None and not got[3].known_requirements
    assert got[4].orphans == ["R1"] and got[4].covered_pct is None


def test_adjudication_set_then_clear(spark):
    log = spark.createDataFrame(
        [(7, 1, "2024-01-01 00:00:00", "set", "pass", "ann"), (7, 2, "2024-01-02 00:00:00", "clear", None, "bob")],
        "case_id long, adjudication_id long, at string, action string, verdict string, actor string")
    r = RV.effective_adjudication(log, ["case_id"]).first()
    assert r.human_verdict is None and r.actor == "bob"


def test_baseline_statuses(spark):
    base = spark.createDataFrame([(1, True), (2, False), (3, True), (4, True)], "k long, passed boolean")
    cur = spark.createDataFrame([(1, False), (2, True), (3, True), (5, True)], "k long, passed boolean")
    got = {r.k: r.status for r in RS.compare_to_baseline(cur, base, ["k"]).collect()}
    assert got == {1: "regressed", 2: "fixed", 3: "same", 4: "gone", 5: "new"}


def test_illegal_transitions(spark):
    log = spark.createDataFrame([(1, 1, 1, None, "ready_for_review"), (1, 2, 2, None, "done"), (1, 3, 3, None, "pending"),
                                 (2, 1, 1, None, "done"), (3, 1, 1, "done", "ready_for_review"), (4, 1, 1, "pending", "pending")],
                                "report_id long, transition_id long, at long, from_state string, to_state string")
    bad = {(r.report_id, r.transition_id, r.from_state, r.actual_state) for r in
           RV.illegal_transitions(log, "report_id", "at", "transition_id").collect()}
    assert bad == {(1, 3, None, "done"), (2, 1, None, "pending"), (3, 1, "done", "pending")}
    reports = spark.createDataFrame([(1,), (9,)], "report_id long")
    fold = {r.report_id: r.state for r in RV.state_fold(log, reports, "report_id", "at", "transition_id").collect()}
    assert fold == {1: "pending", 9: "pending"}


def test_adjudication_and_verdict_rules(spark):
    users = spark.createDataFrame([("ann", "reviewer"), ("bob", "runner")], "name string, role string")
    reports = spark.createDataFrame([(1, 11, "ready_for_review"), (2, 12, "done"), (3, 13, "pending")], "report_id long, run_id long, state string")
    cases = spark.createDataFrame([(100, 11), (200, 12)], "case_id long, run_id long")
    tries = [(1, 100, "ann", "pass", "why"), (1, 100, "bob", "pass", "why"), (1, 100, "ann", "pass", ""), (1, 100, "ann", "pass", "  "),
             (1, 100, "ann", None, None), (1, 200, "ann", "pass", "why"), (2, 200, "ann", "pass", "why"), (3, 100, "ann", "pass", "why"), (9, 100, "ann", "pass", "w")]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(tries)], "n long, report_id long, case_id long, actor string, verdict string, reason string")
    got = {r.n: r.reject_reason for r in RV.validate_adjudications(df, reports, users, cases).collect()}
    assert got == {0: None, 1: "actor lacks reviewer authority", 2: "reason required when setting a verdict", 3: None, 4: None,
                   5: "case not in report", 6: "report is locked", 7: "report is not ready_for_review", 8: "report not found"}
    none = users.limit(0)
    assert {r.reject_reason for r in RV.validate_adjudications(df, reports, none, cases, "enforced").collect()} == {"no reviewer accounts configured"}
    assert {r.n for r in RV.validate_adjudications(df, reports, none, cases, "open").where("accepted").collect()} == {0, 1, 3, 4}
    summaries = spark.createDataFrame([(11, 4, 3)], "run_id long, cases long, passed long")
    v = {r.n: (r.reject_reason, r.new_state, r.cases) for r in RV.validate_verdicts(df, reports, users, summaries).collect()}
    assert v[0] == (None, "done", 4) and v[3] == ("reason required", None, None) and v[4][0] == "verdict must be 'pass' or 'fail'"
    assert v[7][0] == "illegal transition pending -> done" and v[1][0] == "actor lacks reviewer authority"


def test_runs_meet_baselines_in_as_many_tasks_as_rows_need(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_PARTITION", 100)
    rng = random.Random(2)
    runs = [(i, 7 if i > 7 else None, 7 if i > 7 else None) for i in range(200)] + [(9, 7, 7)]
    cases = [(i, c, rng.random() < 0.5) for i in range(200) for c in range(5) if rng.random() < 0.8] + [(500, 1, True)]
    r = spark.createDataFrame(runs, "run_id long, baseline_report_id long, baseline_run_id long")
    c = spark.createDataFrame(cases, "run_id long, case_no int, passed boolean")
    out = RS.compare_runs_to_baselines(r, c, ["case_no"])
    now = {(i, k): p for i, k, p in cases}
    want = sorted((i, k, now.get((i, k)), now.get((b, k)), b) for i, b, _ in runs for k in range(5) if (i, k) in now or (b, k) in now)
    got = [(x.run_id, x.case_no, x.current_passed, x.baseline_passed, x.baseline_report_id) for x in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert out.rdd.getNumPartitions() == -(-(2 * len(cases) + len(runs)) // 100)
