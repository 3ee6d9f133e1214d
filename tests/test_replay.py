"""Replay of review logs against one attempt after the other in plain Python."""
import datetime as dt
import random

import pytest

from proofline.operators import replay as R
from proofline.operators import review as RV

START = dt.datetime(2024, 3, 1)
NEXT = {("submit", "pending"): "ready_for_review", ("return", "ready_for_review"): "pending", ("verdict", "ready_for_review"): "done"}
GOAL = {"submit": "ready_for_review", "return": "pending", "verdict": "done"}


def _judge(a, state, run, roles, case_runs):
    """(reason or None, state after), rule by rule."""
    _, _, _, kind, case, verdict, reason, actor = a
    may = roles.get(actor) in ("reviewer", "admin")
    if kind not in (*GOAL, "adjudicate"):
        return f"unknown kind {kind}", state
    if kind == "verdict":
        if verdict not in ("pass", "fail"):
            return "verdict must be 'pass' or 'fail'", state
        if not (reason or "").strip():
            return "reason required", state
    if kind in ("verdict", "adjudicate") and not may:
        return "actor lacks reviewer authority", state
    if state is None:
        return "report not found", state
    if kind == "adjudicate":
        if state == "done":
            return "report is locked", state
        if state != "ready_for_review":
            return "report is not ready_for_review", state
        if verdict is not None and not reason:
            return "reason required when setting a verdict", state
        return (None if case_runs.get(case) == run else "case not in report"), state
    new = NEXT.get((kind, state))
    return (None, new) if new else (f"illegal transition {state} -> {GOAL[kind]}", state)


@pytest.mark.parametrize("bucket", [60, 3600, 10 ** 8])
def test_replay_equals_one_by_one(spark, bucket):
    rng = random.Random(bucket)
    roles = {"ann": "admin", "bob": "reviewer", "cy": "runner"}
    reports = {i: (100 + i, rng.choice(["pending", "pending", "ready_for_review", "done"])) for i in range(12)}
    reports[0] = (100, "pending")
    case_runs = {i: 100 + i % 12 for i in range(40)}
    log = []
    for i in range(1500):
        report = 0 if i % 3 == 0 else rng.randrange(13)  # one report holds a third, one is unknown
        at = START + dt.timedelta(seconds=rng.choice([0, 60, 3600, rng.randrange(20_000)]))
        kind = rng.choice(["submit", "submit", "return", "adjudicate", "adjudicate", "verdict", "other"])
        verdict = rng.choice(["maybe"] * 20 + ["pass", "fail"]) if kind == "verdict" else rng.choice(["pass", "fail", None])
        log.append((report, at, i, kind, rng.choice([report, rng.randrange(40)]), verdict, rng.choice(["why", "why", " ", None]),
                    rng.choice(["ann", "bob", "bob", "cy", "nobody", None])))
    state, want = {k: v[1] for k, v in reports.items()}, {}
    for a in sorted(log, key=lambda a: (a[1], a[2])):
        before = state.get(a[0])
        why, now = _judge(a, before, reports.get(a[0], (None,))[0], roles, case_runs)
        want[a[2]] = (before, why, now)
        if a[0] in state:
            state[a[0]] = now
    assert {w for _, w, _ in want.values() if w is None} and any(w == "report is locked" for _, w, _ in want.values())
    out = R.replay_reviews(
        spark.createDataFrame(log, "report_id long, at timestamp, attempt_id long, kind string, case_id long, verdict string, reason string, actor string").repartition(5),
        spark.createDataFrame([(k, *v) for k, v in reports.items()], "report_id long, run_id long, state string"),
        spark.createDataFrame(list(roles.items()), "name string, role string"),
        spark.createDataFrame(list(case_runs.items()), "case_id long, run_id long"), "enforced", bucket)
    got = {r.attempt_id: (r.state_before, r.reject_reason, r.state_after) for r in out.collect()}
    assert got == want
    assert out.where("accepted != (reject_reason is null)").count() == 0


def test_functions_compose():
    for a in range(27):
        for b in range(27):
            assert [R.VALUES[b][v] for v in R.VALUES[a]] == R.VALUES[R.AFTER[a, b]].tolist()
    assert R.VALUES[R.moves("done")].tolist() == [0, 2, 2] and R.VALUES[R.IDENTITY].tolist() == [0, 1, 2]


def test_an_empty_log(spark):
    log = spark.createDataFrame([], "report_id long, at timestamp, attempt_id long, kind string, case_id long, verdict string, reason string, actor string")
    reports = spark.createDataFrame([(1, 1, "pending")], "report_id long, run_id long, state string")
    users = spark.createDataFrame([], "name string, role string")
    assert R.replay_reviews(log, reports, users, reports.selectExpr("run_id as case_id", "run_id")).count() == 0


def test_the_first_of_two_verdicts_locks(spark):
    """Two verdicts on one report: the second finds it done."""
    attempts = spark.createDataFrame([(1, 5, "pass", "fine", "ann"), (1, 6, "fail", "late", "ann"), (2, 7, "fail", " ", "ann"), (2, 8, "fail", "ok", "ann")],
                                     "report_id long, attempt_id long, verdict string, reason string, actor string")
    reports = spark.createDataFrame([(1, 1, "ready_for_review"), (2, 2, "ready_for_review")], "report_id long, run_id long, state string")
    users = spark.createDataFrame([("ann", "admin")], "name string, role string")
    sums = spark.createDataFrame([(1, 3, 2)], "run_id long, cases long, passed long")
    out = {r.attempt_id: (r.reject_reason, r.new_state) for r in RV.validate_verdicts(attempts, reports, users, sums, order=["attempt_id"]).collect()}
    assert out == {5: (None, "done"), 6: ("illegal transition done -> done", None), 7: ("reason required", None), 8: (None, "done")}
