"""Ordered replay of review attempts (REV-1, REV-3, REV-4).

Whether an attempt is accepted depends on the state its report is in, which earlier attempts
decide: a verdict locks the report for all that follow. An attempt is therefore taken as a
function on the few report states (it moves one state to another, or changes nothing), and
functions compose associatively. The log of a report is cut into buckets of time; each bucket is
composed to one function in its own task, the functions of a report, one small row a bucket, give
the state in which each bucket begins, and every bucket is replayed from there. So a report that
holds a third of the log is many groups, read once in order, a batch at a time.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.operators.asof import bucket_of
from proofline.operators.review import VALID_TRANSITIONS, actor_reason

STATES = ["pending", "ready_for_review", "done"]
N = len(STATES)
# A function on the states is the number whose digits in base N are its values.
IDENTITY = sum(i * N ** i for i in range(N))
VALUES = np.array([[code // N ** i % N for i in range(N)] for code in range(N ** N)])
_KINDS = {"submit": "ready_for_review", "return": "pending", "verdict": "done"}


def move(old: str, new: str) -> int:
    """The function that takes ``old`` to ``new`` and leaves the other states."""
    o, n = STATES.index(old), STATES.index(new)
    return IDENTITY + (n - o) * N ** o


def moves(target: str) -> int:
    """The function of a transition to ``target``: every state from which it is legal goes there."""
    return IDENTITY + sum(move(a, b) - IDENTITY for a, b in VALID_TRANSITIONS if b == target)


def after(code: int, then: int) -> int:
    """``then`` after ``code``."""
    return sum(int(VALUES[then][v]) * N ** i for i, v in enumerate(VALUES[code]))


AFTER = np.array([[after(a, b) for b in range(N ** N)] for a in range(N ** N)])


def _runs(report: pa.Array, bucket: np.ndarray) -> np.ndarray:
    """First rows of the (report, bucket) groups of sorted rows."""
    if not len(report):
        return np.zeros(0, np.int64)
    codes = report.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    new = np.ones(len(codes), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (bucket[1:] != bucket[:-1])
    return np.flatnonzero(new)


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (report, bucket, ..., code) -> one composed code per report and bucket."""
    names = ["_report", "_bucket", "_code"]
    open_key, open_code = None, IDENTITY
    kind = None
    for b in batches:
        kind = b.schema.field(0).type
        bucket = b.column(1).to_numpy(zero_copy_only=False)
        code = b.column(4).to_numpy(zero_copy_only=False)
        starts = _runs(b.column(0), bucket)
        done: list[tuple] = []
        for a, z in zip(starts, [*starts[1:], b.num_rows], strict=True):
            key = (b.column(0)[int(a)].as_py(), int(bucket[a]))
            if key != open_key:
                if open_key is not None:
                    done.append((*open_key, open_code))
                open_key, open_code = key, IDENTITY
            part = code[a:z]
            for c in part[part != IDENTITY].tolist():
                open_code = int(AFTER[open_code, c])
        if done:
            yield _batch(done, kind, names)
    if open_key is not None:
        yield _batch([(*open_key, open_code)], kind, names)


def _batch(rows: list[tuple], kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
    report, bucket, value = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(report, kind), pa.array(bucket, pa.int64()),
                                       pa.array(value, pa.int32())], names=names)


def _entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (report, bucket, code, initial) -> the state in which each bucket begins."""
    last, state = None, None
    for b in batches:
        rows = []
        for report, bucket, code, initial in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if (report,) != last:
                last, state = (report,), initial
            rows.append((report, bucket, state))
            state = None if state is None else int(VALUES[code][state])
        if rows:
            yield _batch(rows, b.schema.field(0).type, ["_report", "_bucket", "_entry"])


def replay(attempts: DataFrame, reports: DataFrame, code: Column, report: str = "report_id", at: str = "at",
           seq: str = "attempt_id", bucket_seconds: int = 86_400) -> DataFrame:
    """The attempts with ``state_before``: the state of their report when they are made, in the order of
    (at, seq). ``code``: what an attempt does to the states if that is all that decides;
    ``reports``: one row per report with its initial ``state``; an attempt on an unknown report
    has none. A null time comes first."""
    own = attempts.columns
    bucket = F.coalesce(bucket_of(F.col(at), bucket_seconds), F.lit(-1 << 62))
    rows = attempts.select(*own, bucket.alias("_bucket"), code.cast("int").alias("_code"))
    kind = attempts.schema[report].dataType.simpleString()
    narrow = rows.select(F.col(report).alias("_report"), "_bucket", F.col(at).alias("_at"), F.col(seq).alias("_seq"), "_code")
    composed = (narrow.repartition("_report", "_bucket").sortWithinPartitions("_report", "_bucket", "_at", "_seq")
                .mapInArrow(_composed, f"_report {kind}, _bucket long, _code int"))
    index = F.array_position(F.array(*map(F.lit, STATES)), F.col("state")).cast("int") - 1
    initial = reports.select(F.col(report).alias("_of"), F.when(index >= 0, index).alias("_initial"))
    entered = (composed.join(initial, F.col("_report") == F.col("_of"), "left")
               .select("_report", "_bucket", "_code", "_initial")
               .repartition("_report").sortWithinPartitions("_report", "_bucket")
               .mapInArrow(_entered, f"_report {kind}, _bucket long, _entry int"))
    # one row with the entry state leads the rows of its bucket
    lead = entered.select(*[F.col("_report").alias(c) if c == report else F.lit(None).cast(attempts.schema[c].dataType).alias(c)
                            for c in own], "_bucket", F.lit(IDENTITY).alias("_code"), "_entry", F.lit(0).alias("_lead"))
    both = rows.select(*own, "_bucket", "_code", F.lit(None).cast("int").alias("_entry"), F.lit(1).alias("_lead")).unionByName(lead)
    n = len(own)

    def replayed(batches):
        open_key, state = None, -1
        for b in batches:
            bucket, codes = (b.column(i).to_numpy(zero_copy_only=False) for i in (n, n + 1))
            leads = b.column(n + 3).to_numpy(zero_copy_only=False) == 0
            entry = b.column(n + 2).fill_null(-1).to_numpy(zero_copy_only=False)
            before = np.empty(b.num_rows, np.int32)
            starts = _runs(b.column(own.index(report)), bucket)
            for a, z in zip(starts, [*starts[1:], b.num_rows], strict=True):
                key = (b.column(own.index(report))[int(a)].as_py(), int(bucket[a]))
                if key != open_key:
                    open_key, state = key, int(entry[a])
                at = a
                for i in (a + np.flatnonzero(codes[a:z] != IDENTITY)).tolist() if state >= 0 else ():
                    before[at:i + 1] = state
                    state, at = int(VALUES[codes[i]][state]), i + 1
                before[at:z] = state
            names = pa.array([*STATES, None], pa.string()).take(pa.array(np.where(before < 0, N, before)))
            kept = pa.array(~leads)
            yield pa.RecordBatch.from_arrays([*(c.filter(kept) for c in b.columns[:n]), names.filter(kept)],
                                             names=[*own, "state_before"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in attempts.schema)
    return (both.repartition(report, "_bucket").sortWithinPartitions(report, "_bucket", "_lead", at, seq)
            .mapInArrow(replayed, f"{schema}, state_before string"))


def replay_reviews(attempts: DataFrame, reports: DataFrame, users: DataFrame, case_runs: DataFrame,
                   mode: str = "open", bucket_seconds: int = 86_400) -> DataFrame:
    """A whole log of attempts judged one after the other per report: the attempts with
    state_before, accepted, reject_reason (the first rule broken) and state_after.

    ``attempts``: report_id, at, attempt_id, kind, case_id, verdict, reason, actor, where kind is
    submit (to ready_for_review), return (to pending), adjudicate (one case; a null verdict clears
    it) or verdict (of the report, which locks it). ``reports``: report_id, run_id, state (before the
    log); ``users``: name, role; ``case_runs``: case_id, run_id. An unknown kind is rejected."""
    n_users = users.limit(1).count()
    j = (attempts.join(reports.select("report_id", F.col("run_id").alias("_run")), "report_id", "left")
         .join(users.select(F.col("name").alias("actor"), F.col("role").alias("_role")), "actor", "left")
         .join(case_runs.select("case_id", F.col("run_id").alias("_case_run")).distinct(), "case_id", "left"))
    who = actor_reason(F.col("actor"), F.col("_role"), n_users, mode)
    kind, verdict = F.col("kind"), F.col("verdict")
    of_verdict = (F.when(~F.coalesce(verdict.isin("pass", "fail"), F.lit(False)), "verdict must be 'pass' or 'fail'")
                  .when(F.coalesce(F.trim("reason"), F.lit("")) == "", "reason required").when(who.isNotNull(), who))
    # rules that hold before the state is looked at, and those after it
    first = F.when(kind == "verdict", of_verdict).when(kind == "adjudicate", who).when(
        ~F.coalesce(kind.isin(*_KINDS, "adjudicate"), F.lit(False)), F.concat(F.lit("unknown kind "), F.coalesce(kind, F.lit("null"))))
    last = F.when(kind == "adjudicate", F.when(verdict.isNotNull() & (F.coalesce(F.col("reason"), F.lit("")) == ""),
                                               "reason required when setting a verdict")
                  .when(F.col("_case_run").isNull() | F.col("_run").isNull() | (F.col("_case_run") != F.col("_run")),
                        "case not in report"))
    flat = j.select(*attempts.columns, first.alias("_first"), last.alias("_last"))
    code = F.lit(IDENTITY)
    for name, target in _KINDS.items():
        code = F.when((kind == name) & F.col("_first").isNull(), F.lit(moves(target))).otherwise(code)
    state = F.col("state_before")
    illegal = F.lit(None).cast("string")
    to = F.lit(None).cast("string")
    for name, target in _KINDS.items():
        legal = [a for a, b in VALID_TRANSITIONS if b == target]
        illegal = F.when(kind == name, F.when(~state.isin(legal), F.concat(F.lit("illegal transition "), state, F.lit(f" -> {target}")))
                         ).otherwise(illegal)
        to = F.when(kind == name, F.lit(target)).otherwise(to)
    illegal = F.when(kind == "adjudicate", F.when(state == "done", "report is locked").when(
        state != "ready_for_review", "report is not ready_for_review")).otherwise(illegal)
    why = F.coalesce("_first", F.when(state.isNull(), "report not found"), illegal, "_last")
    out = replay(flat, reports, code, bucket_seconds=bucket_seconds).withColumn("reject_reason", why)
    return out.withColumn("accepted", F.col("reject_reason").isNull()).withColumn(
        "state_after", F.when(F.col("accepted"), F.coalesce(to, state)).otherwise(state)).drop("_first", "_last")
