"""Streaming progress: state, versions, replays, late files and restarts against the batch fold."""
import random

from proofline.streaming import progress as P

SCHEMA = "run_id long, suite_id string, case_id long, passed boolean"


def _drop(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def _table(spark, root, **kw):
    return P.ProgressTable(spark, f"{root}/progress", **kw)


def _want(rows):
    seen = {}
    for r in rows:
        seen.setdefault(r[:3], r)
    out = {}
    for run, *_, ok in seen.values():
        d, p = out.get(run, (0, 0))
        out[run] = (d + 1, p + ok)
    return out


def _got(df):
    return {r.run_id: (r.done, r.passed) for r in df.collect()}


def test_state_equals_the_batch_fold(spark, tmp_path):
    """Repeated and late deliveries over several restarts, snapshots in between."""
    rng, root = random.Random(1), str(tmp_path)
    cases = [(r, "s", c, rng.random() < 0.5) for r in range(6) for c in range(20)]
    cases += [(0, "s", c, True) for c in range(100, 220)]  # one run holds half of all
    totals = spark.createDataFrame([(r, 140 if r == 0 else 20 + (r == 5)) for r in range(6)], "run_id long, cases_total long")
    arrived, touched = [], []
    order = sorted(cases, key=lambda r: rng.random())
    drops = [order[i::4] + rng.sample(order, 15) for i in range(4)]
    for n, rows in enumerate(drops):
        _drop(spark, f"{root}/in", rows)
        arrived += rows
        table = _table(spark, root, compact_every=2)
        size = P.track_progress(spark.readStream.schema(SCHEMA).parquet(f"{root}/in"), table, f"{root}/cp", totals)
        assert _got(table.current()) == _want(arrived)
        assert {o["operator"]: o["rows"] for o in size} == {
            "dedupe": len({r[:3] for r in arrived}), "stateStoreSave": len({r[0] for r in arrived})}
        touched.append({r.run_id for r in spark.read.parquet(f"{root}/progress/delta/version={n}").collect()})
    assert table.versions("delta") == [0, 1, 2, 3] and table.versions("snapshot") == [1, 3]
    ready = {r.run_id: r["at"] for r in table.ready().collect()}
    assert sorted(ready) == [0, 1, 2, 3, 4]  # run 5 waits for a case that never comes
    for run, at in ready.items():
        total = 140 if run == 0 else 20
        assert len({r[:3] for d in drops[:at + 1] for r in d if r[0] == run}) == total
        assert len({r[:3] for d in drops[:at] for r in d if r[0] == run}) < total
    table.vacuum()
    assert table.versions("delta") == [] and table.versions("snapshot") == [3]
    assert _got(table.current()) == _want(arrived)


def test_a_batch_writes_only_the_runs_it_touched(spark, tmp_path):
    root = str(tmp_path)
    table = _table(spark, root)
    for rows in ([(r, "s", 1, True) for r in range(50)], [(7, "s", 2, False)], [(7, "s", 2, False)]):
        _drop(spark, f"{root}/in", rows)
        P.track_progress(spark.readStream.schema(SCHEMA).parquet(f"{root}/in"), table, f"{root}/cp")
    one = spark.read.parquet(f"{root}/progress/delta/version=1").collect()
    assert [(r.run_id, r.done, r.passed) for r in one] == [(7, 2, 1)]
    assert spark.read.parquet(f"{root}/progress/delta/version=2").count() == 0  # delivered again: nothing new
    assert _got(table.current())[7] == (2, 1) and len(_got(table.current())) == 50


def test_a_replayed_version_replaces_itself(spark, tmp_path):
    table = _table(spark, str(tmp_path), compact_every=2)
    totals = spark.createDataFrame([(1, 3), (2, 1)], "run_id long, cases_total long")

    def batch(rows):
        return spark.createDataFrame(rows, "run_id long, done long, passed long")
    table.upsert(batch([(1, 2, 1)]), 0, totals)
    for _ in range(2):  # the second time as after a crash behind the write, snapshot included
        table.upsert(batch([(1, 3, 2), (2, 1, 0)]), 1, totals)
        assert _got(table.current()) == {1: (3, 2), 2: (1, 0)}
        assert sorted((r.run_id, r["at"]) for r in table.ready().collect()) == [(1, 1), (2, 1)]
    table.upsert(batch([(1, 4, 2)]), 2, totals)  # more cases than expected: ready once only
    assert sorted((r.run_id, r["at"]) for r in table.ready().collect()) == [(1, 1), (2, 1)]
    # a version whose write never finished is not read
    batch([(1, 99, 99)]).withColumn("at", P.F.lit(3)).write.option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{tmp_path}/progress/delta/version=3")
    assert _got(table.current())[1] == (4, 2)
