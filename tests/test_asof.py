"""As-of joins and baselines against plain Python."""
import datetime as dt
import random

from pyspark.sql import functions as F

from proofline.operators import results as RS
from proofline.operators.asof import asof_join

START = dt.datetime(2024, 1, 1)


def test_asof_join(spark):
    """One group and one moment hold most rows; ties, nulls, bucket borders, events after all."""
    rng = random.Random(3)

    def moment():
        return None if rng.random() < 0.02 else START + dt.timedelta(hours=rng.choice([0, 24, 24, 48, rng.randrange(400)]), microseconds=rng.choice([0, 0, 1]))

    def group():
        return rng.choice(["hot", "hot", "a", "b", None])
    rows = [(i, group(), moment()) for i in range(600)]
    events = [(i, group(), moment(), f"v{i}") for i in range(150)] + [(900, "late", START + dt.timedelta(days=99), "x")]
    rows += [(700, "late", START), (701, "unheard", START)]
    r = spark.createDataFrame(rows, "id long, g string, t timestamp").repartition(4)
    e = spark.createDataFrame(events, "seq long, g string, at timestamp, v string").repartition(3)
    want = {}
    for i, g, t in rows:
        before = [(at, seq, v) for seq, eg, at, v in events if g and t and eg == g and at and at < t]
        want[i] = max(before)[1:] if before else (None, None)
    for bucket in (3600, 86_400, 10 ** 9):
        got = asof_join(r, e, "g", "t", "at", "seq", ["seq", "v"], "id", bucket)
        assert got.columns == ["id", "g", "t", "seq", "v"]
        assert {x.id: (x.seq, x.v) for x in got.collect()} == want
    assert asof_join(r, e.limit(0), "g", "t", "at", "seq", ["seq"], "id").where("seq is not null").count() == 0


def test_comparison_of_all_runs(spark):
    day = dt.timedelta(days=1)
    runs = spark.createDataFrame([(1, "p", START), (2, "p", START + 2 * day), (3, "p", START + 5 * day), (4, "q", START)],
                                 "run_id long, project string, started_at timestamp")
    approved = spark.createDataFrame([(10, 1, "p", START + day), (20, 2, "p", START + 5 * day)],
                                     "report_id long, run_id long, project string, approved_at timestamp")
    base = RS.baseline_of_runs(runs, approved)
    # approved at the moment a run starts is not before it
    assert {r.run_id: r.baseline_run_id for r in base.collect()} == {1: None, 2: 1, 3: 1, 4: None}
    cases = spark.createDataFrame([(1, "a", True), (1, "b", False), (1, "c", True), (2, "a", False), (2, "b", True), (2, "d", True),
                                   (4, "a", True)], "run_id long, case_id string, passed boolean")
    got = RS.compare_runs_to_baselines(base, cases, ["case_id"])
    assert sorted((r.run_id, r.case_id, r.status) for r in got.collect()) == [
        (1, "a", "new"), (1, "b", "new"), (1, "c", "new"), (2, "a", "regressed"), (2, "b", "fixed"), (2, "c", "gone"),
        (2, "d", "new"), (3, "a", "gone"), (3, "b", "gone"), (3, "c", "gone"), (4, "a", "new")]


def test_a_hot_project_spreads_over_tasks(spark):
    """Runs of one project at one moment meet their baseline in more than one task."""
    runs = spark.range(4000).select(F.col("id").alias("run_id"), F.lit("p").alias("project"),
                                    F.lit(START + dt.timedelta(days=3)).cast("timestamp").alias("started_at"))
    approved = spark.createDataFrame([(1, 1, "p", START)], "report_id long, run_id long, project string, approved_at timestamp")
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = RS.baseline_of_runs(runs, approved).groupBy(F.spark_partition_id()).count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(r["count"] for r in out) == 4000 and max(r["count"] for r in out) < 2500
