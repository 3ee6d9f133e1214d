"""Case results -> run summaries, costs, verdict policies, baselines (AGG-1..6,13,14;
CHK-22/23; JON-12).

All aggregates here are algebraic (count, sum, bool_and), so Spark combines them
map-side before the shuffle; a run holding a third of all cases costs one partial
row per input partition, not a hot reducer.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.operators.asof import SALTS, asof_join
from proofline.session import checkpoint_dir, partitions_for


def effective_passed(passed: Column, human_verdict: Column) -> Column:
    """A human verdict, when there is one, replaces the machine flag."""
    return F.coalesce(human_verdict == F.lit("pass"), passed)


def run_summary(case_results: DataFrame, keys=("run_id",), flag: str = "passed") -> DataFrame:
    """AGG-1 / AGG-3: {cases, passed, failed} per run (``flag`` picks machine or
    effective results)."""
    return case_results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(F.col(flag)).alias("passed")).withColumn(
        "failed", F.col("cases") - F.col("passed"))


def exact_cost(c: Column, scale: int = 8) -> Column:
    """Cost as an exact decimal (a missing cost is 0), so sums do not depend on the
    order in which partitions are combined."""
    return F.coalesce(c, F.lit(0.0)).cast(f"decimal(24,{scale})")


def rounded(total: Column, digits: int) -> Column:
    return F.round(total, digits).cast("double")


def run_cost(case_results: DataFrame, keys=("run_id",), cost: str = "cost_usd",
             digits: int = 6) -> DataFrame:
    """AGG-2: total cost per run, a missing cost counting 0 (exact decimal sum)."""
    return case_results.groupBy(*keys).agg(
        rounded(F.sum(exact_cost(F.col(cost))), digits).alias("total_cost_usd"))


def run_gate(case_flags: DataFrame, keys=("run_id",), flag: str = "passed") -> DataFrame:
    """CHK-23: a run (or suite) passes when every case does."""
    return case_flags.groupBy(*keys).agg(F.bool_and(F.col(flag)).alias("run_passed"))


def policy_inputs(case_results: DataFrame, tags: list[str], key: str = "run_id",
                  flag: str = "effective_passed", ref: str = "requirement_ref") -> DataFrame:
    """One row per run with everything the three pass policies need."""
    tagged = F.bool_and(F.when(F.col(ref).isin(tags), F.col(flag))) if tags else F.lit(None).cast("boolean")
    return case_results.groupBy(key).agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(F.col(flag)).alias("passed"),
        F.bool_and(F.col(flag)).alias("all_passed"),
        tagged.alias("tagged_passed"))


def suggested_verdict(reports: DataFrame, case_results: DataFrame, policy: dict,
                      key: str = "run_id", flag: str = "effective_passed") -> DataFrame:
    """AGG-4/5/6: the verdict a pass policy suggests for every report.

    ``policy`` = {"type": "all_required" | "threshold" | "must_pass_tags",
    "value": float, "tags": [...]}. Reports without any case are kept (left join)
    and pass under every policy.
    """
    kind = policy.get("type", "all_required")
    tags = list(policy.get("tags", []))
    agg = policy_inputs(case_results, tags, key, flag)
    j = reports.join(agg, key, "left")
    if kind == "threshold":
        value = float(policy.get("value", 1.0))
        ok = F.when(F.coalesce(F.col("cases"), F.lit(0)) == 0, True).otherwise(
            F.col("passed") / F.col("cases") >= F.lit(value))
    elif kind == "must_pass_tags":
        ok = F.coalesce(F.col("tagged_passed"), F.lit(True))
    else:
        ok = F.coalesce(F.col("all_passed"), F.lit(True))
    return j.withColumn("suggested_verdict", F.when(ok, "pass").otherwise("fail"))


def case_status() -> Column:
    """What became of a case, from current_passed and baseline_passed (null: no such case)."""
    return (F.when(F.col("baseline_passed").isNull(), "new")
            .when(F.col("current_passed").isNull(), "gone")
            .when(F.col("baseline_passed") & ~F.col("current_passed"), "regressed")
            .when(~F.col("baseline_passed") & F.col("current_passed"), "fixed")
            .otherwise("same"))


def compare_to_baseline(current: DataFrame, baseline: DataFrame, keys: list[str],
                        flag: str = "passed") -> DataFrame:
    """JON-12: per case, new / gone / regressed / fixed / same against a baseline run."""
    c = current.select(*keys, F.col(flag).alias("current_passed"))
    b = baseline.select(*keys, F.col(flag).alias("baseline_passed"))
    j = c.join(b, keys, "full_outer")
    return j.withColumn("status", case_status())


def baseline_of_runs(runs: DataFrame, approved: DataFrame, bucket_seconds: int = 86_400) -> DataFrame:
    """WIN-2 for every run: run_id, project, started_at, baseline_report_id, baseline_run_id of the
    report of its project approved last before it started (ties: the greater report; null
    without one). ``runs``: run_id, project, started_at; ``approved``: report_id, run_id, project,
    approved_at, reports that are done with verdict pass."""
    events = approved.select("project", "approved_at", F.col("report_id").alias("baseline_report_id"),
                             F.col("run_id").alias("baseline_run_id"))
    return asof_join(runs.select("run_id", "project", "started_at"), events, "project", "started_at", "approved_at",
                     "baseline_report_id", ["baseline_report_id", "baseline_run_id"], "run_id", bucket_seconds)


def compare_runs_to_baselines(runs: DataFrame, case_results: DataFrame, keys: list[str],
                              flag: str = "passed") -> DataFrame:
    """JON-12 for all runs at once: per run and case new / gone / regressed / fixed / same against
    the run's own baseline. ``runs``: run_id, baseline_report_id, baseline_run_id (as from
    ``baseline_of_runs``); a run without a baseline has only new cases. The cases of one baseline
    serve many runs, so they meet them under salts; both sides then meet per (run, case) in one
    aggregation. Every step is cut into as many partitions as its rows need: a baseline is taken to have as many
    cases as the average run."""
    spark = runs.sparkSession
    checkpoint_dir(spark)
    # kept: read four times
    runs = runs.select("run_id", "baseline_report_id", "baseline_run_id").checkpoint()
    cases = case_results.select("run_id", *keys, F.col(flag).alias("_flag"))
    n = partitions_for(spark, 2 * cases.count() + runs.count())
    salt = F.pmod(F.xxhash64("run_id"), F.lit(SALTS)).cast("int")
    asked = runs.where("baseline_run_id is not null").select(
        F.col("baseline_run_id").alias("_b"), F.col("run_id").alias("_for"), salt.alias("_salt"))
    base = (cases.join(asked.select(F.col("_b").alias("run_id")).distinct(), "run_id", "left_semi")
            .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    asked = asked.repartition(n, "_b", "_salt")
    old = base.repartition(n, "run_id", "_salt").join(
        asked, (F.col("run_id") == F.col("_b")) & (base["_salt"] == asked["_salt"])).select(
        F.col("_for").alias("run_id"), *keys, F.lit(None).cast("boolean").alias("_now"), F.col("_flag").alias("_was"))
    # the runs are the side kept in memory, so a run with very many cases is only read through
    by_run = runs.select("run_id", "baseline_report_id").repartition(n, "run_id")
    new = cases.repartition(n, "run_id").join(by_run.select("run_id").hint("shuffle_hash"), "run_id", "left_semi").select(
        "run_id", *keys, F.col("_flag").alias("_now"), F.lit(None).cast("boolean").alias("_was"))
    per = new.unionByName(old).repartition(n, "run_id", *keys).groupBy("run_id", *keys).agg(
        F.max("_now").alias("current_passed"), F.max("_was").alias("baseline_passed"))
    return per.repartition(n, "run_id").join(by_run.hint("shuffle_hash"), "run_id").withColumn("status", case_status())


def run_records(runs: DataFrame, case_results: DataFrame, failures: DataFrame | None = None,
                key: str = "run_id") -> DataFrame:
    """SNK-2 / REV-7: one record per run: status (``error`` where ``failures``: key, error_type,
    error_message has the run, else ``complete``), error text, total cost, summary and the state
    and first transition of its report (none for a failed run). A run without cases is complete
    with an empty summary."""
    summary = case_results.groupBy(key).agg(
        F.count(F.lit(1)).alias("cases"), F.count_if("passed").alias("passed"),
        rounded(F.sum(exact_cost(F.col("cost_usd"))), 6).alias("total_cost_usd"))
    out = runs.join(summary, key, "left")
    if failures is not None:
        out = out.join(failures, key, "left")
        failed = F.col("error_type").isNotNull()
        error = F.when(failed, F.concat(F.col("error_type"), F.lit(": "), F.coalesce("error_message", F.lit(""))))
    else:
        failed, error = F.lit(False), F.lit(None).cast("string")
    cases, passed = F.coalesce("cases", F.lit(0)), F.coalesce("passed", F.lit(0))
    return out.select(*runs.columns, F.when(failed, "error").otherwise("complete").alias("status"), error.alias("error"),
                      F.coalesce("total_cost_usd", F.lit(0.0)).alias("total_cost_usd"), cases.alias("cases"),
                      passed.alias("passed"), (cases - passed).alias("failed"),
                      F.when(~failed, "pending").alias("report_state"),
                      F.when(~failed, "run created").alias("transition_note"))


def token_rollup(responses: DataFrame, keys: list[str], usage: str = "usage") -> DataFrame:
    """AGG-13: input and output tokens per key from the usage (JSON text) of each response; a
    response without usage counts nothing but is counted."""
    u = F.try_parse_json(F.col(usage))

    def tokens(name: str):
        return F.sum(F.coalesce(F.try_variant_get(u, f"$.{name}", "bigint"), F.lit(0))).alias(name)
    return responses.groupBy(*keys).agg(F.count(F.lit(1)).alias("responses"),
                                        tokens("input_tokens"), tokens("output_tokens"))
