"""Listings, paging and rollups (REL-1..7,10,11; JON-2..5,8; AGG-9..12)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.operators import paging

PAGE_SIZE = 50  # fixed value: rows per listing page


def report_filter(state: str | None = None, project: str | None = None,
                  verdict: str | None = None, reviewer: str | None = None,
                  project_like: str | None = None) -> Column:
    """REL-1: optional equality filters plus a case-insensitive project substring."""
    cond = F.lit(True)
    for col, val in (("state", state), ("project", project), ("verdict", verdict),
                     ("reviewer", reviewer)):
        if val is not None:
            cond = cond & (F.col(col) == F.lit(val))
    if project_like:
        cond = cond & F.lower(F.col("project")).contains(project_like.lower())
    return cond


def newest_first(df: DataFrame, at: str = "created_at", key: str = "report_id") -> DataFrame:
    return df.orderBy(F.col(at).desc(), F.col(key).desc())


def page(df: DataFrame, page_no: int, size: int = PAGE_SIZE, at: str = "created_at",
         key: str = "report_id") -> DataFrame:
    """REL-2: one page of the newest-first listing (paging is the feature here), at any depth."""
    return paging.page(df, page_no, size, at, key)


def _latest_done():
    """The verdict of the newest finished report, as an aggregate."""
    return F.max_by("verdict", F.when(F.col("state") == "done", F.struct("created_at", "report_id"))).alias("latest_verdict")


def project_rollup(reports: DataFrame, per_run: DataFrame, pipelines: DataFrame) -> DataFrame:
    """AGG-9: per project with a pipeline — pipelines, reports, verdict of the newest finished
    report, pass rate over all reports' cases (NULL without cases) and the last run time.

    ``per_run`` holds pre-aggregated (run_id, cases, passed) of *effective* results, as a
    report's summary does: the case table is one row per run before it meets the reports.
    """
    rep = reports.join(per_run, "run_id", "left").groupBy("project").agg(
        F.count(F.lit(1)).alias("report_count"), _latest_done(),
        F.sum("cases").alias("_cases"), F.sum("passed").alias("_passed"),
        F.max("created_at").alias("last_run_at"))
    pipes = pipelines.groupBy("project").agg(F.countDistinct("pipeline_id").alias("pipeline_count"))
    out = pipes.join(rep, "project", "left")
    rate = F.when(F.coalesce(F.col("_cases"), F.lit(0)) > 0,
                  F.round(F.col("_passed") * 100.0 / F.col("_cases"), 1))
    return out.select("project", "pipeline_count",
                      F.coalesce("report_count", F.lit(0)).alias("report_count"), "latest_verdict",
                      rate.alias("pass_rate"), "last_run_at")


def active_versions(versions: DataFrame) -> DataFrame:
    """WIN-4: per pipeline the active version with the highest number, and its drafts, newest
    first. A pipeline's drafts are what its authors have open."""
    active = versions.where("status = 'active'").groupBy("pipeline_id").agg(
        F.max_by(F.struct(F.col("version_id").alias("active_version_id"), F.col("version_number").alias("active_version")),
                 F.struct("version_number", "version_id")).alias("_a"))
    drafts = versions.where("status = 'draft'").groupBy("pipeline_id").agg(
        F.sort_array(F.collect_list("version_id"), asc=False).alias("drafts"))
    ids = versions.select("pipeline_id").distinct()
    return (ids.join(active, "pipeline_id", "left").join(drafts, "pipeline_id", "left")
            .select("pipeline_id", "_a.active_version_id", "_a.active_version",
                    F.coalesce("drafts", F.expr("cast(array() as array<bigint>)")).alias("drafts")))


def pipeline_rollup(pipelines: DataFrame, versions: DataFrame, runs: DataFrame, reports: DataFrame) -> DataFrame:
    """AGG-10: per pipeline its active version and, over the runs of that version only, reports,
    verdict of the newest finished one and the last run time. ``runs``: run_id, version_id,
    started_at; ``reports``: report_id, run_id, state, verdict, created_at."""
    act = active_versions(versions)
    per_version = runs.join(reports, "run_id", "left").groupBy("version_id").agg(
        F.count("report_id").alias("report_count"), _latest_done(), F.max("started_at").alias("last_run_at"))
    return (pipelines.join(act, "pipeline_id", "left")
            .join(per_version.withColumnRenamed("version_id", "active_version_id"), "active_version_id", "left")
            .select("pipeline_id", "active_version", F.coalesce("report_count", F.lit(0)).alias("report_count"),
                    "latest_verdict", "last_run_at", F.coalesce(F.size("drafts"), F.lit(0)).alias("n_drafts")))


def open_versions(versions: DataFrame, pipelines: DataFrame) -> DataFrame:
    """JON-3: active and draft versions with their pipeline, newest first."""
    return (versions.where(F.col("status").isin("draft", "active")).join(pipelines, "pipeline_id")
            .orderBy(F.col("version_id").desc()))


def pipeline_versions(versions: DataFrame, pipeline_id, statuses: list[str] | None = None) -> DataFrame:
    """REL-7: the versions of one pipeline by number, optionally of some statuses."""
    v = versions.where(F.col("pipeline_id") == F.lit(pipeline_id))
    v = v.where(F.col("status").isin(statuses)) if statuses else v
    return v.orderBy("version_number", "version_id")


def transcript(reports: DataFrame, case_results: DataFrame, report_id, case_id) -> DataFrame:
    """REL-10: request, response and checks of one case, only if it belongs to the report."""
    r = reports.where(F.col("report_id") == F.lit(report_id)).select("report_id", "run_id")
    return case_results.where(F.col("case_id") == F.lit(case_id)).join(r, "run_id").select(
        "report_id", "case_id", "request", "response", "checks")


def report_history(reports: DataFrame, transitions: DataFrame) -> DataFrame:
    """REL-11: every report with its transitions in order, one report's log per row."""
    log = transitions.groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct(
        "at", "transition_id", "from_state", "to_state", "actor"))).alias("_log"))
    lines = F.transform("_log", lambda t: F.concat_ws(" ", t["from_state"], F.lit("->"), t["to_state"],
                                                      F.lit("by"), t["actor"]))
    return reports.join(log, "report_id", "left").withColumn(
        "history", F.coalesce(lines, F.expr("cast(array() as array<string>)"))).drop("_log")


def run_progress(runs: DataFrame, case_results: DataFrame, key: str = "run_id",
                 total: str = "cases_total") -> DataFrame:
    """AGG-11: done / total per run and the rounded percentage."""
    done = case_results.groupBy(key).agg(F.count(F.lit(1)).alias("done"))
    j = runs.select(key, total).join(done, key, "left").withColumn(
        "done", F.coalesce("done", F.lit(0)))
    pct = F.when(F.col(total) > 0, F.bround(F.col("done") * 100.0 / F.col(total), 0).cast("long"))
    return j.withColumn("percent", F.coalesce(pct, F.lit(0).cast("long")))
