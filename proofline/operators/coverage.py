"""Requirement coverage in both directions (AGG-7/8, JON-6/7, REL-9).

Refs match requirement ids literally; a NULL or empty ref is ``(unmapped)``. Counts
use the machine flag unless ``effective`` is asked for (deviation D-5).
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNMAPPED = "(unmapped)"


def ref_bucket(ref: str = "requirement_ref"):
    return F.coalesce(F.nullif(F.col(ref), F.lit("")), F.lit(UNMAPPED))


def tested(case_results: DataFrame, keys=(), flag: str = "passed") -> DataFrame:
    """AGG-7: per (keys, ref) the number of cases and of passing cases."""
    return case_results.groupBy(*keys, ref_bucket().alias("ref")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col(flag)).alias("passed"))


def by_requirement(requirements: DataFrame, case_results: DataFrame,
                   flag: str = "passed") -> DataFrame:
    """AGG-8: every requirement with total / passed / covered (left join)."""
    t = tested(case_results, flag=flag)
    j = requirements.join(t, requirements.req_id == t.ref, "left")
    return j.select("req_id", "text", "section",
                    F.coalesce("total", F.lit(0)).alias("total"),
                    F.coalesce("passed", F.lit(0)).alias("passed"),
                    (F.coalesce("total", F.lit(0)) > 0).alias("covered"))


def uncovered(requirements: DataFrame, case_results: DataFrame) -> DataFrame:
    """JON-6: requirements no case cites."""
    refs = case_results.select(F.col("requirement_ref").alias("req_id")).where(
        F.col("req_id").isNotNull()).distinct()
    return requirements.join(refs, "req_id", "left_anti")


def orphans(requirements: DataFrame, case_results: DataFrame) -> DataFrame:
    """JON-7: refs cited by cases but unknown, plus ``(unmapped)``."""
    refs = case_results.select(ref_bucket().alias("req_id")).distinct()
    return refs.join(requirements.select("req_id"), "req_id", "left_anti").withColumnRenamed(
        "req_id", "ref")


def run_requirements(runs: DataFrame, versions: DataFrame, key: str = "run_id",
                     version: str = "version_id") -> DataFrame:
    """SRC-6: (key, req_id, text, section, position): the requirement list of the version each
    run was built from; a run without version, or whose version has no text, has none.
    ``runs``: key, version. ``versions``: version and its split requirements."""
    return runs.select(key, version).join(versions, version).select(
        key, "req_id", "text", "section", "position")


def matrix(requirements: DataFrame, case_results: DataFrame, key: str = "run_id",
           flag: str = "passed") -> DataFrame:
    """AGG-8 per run: one row per requirement of the run and per reference its cases cite: key,
    ref, position, text, total, passed, known (in the run's list), covered."""
    t = tested(case_results, (key,), flag)
    r = requirements.select(key, F.col("req_id").alias("ref"), "position", "text", F.lit(True).alias("known"))
    zero = F.lit(0).cast("long")
    return r.join(t, [key, "ref"], "full_outer").select(
        key, "ref", "position", "text", F.coalesce("total", zero).alias("total"), F.coalesce("passed", zero).alias("passed"),
        F.coalesce("known", F.lit(False)).alias("known"), (F.coalesce("total", zero) > 0).alias("covered"))


def per_run(requirements: DataFrame, case_results: DataFrame, runs: DataFrame | None = None,
            key: str = "run_id", digits: int = 1) -> DataFrame:
    """AGG-8: coverage summary of every run: requirements covered / total and the percentage
    (NULL without a list), the uncovered requirements and the orphan references in order, and
    whether the list is known at all. ``runs`` adds runs without cases. The two lists hold one
    run's requirement ids."""
    m = matrix(requirements, case_results, key)
    ids = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(
        cond, F.struct(F.coalesce("position", F.lit(0)).alias("p"), F.col("ref"))))), lambda s: s["ref"])
    out = m.groupBy(key).agg(
        F.count_if("known").alias("requirements_total"),
        F.count_if(F.col("known") & F.col("covered")).alias("requirements_covered"),
        ids(F.col("known") & ~F.col("covered")).alias("uncovered"), ids(~F.col("known")).alias("orphans"))
    if runs is not None:
        out = runs.select(key).distinct().join(out, key, "left").select(
            key, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("requirements_total", "requirements_covered")],
            *[F.coalesce(c, F.expr("cast(array() as array<string>)")).alias(c) for c in ("uncovered", "orphans")])
    total, covered = F.col("requirements_total"), F.col("requirements_covered")
    return out.withColumn("covered_pct", F.when(total > 0, F.bround(covered / total * 100, digits))).withColumn(
        "known_requirements", total > 0)
