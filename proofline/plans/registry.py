"""Named queries over the test tables, each with its DuckDB-runnable oracle SQL.

A query is a function ``(spark, sf_dir) -> DataFrame``. ``sql`` is the same
computation in ANSI SQL over views named like the parquet tables; ``None`` marks a
query whose semantics SQL cannot state (streaming, user functions, model calls).
"""
from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}
HEADLINE: list[str] = []


def query(name: str, sql: str | None = None, headline: bool = False):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query name {name}")

        def run(spark, sf_dir):
            # a session built elsewhere (the driver's) still gets the confs the
            # semantics depend on: UTC, last-wins duplicate JSON keys
            from proofline.session import apply_defaults
            apply_defaults(spark)
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql.strip()
        if headline:
            HEADLINE.append(name)
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from proofline.plans import (  # noqa: F401
        q_checks, q_results, q_review, q_rollups, q_judge, q_testsets, q_reports, q_udf,
        q_rules, q_specs, q_streaming)
