"""SparkSession defaults shared by tests, the bench and the driver entry points."""
from __future__ import annotations

import math
import tempfile

from pyspark.sql import SparkSession

# Session settings every job relies on. Timezone is pinned so timestamp output is
# reproducible; duplicate JSON keys resolve last-wins (as Python's json does).
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "proofline") -> SparkSession:
    """Return the active session or build one with :data:`SESSION_DEFAULTS`.

    On a cluster the launcher owns master and sizing; locally (tests, bench) the
    caller passes ``master`` and a shuffle-partition count that matches the cores.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    apply_defaults(spark)
    return spark


def apply_defaults(spark: SparkSession) -> None:
    """Set the SQL confs this library's semantics depend on (idempotent)."""
    for key in ("spark.sql.session.timeZone", "spark.sql.variant.allowDuplicateKeys"):
        spark.conf.set(key, SESSION_DEFAULTS[key])


# Rows of a partition where a step keeps them in memory (a sort, a hash map).
ROWS_PER_PARTITION = 250_000


def partitions_for(spark: SparkSession, rows: int) -> int:
    """How many partitions ``rows`` are cut into, so that a task's memory does not grow with the table; never
    fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / ROWS_PER_PARTITION))


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only where the session names none: ``fallback``, or with a local master (tests) a
    temporary folder. On a cluster the setting is required, since a machine-local folder is
    lost with its machine. Lineage is cut with ``DataFrame.checkpoint()`` into this folder,
    never with local checkpoints.
    """
    context = spark.sparkContext
    own = context._jsc.sc().getCheckpointDir()
    path = spark.conf.get("spark.checkpoint.dir", None) or (own.get() if own.isDefined() else fallback)
    if not path:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="proofline-ckpt-")
    if own.isEmpty():
        context.setCheckpointDir(path)
    return path.rstrip("/")
