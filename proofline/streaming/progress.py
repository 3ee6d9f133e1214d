"""Responses that are still arriving (STR-1..4), as Structured Streaming.

* STR-1 — the check results of each response are stored as it arrives (SNK-1): every
  micro-batch is appended to the results table under its own batch id.
* STR-4 — nothing is dropped and nothing counts twice. A batch that is replayed after a
  failure overwrites its own folder. A response that is delivered again in another batch,
  however late, is stored again and counted once: a case is its key (run, suite, case), and
  its first delivery decides. There is no watermark, so no response is too late.
* STR-3 / STR-2 — progress per run lives in the stream's state: cases are de-duplicated exactly by
  key (no watermark), what is left is counted per run, and a micro-batch hands on only the runs it
  touched. ``ProgressTable`` takes them as one version each, folds versions into a snapshot now
  and then, and notes once for every run that it became ``ready_for_review`` (never ``done``).
  Of deliveries of one case in one micro-batch with different results any one may count; the
  state and the table take the same one. The fold over the stored cases (``stored_cases``) gives
  the same numbers and needs no state.

The caller names the tables and the checkpoint folders, in storage that all executors share; a
restart on the same ones goes on where the last run ended. The state holds one key per case
ever seen: on a large stream choose the RocksDB state store
(``spark.sql.streaming.stateStore.providerClass``), which keeps it on disk.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.operators.checks import Check
from proofline.operators.evaluate import check_columns, gate_column, with_body

CASE = ["run_id", "suite_id", "case_id"]


def response_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None,
                    glob: str | None = None) -> DataFrame:
    """File stream of captured responses, all of them."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def checked(stream: DataFrame, checks: list[Check], keys: list[str], *, text=None,
            body: str = "body", latency: str = "latency_ms") -> DataFrame:
    """STR-1: per arriving response its key, its check results and the case gate (stateless)."""
    df = with_body(stream, body)
    cols = check_columns(checks, text=text, latency=latency, cost=None)
    return df.select(*keys, F.array(*cols).alias("checks"), gate_column(cols).alias("passed"))


def store_batch(batch: DataFrame, batch_id: int, results_path: str) -> None:
    """SNK-1 for one micro-batch: its folder is written whole, so a replay replaces it."""
    batch.write.mode("overwrite").parquet(f"{results_path}/batch_id={batch_id}")


def store_results(stream: DataFrame, results_path: str, checkpoint: str) -> None:
    """Run the stream over all that has arrived (``availableNow``) into the results table."""
    q = (stream.writeStream
         .foreachBatch(lambda b, i: store_batch(b, i, results_path))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def stored_cases(spark: SparkSession, results_path: str, keys: list[str] | None = None) -> DataFrame:
    """One row per case: the results of its first delivery (an algebraic aggregate)."""
    keys = keys or CASE
    t = spark.read.parquet(results_path)
    return t.groupBy(*keys).agg(F.min_by(
        F.struct("passed", "checks"), F.struct("batch_id", F.xxhash64("checks"))).alias("_r")
    ).select(*keys, "_r.passed", "_r.checks")


def counts(cases: DataFrame, key: str = "run_id") -> DataFrame:
    return cases.groupBy(key).agg(F.count(F.lit(1)).alias("done"), F.count_if("passed").alias("passed"))


def states(done: DataFrame, totals: DataFrame, key: str = "run_id") -> DataFrame:
    """STR-2/3 per expected run: done, passed, cases_total, state. ``totals``: key, cases_total."""
    return totals.join(done, key, "left").select(
        key, F.coalesce("done", F.lit(0)).alias("done"), F.coalesce("passed", F.lit(0)).alias("passed"),
        "cases_total", F.when(F.coalesce("done", F.lit(0)) >= F.col("cases_total"), "ready_for_review")
        .otherwise("pending").alias("state"))


def progress(cases: DataFrame, totals: DataFrame, key: str = "run_id") -> DataFrame:
    """Progress per expected run from one row per case."""
    return states(counts(cases, key), totals, key)


class ProgressTable:
    """Counters of runs as a versioned table: ``delta/version=n`` holds the runs that micro-batch n
    touched, ``snapshot/version=n`` one row per run as of version n, ``ready/version=n`` the runs that
    got all their cases in batch n. Every folder is written whole and counts once it is complete,
    so writing a version again replaces it and reading never meets half of one."""

    def __init__(self, spark: SparkSession, path: str, key: str = "run_id", compact_every: int = 10):
        self.spark, self.path, self.key, self.compact_every = spark, path.rstrip("/"), key, compact_every

    def _folder(self, kind: str, version: int) -> str:
        return f"{self.path}/{kind}/version={version}"

    def versions(self, kind: str) -> list[int]:
        """Complete versions of a kind, ascending."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = fs.listStatus(root) if fs.exists(root) else []
        return sorted(int(f.getPath().getName().split("=")[1]) for f in found
                      if fs.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS")))

    def current(self, before: int | None = None) -> DataFrame:
        """key, done, passed as of the last version (below ``before``): the newest snapshot and the
        deltas after it, the last version of a run deciding. No version yet: no rows."""
        def known(kind):
            return [v for v in self.versions(kind) if before is None or v < before]
        base = known("snapshot")[-1:]
        folders = ([self._folder("snapshot", v) for v in base]
                   + [self._folder("delta", v) for v in known("delta") if not base or v > base[0]])
        if not folders:
            raise LookupError(f"no version of {self.path}")
        last = F.max_by(F.struct("done", "passed"), "at").alias("_last")
        return self.spark.read.parquet(*folders).groupBy(self.key).agg(last).select(self.key, "_last.*")

    def upsert(self, batch: DataFrame, version: int, totals: DataFrame | None = None) -> None:
        """The touched runs of one micro-batch (key, done, passed) as version ``version``."""
        delta = self._folder("delta", version)
        # one action on the batch: a second one would run its stateful plan again
        batch.select(self.key, "done", "passed", F.lit(version).alias("at")).write.mode("overwrite").parquet(delta)
        if totals is not None:
            self._ready(self.spark.read.parquet(delta), version, totals).write.mode("overwrite").parquet(
                self._folder("ready", version))
        if (version + 1) % self.compact_every == 0:
            self.current(before=version + 1).withColumn("at", F.lit(version)).write.mode("overwrite").parquet(
                self._folder("snapshot", version))

    def _ready(self, touched: DataFrame, version: int, totals: DataFrame) -> DataFrame:
        now = touched.join(totals, self.key).where("done >= cases_total")
        if any(v < version for v in self.versions("delta")):
            old = self.current(before=version).select(self.key, F.col("done").alias("_before"))
            now = now.join(old, self.key, "left").where("_before is null or _before < cases_total")
        return now.select(self.key, "done", "passed", "cases_total", F.lit("ready_for_review").alias("state"), "at")

    def ready(self) -> DataFrame:
        """STR-2: one row per run that has all its cases, with the version in which it got them."""
        return self.spark.read.parquet(*[self._folder("ready", v) for v in self.versions("ready")])

    def vacuum(self) -> None:
        """Delete the deltas and snapshots that the newest snapshot stands for."""
        newest = self.versions("snapshot")[-1:]
        for kind in ("delta", "snapshot"):
            for v in self.versions(kind):
                if newest and (v < newest[0] or (kind == "delta" and v == newest[0])):
                    root = self.spark._jvm.org.apache.hadoop.fs.Path(self._folder(kind, v))
                    root.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(root, True)


def track_progress(stream: DataFrame, table: ProgressTable, checkpoint: str, totals: DataFrame | None = None,
                   case: list[str] | None = None) -> list[dict]:
    """Run the stream over all that has arrived into ``table``. Returns the size of the state after
    it: per stateful operator its rows and bytes."""
    fresh = stream.dropDuplicates(case or CASE)
    q = (counts(fresh, table.key).writeStream.outputMode("update")
         .foreachBatch(lambda b, n: table.upsert(b, n, totals))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    last = q.lastProgress
    return [{"operator": o["operatorName"], "rows": o["numRowsTotal"], "bytes": o["memoryUsedBytes"]}
            for o in (last["stateOperators"] if last else [])]
