"""Time the registered queries at one scale factor; print one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default: all registered queries of the library, without the
training-data operators, which have their own check).
Each query runs to completion through the no-op sink (nothing is collected).

The test tables are one file with one row group each, which no engine can split. Before the
clock starts they are laid out as tables are in practice, as several files, in a scratch folder
(``several_files``); the rows are the same.
"""
from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def several_files(sf_dir: str, files: int) -> str:
    import pyarrow.parquet as pq
    out = tempfile.mkdtemp(prefix="proofline-bench-")
    for name in sorted(os.listdir(sf_dir)):
        path = os.path.join(sf_dir, name)
        if not name.endswith(".parquet"):
            continue
        if os.path.isdir(path) or pq.ParquetFile(path).num_row_groups > 1:
            os.symlink(path, os.path.join(out, name))
            continue
        t = pq.read_table(path)
        n = min(files, max(1, t.num_rows // 1000))
        os.makedirs(os.path.join(out, name))
        step = -(-t.num_rows // n)
        for i in range(n):
            pq.write_table(t.slice(i * step, step), os.path.join(out, name, f"part-{i:04d}.parquet"))
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from proofline.plans import registry
    from proofline.session import get_session
    data = several_files(sf_dir, cpus)
    spark = get_session(f"local[{cpus}]", shuffle_partitions=cpus, app_name="proofline-bench")
    spark.sparkContext.setLogLevel("ERROR")
    registry.load_all()
    wanted = os.environ.get("BENCH_QUERIES")
    names = [n for n in (wanted.split(",") if wanted else sorted(registry.QUERIES))
             if n in registry.QUERIES]
    # warm-up: JVM, code paths and the parquet footers
    registry.QUERIES["run_summary"](spark, data).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        registry.QUERIES[name](spark, data).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(sf) if sf else sf_dir,
                      "cpus": cpus}))


if __name__ == "__main__":
    main()
