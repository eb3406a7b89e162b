"""Benchmark of the headline analyses.

1. Writes the event log feed of ``$BENCH_SF_DIR/events.parquet`` once as three
   real log trees in a fresh temporary folder (not timed): ``small``, one
   ``.log`` file per application container; ``medium``, some files per cluster of about as
   many lines as the published files have (8,600); and ``large``, one file per cluster.
   Trees are read with ``whole_bytes`` = 1 MB, which changes no row.
2. Times each headline query on files, after one warm-up, best of
   ``$BENCH_REPEAT`` runs; listing the tree is part of each run. Every query is
   run to completion (``noop`` sink or ``collect`` of a small result).

Prints ONE JSON line: ``{"metric", "value", "unit", "queries", "sf", ...}``
with ``value`` the sum of the query times, plus lines/s of each query on log
files for comparison with the published ~179k and ~213k lines/s.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from logtide.operators import chartdata as C  # noqa: E402
from logtide.operators import daily as D  # noqa: E402
from logtide.operators import levels as L  # noqa: E402
from logtide.operators import records as RC  # noqa: E402
from logtide.operators import tasks as T  # noqa: E402
from logtide.operators import usage as U  # noqa: E402
from logtide.plans import reports as R  # noqa: E402
from logtide.sources.feeds import load_event_logs, load_trips  # noqa: E402
from logtide.sources.logs import read_logs  # noqa: E402


WHOLE_BYTES = 1 << 20


def write_tree(spark: SparkSession, sf_dir: str, out: str, per_cluster: int = 0) -> int:
    """Feed lines as a real log tree ``<out>/application_*/container_*.log``; ``per_cluster``: that many files for each cluster.

    Each task writes the files of the containers hashed to it, lines in file
    order (a test fixture on the local disk; not timed).
    """
    feed = load_event_logs(spark, sf_dir)
    if per_cluster:
        cluster = F.regexp_extract("file_path", r"application_(\d+)_", 1)
        number = F.format_string("%06d", F.pmod(F.xxhash64("file_path"), F.lit(per_cluster)) + 1)
        one = F.concat(F.lit("/logs/application_"), cluster, F.lit("_0001/container_"), cluster, F.lit("_0001_01_"), number, F.lit(".log"))
        feed = feed.withColumn("file_path", F.when(cluster != "", one).otherwise(F.col("file_path")))

    def write(batches):
        import os as _os

        import pandas as pd

        n = 0
        frames = [b for b in batches]
        if frames:
            pdf = pd.concat(frames)
            for path, g in pdf.groupby("file_path", sort=False):
                target = out + path[len("/logs"):]
                _os.makedirs(_os.path.dirname(target), exist_ok=True)
                with open(target, "w", encoding="utf-8", newline="") as f:
                    f.write("\n".join(g["value"].tolist()) + "\n")
                n += len(g)
        yield pd.DataFrame({"lines": [n]})

    lines = (
        feed.repartition(64, "file_path")
        .sortWithinPartitions("file_path", "line_order")
        .select("file_path", "value")
        .mapInPandas(write, "lines long")
    )
    return lines.agg(F.sum("lines")).collect()[0][0]


def timed(fn, repeat: int) -> float:
    best = None
    for _ in range(repeat):
        t0 = time.perf_counter()
        fn()
        dt = time.perf_counter() - t0
        best = dt if best is None else min(best, dt)
    return round(best, 3)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    scratch = tempfile.mkdtemp(prefix="logtide-bench-")
    builder = SparkSession.builder
    if os.environ.get("BENCH_EVENT_LOG"):
        # Stage and task times for later reading, without the web UI.
        os.makedirs(os.path.join(scratch, "events"))
        builder = builder.config("spark.eventLog.enabled", "true").config(
            "spark.eventLog.dir", "file://" + os.path.join(scratch, "events")
        )
    spark = (
        builder.master(f"local[{cpus}]")
        .appName("logtide-bench")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(max(8, 2 * int(cpus))))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Many small files: list with a few tasks per core and pack files
        # into partitions by their real size (opening one costs ~128 KB).
        .config("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(2 * int(cpus)))
        .config("spark.sql.files.openCostInBytes", str(128 * 1024))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    trees = {shape: os.path.join(scratch, shape) for shape in ("small", "medium", "large")}
    n_lines = write_tree(spark, sf_dir, trees["small"])
    clusters = load_event_logs(spark, sf_dir).select(F.regexp_extract("file_path", r"application_(\d+)_", 1)).distinct().count()
    write_tree(spark, sf_dir, trees["medium"], per_cluster=max(1, round(n_lines / 8600 / clusters)))
    write_tree(spark, sf_dir, trees["large"], per_cluster=1)
    n_files = {shape: sum(len(f) for _, _, f in os.walk(path)) for shape, path in trees.items()}

    # Warm-up: JVM, code generation, the OS file cache.
    for path in trees.values():
        L.level_counts(read_logs(spark, path, whole_bytes=WHOLE_BYTES)).collect()
    D.daily_summary(load_trips(spark, sf_dir), year=1997).collect()

    def on(shape: str):
        logs = lambda: read_logs(spark, trees[shape], whole_bytes=WHOLE_BYTES)
        return {
            "level_counts": lambda: L.level_counts(logs()).collect(),
            "level_report": lambda: R.level_report(logs()).collect(),
            "level_sample": lambda: L.level_sample(logs(), method="rand").collect(),
            "app_timeline": lambda: U.app_timeline(logs()).collect(),
            "usage_report": lambda: R.usage_report(U.cluster_summary(U.app_spans(logs()), ordered=False)).collect(),
            "duration_density": lambda: C.duration_density(U.app_spans(logs())).collect(),
            "tasks": lambda: run(T.tasks(logs())),
            "memory_profile": lambda: run(T.memory_profile(logs())),
            "records": lambda: run(RC.read_records(spark, trees[shape], whole_bytes=WHOLE_BYTES)),
        }

    trips = lambda: load_trips(spark, sf_dir)
    large = {f"{k}_large_files": v for k, v in on("large").items() if k in ("level_counts", "app_timeline", "tasks", "records")}
    medium = {f"{k}_medium_files": v for k, v in on("medium").items() if k in ("level_counts", "app_timeline", "usage_report", "records")}
    headline = on("small") | medium | large
    headline |= {
        "daily_summary": lambda: D.daily_summary(trips(), year=1997).collect(),
        "monthly_summary_exact": lambda: D.daily_summary(trips(), quantile="exact", grain="month").collect(),
    }
    times = {name: timed(fn, repeat) for name, fn in headline.items()}
    total = round(sum(times.values()), 3)
    result = {
        "metric": "headline_total",
        "value": total,
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
        "log_lines": n_lines,
        "log_files": n_files,
        "lines_per_sec": {k: round(n_lines / t) for k, t in times.items() if not k.startswith(("daily", "monthly"))},
        "published_lines_per_sec": {"level_counts": 179000, "usage_report": 213000},
        "cpus": int(cpus),
    }
    if os.environ.get("BENCH_EVENT_LOG"):
        result["event_log_dir"] = os.path.join(scratch, "events")
    print(json.dumps(result))
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
