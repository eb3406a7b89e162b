"""Writes PLANS.md: physical plans of the headline queries (sf0.01 feed and files).

Usage: python tools/plans.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pyspark.sql import SparkSession  # noqa: E402

from logtide.operators import daily as D  # noqa: E402
from logtide.operators import records as RC  # noqa: E402
from logtide.operators import tasks as T  # noqa: E402
from logtide.operators import usage as U  # noqa: E402
from logtide.plans import reports as R  # noqa: E402
from logtide.sources.feeds import load_trips  # noqa: E402
from logtide.sources.logs import read_logs  # noqa: E402

NOTES = {
    "level_report": "One scan; the level is extracted once per line and counted conditionally in a global "
    "aggregate (partial per task, one row shipped per task). All nine report lines are projections of that row.",
    "app_timeline": "Lines -> min/max per file (partial aggregate: one row per file and task), path regexes per "
    "file, then per application. The id filter is pushed to the scan.",
    "tasks": "Running/Finished lines of a task share the key; one hash aggregate pairs them, partially in the map "
    "task when both lines are in the same file or split.",
    "memory_profile": "Two message kinds in one pass with conditional columns; one aggregate.",
    "concurrency": "Windows are partitioned by (cluster, range of like size along cluster and time), never by cluster alone; "
    "earlier ranges enter through a table of one row per cluster and range.",
    "records (files)": "Split-local windows plus a table with one row per split. Both branches read the same columns, "
    "so at run time the second scan and exchange are the first one's (a test counts one FileScan).",
    "daily_summary": "Both year bounds are in PushedFilters of the Parquet scan; partial aggregates (the "
    "percentile keeps a bounded sketch) ship one row per day and task.",
}


def plan(df) -> str:
    text = df._jdf.queryExecution().executedPlan().toString()
    text = re.sub(r"#\d+L?", "", text)
    text = re.sub(r"file:[^,\]]*", "<path>", text)
    return text.strip()


def shape_table(spark, sf_dir: str) -> list[str]:
    """One row per registered query: what its initial physical plan contains."""
    rows = [
        "## Plan shape of every registered query",
        "",
        "Counted in the initial physical plan over the sf0.01 feed (before AQE; at run time AQE may reuse an "
        "identical exchange or turn a join into a broadcast by measured size). *Single* exchanges feed global "
        "aggregates (one partial row per task) or windows over a handful of rows.",
        "",
        "| query | scans | hash exchanges | range exchanges | single-partition | broadcasts | windows |",
        "|---|---|---|---|---|---|---|",
    ]
    from logtide.plans import catalog

    for name, fn in catalog.queries().items():
        p = fn(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        rows.append(
            f"| {name} | {p.count('FileScan')} | {p.count('Exchange hashpartitioning')} | "
            f"{p.count('Exchange rangepartitioning')} | {p.count('Exchange SinglePartition')} | "
            f"{p.count('BroadcastExchange')} | {len(re.findall(r'(?m)^[ :|+-]*Window ', p))} |"
        )
    return rows + [""]


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "16")
        .config("spark.sql.maxMetadataStringLength", "400")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    import bench

    tree = os.path.join(tempfile.mkdtemp(prefix="logtide-plans-"), "logs")
    bench.write_tree(spark, sf_dir, tree)
    logs = read_logs(spark, tree)
    trips = load_trips(spark, sf_dir)
    items = {
        "level_report": R.level_report(logs),
        "app_timeline": U.app_timeline(logs),
        "tasks": T.tasks(logs),
        "memory_profile": T.memory_profile(logs),
        "concurrency": U.concurrency(U.app_spans(logs)),
        "records (files)": RC.read_records(spark, tree),
        "daily_summary": D.daily_summary(trips, year=1997),
    }
    out = ["# Physical plans of the headline queries", "",
           "Initial adaptive plans (`executedPlan` before execution) over the benchmark's log tree and `lineitem`; "
           "written by `tools/plans.py`. Expression ids and paths are elided.", ""]
    for name, df in items.items():
        out += [f"## {name}", "", NOTES[name], "", "```", plan(df), "```", ""]
    out += shape_table(spark, sf_dir)
    with open(os.path.join(ROOT, "PLANS.md"), "w") as f:
        f.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
