"""End-to-end analyses: read, compute, write the outputs of one run.

* ``level_distribution`` -- level counts, a sample of lines, a summary text;
* ``cluster_usage`` -- timeline, cluster summary, statistics text and the
  data of the two charts; can start again from a saved timeline;
* ``daily_trip_summary`` -- one row per day of a year of trips, plus an
  overview.

The caller owns the session. Each run reads its input once for the main
aggregate; small results that feed later steps are written first and read
back from the output folder, which cuts their lineage (a lost executor then
costs a re-read of a small file, not a re-scan of the logs).

Command line: ``python -m logtide.plans.analyses levels|usage|daily ...``.
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession

from logtide import sinks
from logtide.operators import chartdata as C
from logtide.operators import daily as D
from logtide.operators import levels as L
from logtide.operators import usage as U
from logtide.plans import reports as R
from logtide.sources import tables as TB
from logtide.sources.logs import read_logs


def _out(outdir: str, name: str) -> str:
    return f"{outdir.rstrip('/')}/{name}"


def level_distribution(
    spark: SparkSession,
    input_path: str,
    outdir: str,
    mode: str = "substring",
    style: str = "cluster",
    seed: int = 42,
    sample_size: int = 10,
    sample_method: str = "rand",
    glob: str | None = "*.log",
    whole_bytes: int | None = None,
) -> dict[str, str]:
    """Writes ``level_counts.csv``, ``level_sample.csv`` and ``level_summary.txt``.

    One scan builds the one-row level totals (kept in memory: it is one
    row); counts and summary text are projections of it. The sample is a
    second scan with a top-k.
    """
    logs = read_logs(spark, input_path, glob=glob, whole_bytes=whole_bytes)
    totals = L.level_totals(logs, mode).cache()
    try:
        zero_fill = style == "cluster"
        counts = L.level_counts(totals=totals, zero_fill=zero_fill, order="fixed" if zero_fill else "count")
        out = {
            "counts": sinks.write_small_csv(counts.select("log_level", "count"), _out(outdir, "level_counts.csv")),
            "summary": sinks.write_text(R.level_report(totals=totals, style=style), _out(outdir, "level_summary.txt")),
        }
    finally:
        totals.unpersist()
    sample = L.level_sample(logs, n=sample_size, seed=seed, method=sample_method, mode=mode)
    out["sample"] = sinks.write_small_csv(sample, _out(outdir, "level_sample.csv"))
    return out


def cluster_usage(
    spark: SparkSession,
    input_path: str | None,
    outdir: str,
    skip_spark: bool = False,
    bins: int = 50,
    grid: int = 200,
    glob: str | None = "*.log",
    whole_bytes: int | None = None,
) -> dict[str, str]:
    """Writes the timeline (a CSV directory, parts in sort order), the cluster
    summary, the statistics text and the chart data (single files: one row
    per cluster, bin or grid point).

    ``skip_spark=True`` skips the log scan and starts from the timeline and
    summary already in ``outdir`` (read under declared schemas).
    """
    timeline_dir = _out(outdir, "timeline")
    summary_csv = _out(outdir, "cluster_summary.csv")
    out: dict[str, str] = {}
    if not skip_spark:
        logs = read_logs(spark, input_path, glob=glob, whole_bytes=whole_bytes)
        # One row per application grows with the data: a directory of CSV
        # parts, range-partitioned by the sort, not one file through one task.
        out["timeline"] = sinks.write_table(U.app_timeline(logs), timeline_dir, fmt="csv")
        timeline = TB.read_timeline(spark, timeline_dir)
        out["summary"] = sinks.write_small_csv(U.cluster_summary(timeline), summary_csv)
    timeline = TB.read_timeline(spark, timeline_dir)
    summary = TB.read_cluster_summary(spark, summary_csv)
    out["stats"] = sinks.write_text(R.usage_report(summary), _out(outdir, "usage_stats.txt"))
    out["bars"] = sinks.write_small_csv(C.bar_data(summary), _out(outdir, "bar_data.csv"), order_by="bar")
    out["histogram"] = sinks.write_small_csv(
        C.duration_histogram(timeline, bins=bins), _out(outdir, "duration_histogram.csv"), order_by="bin"
    )
    out["density"] = sinks.write_small_csv(
        C.duration_density(timeline, grid=grid, bins=bins), _out(outdir, "duration_density.csv"), order_by="point"
    )
    return out


def daily_trip_summary(
    spark: SparkSession,
    paths: list[str],
    outdir: str,
    year: int = 2021,
    quantile: str = "approx",
    months: list[int] | None = None,
) -> tuple[dict[str, str], DataFrame]:
    """Writes ``daily_summary.csv`` (newest day first); returns paths and the overview.

    ``paths`` are files, directories or globs; with ``months`` the one path is
    the base of a ``yyyy=<year>`` tree, of which the files of those months are
    read (all their rows of ``year`` count, also of other months). The
    aggregate runs once; the overview is computed from the written summary (one
    row per day), not by running the aggregate again.
    """
    if months is None:
        trips = TB.read_tables(spark, *[TB.store_path(p) for p in paths])
    else:
        if len(paths) != 1 or not months:
            raise ValueError("months needs one base path and at least one month")
        trips = TB.read_month_files(spark, paths[0], year, months)
    daily = D.daily_summary(trips, year=year, quantile=quantile)
    path = sinks.write_small_csv(daily, _out(outdir, "daily_summary.csv"))
    return {"daily": path}, D.daily_overview(TB.read_daily_summary(spark, path))


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="logtide")
    sub = ap.add_subparsers(dest="cmd", required=True)
    a = sub.add_parser("levels", help="log-level distribution")
    a.add_argument("--input")
    a.add_argument("--out", default="output")
    a.add_argument("--mode", choices=["substring", "word"], default="substring")
    a.add_argument("--style", choices=["cluster", "local"], default="cluster")
    a.add_argument("--seed", type=int, default=42)
    b = sub.add_parser("usage", help="cluster usage")
    b.add_argument("--input")
    for x in (a, b):
        x.add_argument("--whole-bytes", type=int, help="read files up to this size whole (same results, faster on many small files)")
    b.add_argument("--out", default="output")
    b.add_argument("--skip-spark", action="store_true")
    c = sub.add_parser("daily", help="daily trip summary")
    c.add_argument("paths", nargs="+")
    c.add_argument("--out", default="output")
    c.add_argument("--year", type=int, default=2021)
    c.add_argument("--months", type=int, nargs="+", help="month files of the one base path given")
    args = ap.parse_args(argv)

    spark = SparkSession.builder.appName(f"logtide-{args.cmd}").getOrCreate()
    os.makedirs(args.out, exist_ok=True) if "://" not in args.out else None
    if args.cmd == "levels":
        res = level_distribution(spark, TB.resolve_input(args.input), args.out, args.mode, args.style, args.seed, whole_bytes=args.whole_bytes)
    elif args.cmd == "usage":
        res = cluster_usage(spark, None if args.skip_spark else TB.resolve_input(args.input), args.out, args.skip_spark, whole_bytes=args.whole_bytes)
    else:
        res, overview = daily_trip_summary(spark, args.paths, args.out, args.year, months=args.months)
        overview.show(truncate=False)
    for k, v in res.items():
        print(f"{k}: {v}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
