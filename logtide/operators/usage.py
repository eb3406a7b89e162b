"""Cluster usage: application timeline, cluster summary and derived measures.

``app_spans`` is the expensive step (it reads every line); everything else
works on its output, one row per application, or on the cluster summary, one
row per cluster.

Plan of ``app_spans`` (the survey's largest saving): the id regexes depend
only on the path, so lines are first reduced to min/max time per
``file_path`` -- a map-side partial aggregate that ships one row per file and
map task no matter how many lines a file holds -- and the path regexes then
run once per file instead of once per line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logtide.functions import parse as P
from logtide.operators.quantiles import quantiles_of_counts, value_counts
from logtide.operators.ranking import with_range


TIMELINE_COLUMNS = ["cluster_id", "application_id", "app_number", "start_time", "end_time", "duration_seconds"]


def file_spans(logs: DataFrame) -> DataFrame:
    """``file_path, first_ts, last_ts, lines``: time span of each log file.

    Only lines with a valid leading time stamp count.
    """
    # No per-line filter: min/max/count skip nulls, so the time-stamp regex
    # runs once per line (a Filter + Project pair would run it twice); files
    # without any valid stamp are dropped after the aggregate.
    ts = P.line_ts("value")
    return (
        logs.select("file_path", ts.alias("ts"))
        .groupBy("file_path")
        .agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("ts").alias("lines"))
        .filter(F.col("first_ts").isNotNull())
    )


def app_spans(logs: DataFrame) -> DataFrame:
    """Unsorted timeline: one row per application (see ``app_timeline``)."""
    files = file_spans(logs).select(*P.path_ids("file_path"), "first_ts", "last_ts")
    spans = (
        files.filter((F.col("application_id") != "") & (F.col("cluster_id") != ""))
        .groupBy("cluster_id", "application_id", "app_number")
        .agg(F.min("first_ts").alias("start_time"), F.max("last_ts").alias("end_time"))
    )
    return spans.withColumn("duration_seconds", P.elapsed_seconds("start_time", "end_time"))


def app_timeline(logs: DataFrame) -> DataFrame:
    """``cluster_id, application_id, app_number, start_time, end_time, duration_seconds``.

    Sorted by cluster, start and application (a range shuffle over one row
    per application).
    """
    return app_spans(logs).select(*TIMELINE_COLUMNS).orderBy("cluster_id", "start_time", "application_id")


def cluster_summary(timeline: DataFrame, ordered: bool = True) -> DataFrame:
    """``cluster_id, num_applications, cluster_first_app, cluster_last_app``.

    Most used cluster first; ties by ascending cluster id. ``ordered=False``
    skips the sort when a later step orders or aggregates anyway.
    """
    out = timeline.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("num_applications"),
        F.min("start_time").alias("cluster_first_app"),
        F.max("end_time").alias("cluster_last_app"),
    )
    return out.orderBy(F.desc("num_applications"), "cluster_id") if ordered else out


def usage_stats(summary: DataFrame) -> DataFrame:
    """One row: ``num_clusters, num_applications, avg_apps_per_cluster`` (0.0 if no cluster)."""
    n = F.count(F.lit(1))
    apps = F.coalesce(F.sum("num_applications"), F.lit(0)).cast("bigint")
    return summary.agg(
        n.alias("num_clusters"),
        apps.alias("num_applications"),
        F.when(n > 0, apps / n).otherwise(F.lit(0.0)).alias("avg_apps_per_cluster"),
    )


def top_cluster(timeline: DataFrame) -> DataFrame:
    """One row ``cluster_id, num_applications``: the cluster with most applications."""
    return (
        timeline.groupBy("cluster_id")
        .agg(F.count(F.lit(1)).alias("num_applications"))
        .orderBy(F.desc("num_applications"), "cluster_id")
        .limit(1)
    )


def top_cluster_apps(timeline: DataFrame) -> DataFrame:
    """Timeline rows of the most used cluster.

    The right side has one row by its ``limit(1)``, so the broadcast has a
    proven size bound. It is taken from the cluster summary, which reads the
    same columns of the timeline as the left side, so both share one scan.
    """
    most = cluster_summary(timeline, ordered=False).orderBy(F.desc("num_applications"), "cluster_id").limit(1)
    most = most.filter(F.col("cluster_last_app") >= F.col("cluster_first_app"))
    return timeline.join(F.broadcast(most.select("cluster_id")), "cluster_id", "left_semi")


def longest_applications(timeline: DataFrame, k: int = 1) -> DataFrame:
    """The ``k`` longest applications (a top-k report); ties by application id."""
    return timeline.orderBy(F.desc("duration_seconds"), "application_id").limit(k)


def cluster_activity(summary: DataFrame) -> DataFrame:
    """``cluster_id, num_applications, cluster_first_app, cluster_last_app, active_seconds``."""
    return summary.select(
        "cluster_id",
        "num_applications",
        "cluster_first_app",
        "cluster_last_app",
        P.elapsed_seconds("cluster_first_app", "cluster_last_app").alias("active_seconds"),
    )


def cluster_share(summary: DataFrame) -> DataFrame:
    """``cluster_id, num_applications, share_pct``: share of all applications.

    The total is a scalar subquery (one-row aggregate), not a join.
    """
    total = summary.agg(F.sum("num_applications")).scalar()
    return summary.select(
        "cluster_id",
        "num_applications",
        (F.col("num_applications") / total * 100.0).alias("share_pct"),
    )


def cluster_work(timeline: DataFrame) -> DataFrame:
    """``cluster_id, num_applications, total_seconds, mean_seconds``: work, not count."""
    return timeline.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("num_applications"),
        F.sum("duration_seconds").alias("total_seconds"),
        F.avg("duration_seconds").alias("mean_seconds"),
    )


def monthly_starts(timeline: DataFrame) -> DataFrame:
    """``month (yyyy-MM), applications``: applications started per calendar month."""
    return (
        timeline.groupBy(F.date_format("start_time", "yyyy-MM").alias("month"))
        .agg(F.count(F.lit(1)).alias("applications"))
        .orderBy("month")
    )


def duration_profile(timeline: DataFrame) -> DataFrame:
    """Per cluster: ``n, median_seconds, p95_seconds, max_seconds, top_share``.

    Exact discrete percentiles. ``top_share`` is the fraction of the summed
    duration spent in applications at or above the cluster's p95. The timeline
    is reduced to (cluster, duration, count) first; everything else works on
    that, so a cluster with most applications is spread over its durations.
    """
    key, d = ["cluster_id"], F.col("duration_seconds")
    counts = value_counts(timeline, key, "duration_seconds")
    ranks = quantiles_of_counts(counts, key, "duration_seconds", {"median_seconds": 0.5, "p95_seconds": 0.95})
    return (
        counts.join(ranks, "cluster_id")
        .groupBy("cluster_id", "median_seconds", "p95_seconds")
        .agg(
            F.sum("n").alias("n"),
            F.max(d).alias("max_seconds"),
            F.sum(d * F.col("n")).alias("_total"),
            F.sum(F.when(d >= F.col("p95_seconds"), d * F.col("n")).otherwise(0.0)).alias("_top"),
        )
        .select(
            "cluster_id", "n", "median_seconds", "p95_seconds", "max_seconds",
            F.when(F.col("_total") > 0, F.col("_top") / F.col("_total")).alias("top_share"),
        )
    )


def cluster_distribution(timeline: DataFrame) -> DataFrame:
    """Cluster summary with the cluster's own start time (its id is epoch ms)."""
    return cluster_summary(timeline).select(
        "cluster_id", P.cluster_start("cluster_id").alias("cluster_started"), "num_applications",
        "cluster_first_app", "cluster_last_app",
    )


# ---------------------------------------------------------------------------
# Window operators. A cluster may hold most applications (181 of 194 in the
# reference data), so no window is partitioned by cluster alone: each works
# per (cluster, bucket) and carries the state of earlier buckets from a
# small per-bucket table (one row per cluster and bucket). Buckets are ranges
# of like numbers of rows along (cluster, time), so a burst of one hour is
# spread like a quiet year; with ``bucket_seconds`` they are fixed times. Results
# are exact for any buckets.
# ---------------------------------------------------------------------------
EPOCH = "1970-01-01 00:00:00"


def time_bucket(t, bucket_seconds: int):
    """Whole ``bucket_seconds`` since 1970 of a TIMESTAMP_NTZ (no time zone involved)."""
    if bucket_seconds <= 0:
        raise ValueError("bucket_seconds must be positive")
    since = P.seconds_between(F.lit(EPOCH).cast("timestamp_ntz"), t)
    return F.floor(since / bucket_seconds).cast("bigint")


def _bucketed(df: DataFrame, order: list[str], time: str, bucket_seconds: int | None) -> DataFrame:
    if bucket_seconds is None:
        return with_range(df, [F.col(c) for c in order], "bucket")
    return df.withColumn("bucket", time_bucket(F.col(time), bucket_seconds))


def concurrency(timeline: DataFrame, bucket_seconds: int | None = None) -> DataFrame:
    """``cluster_id, peak_concurrent, peak_time``: most applications running at once.

    Running means ``start <= t < end``. ``peak_time`` is the first instant
    that reaches the peak. ``bucket_seconds`` is the width of the time
    buckets that split a cluster's events over tasks; None: ranges of like size.
    """
    # Each application is one +1 event at its start and one -1 at its end (one pass).
    ev = timeline.select(
        "cluster_id",
        F.inline(
            F.array(
                F.struct(F.col("start_time").alias("t"), F.lit(1).alias("d")),
                F.struct(F.col("end_time").alias("t"), F.lit(-1).alias("d")),
            )
        ),
    )
    net = ev.groupBy("cluster_id", "t").agg(F.sum("d").alias("net"))
    net = _bucketed(net, ["cluster_id", "t"], "t", bucket_seconds)
    per_bucket = net.groupBy("cluster_id", "bucket").agg(F.sum("net").alias("bucket_net"))
    before = Window.partitionBy("cluster_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        "cluster_id", "bucket", F.coalesce(F.sum("bucket_net").over(before), F.lit(0)).alias("offset")
    )
    within = Window.partitionBy("cluster_id", "bucket").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    running = net.withColumn("local", F.sum("net").over(within)).join(offsets, ["cluster_id", "bucket"])
    running = running.withColumn("active", F.col("offset") + F.col("local"))
    return running.groupBy("cluster_id").agg(
        F.max("active").cast("bigint").alias("peak_concurrent"),
        F.min_by("t", F.struct(-F.col("active"), F.col("t"))).alias("peak_time"),
    )


def start_gaps(timeline: DataFrame, bucket_seconds: int | None = None) -> DataFrame:
    """Per application: previous application of its cluster and seconds since its start.

    ``cluster_id, application_id, start_time, prev_application_id, gap_seconds``;
    order within a cluster is (start_time, application_id); the first
    application of a cluster has nulls. ``bucket_seconds`` as in
    ``concurrency``.
    """
    apps = timeline.select("cluster_id", "application_id", "start_time")
    apps = _bucketed(apps, ["cluster_id", "start_time", "application_id"], "start_time", bucket_seconds)
    order = F.struct("start_time", "application_id")
    w = Window.partitionBy("cluster_id", "bucket").orderBy("start_time", "application_id")
    local = apps.select(
        "*",
        F.lag("application_id").over(w).alias("lag_app"),
        F.lag("start_time").over(w).alias("lag_start"),
    )
    last = apps.groupBy("cluster_id", "bucket").agg(F.max(order).alias("last"))
    prev_w = Window.partitionBy("cluster_id").orderBy("bucket")
    carry = last.select("cluster_id", "bucket", F.lag("last").over(prev_w).alias("carry"))
    out = local.join(carry, ["cluster_id", "bucket"])
    prev_app = F.coalesce("lag_app", F.col("carry.application_id"))
    prev_start = F.coalesce("lag_start", F.col("carry.start_time"))
    return out.select(
        "cluster_id",
        "application_id",
        "start_time",
        prev_app.alias("prev_application_id"),
        P.seconds_between(prev_start, F.col("start_time")).alias("gap_seconds"),
    )
