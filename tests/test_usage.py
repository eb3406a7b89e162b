"""Cluster usage: timeline from files, report golden, windows and charts vs brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F
from datetime import datetime, timedelta

from logtide.operators import chartdata as C
from logtide.operators import usage as U
from logtide.plans import reports as R
from logtide.sources.logs import read_logs
from logtide.sources.tables import CLUSTER_SUMMARY_SCHEMA, TIMELINE_SCHEMA
from logtree import write_tree

# Golden: the committed cluster summary and the statistics text made from it.
SUMMARY = [
    ("1485248649253", 181, datetime(2017, 1, 24, 17, 0, 28), datetime(2017, 7, 27, 21, 45, 0)),
    ("1472621869829", 8, datetime(2016, 9, 9, 7, 43, 47), datetime(2016, 9, 9, 10, 7, 6)),
    ("1448006111297", 2, datetime(2016, 4, 7, 10, 45, 21), datetime(2016, 4, 7, 12, 22, 8)),
    ("1440487435730", 1, datetime(2015, 9, 1, 18, 14, 40), datetime(2015, 9, 1, 18, 19, 50)),
    ("1460011102909", 1, datetime(2016, 7, 26, 11, 54, 20), datetime(2016, 7, 26, 12, 19, 25)),
    ("1474351042505", 1, datetime(2016, 11, 18, 22, 30, 6), datetime(2016, 11, 19, 0, 59, 4)),
]
STATS = """Total unique clusters: 6
Total applications: 194
Average applications per cluster: 32.33

Most heavily used clusters:
  Cluster 1485248649253: 181 applications
  Cluster 1472621869829: 8 applications
  Cluster 1448006111297: 2 applications
  Cluster 1440487435730: 1 applications
  Cluster 1460011102909: 1 applications
  Cluster 1474351042505: 1 applications"""


def test_timeline_from_files(spark, tmp):
    logs = read_logs(spark, write_tree(tmp))
    rows = [tuple(r) for r in U.app_timeline(logs).collect()]
    assert rows == [
        ("1440487435730", "application_1440487435730_0039", "0039", datetime(2015, 9, 1, 18, 14, 40), datetime(2015, 9, 1, 18, 19, 50), 310.0),
        ("1485248649253", "application_1485248649253_0001", "0001", datetime(2017, 3, 29, 10, 4, 41), datetime(2017, 3, 29, 10, 9, 59), 318.0),
        ("1485248649253", "application_1485248649253_0002", "0002", datetime(2017, 3, 30, 8, 0), datetime(2017, 3, 30, 8, 30), 1800.0),
    ]
    summary = [tuple(r) for r in U.cluster_summary(U.app_timeline(logs)).collect()]
    assert summary[0][:2] == ("1485248649253", 2)


def test_usage_report_golden(spark):
    summary = spark.createDataFrame(SUMMARY, CLUSTER_SUMMARY_SCHEMA)
    assert "\n".join(r.line for r in R.usage_report(summary).orderBy("line_no").collect()) == STATS
    st = U.usage_stats(summary).collect()[0]
    assert (st.num_clusters, st.num_applications) == (6, 194) and abs(st.avg_apps_per_cluster - 194 / 6) < 1e-12
    empty = U.usage_stats(spark.createDataFrame([], CLUSTER_SUMMARY_SCHEMA)).collect()[0]
    assert (empty.num_clusters, empty.num_applications, empty.avg_apps_per_cluster) == (0, 0, 0.0)
    share = {r.cluster_id: r.share_pct for r in U.cluster_share(summary).collect()}
    assert abs(share["1485248649253"] - 181 / 194 * 100) < 1e-9
    act = {r.cluster_id: r.active_seconds for r in U.cluster_activity(summary).collect()}
    assert act["1440487435730"] == 310.0
    bars = [(r.cluster_id, r.bar) for r in C.bar_data(summary).orderBy("bar").collect()]
    assert bars[0] == ("1485248649253", 1) and bars[3] == ("1440487435730", 4)


def random_timeline(spark, n=300, seed=7):
    rnd = random.Random(seed)
    base = datetime(2017, 1, 1)
    rows = []
    for i in range(n):
        c = rnd.choice(["1", "1", "1", "2", "3"])  # one hot cluster
        s = base + timedelta(seconds=rnd.randrange(0, 20 * 86400))
        d = rnd.choice([0, 5, 60, 3600, 90000, rnd.randrange(0, 200000)])
        rows.append((c, f"application_{c}_{i:04d}", f"{i:04d}", s, s + timedelta(seconds=d), float(d)))
    return rows, spark.createDataFrame(rows, TIMELINE_SCHEMA)


@pytest.mark.parametrize("bucket", [None, 86400, 600])
def test_concurrency_matches_brute_force(spark, bucket):
    rows, tl = random_timeline(spark)
    got = {r.cluster_id: (r.peak_concurrent, r.peak_time) for r in U.concurrency(tl, bucket_seconds=bucket).collect()}
    for c in {r[0] for r in rows}:
        apps = [r for r in rows if r[0] == c]
        times = sorted({r[3] for r in apps} | {r[4] for r in apps})
        best, best_t = None, None
        for t in times:
            k = sum(1 for r in apps if r[3] <= t) - sum(1 for r in apps if r[4] <= t)
            if best is None or k > best:
                best, best_t = k, t
        assert got[c] == (best, best_t), c


@pytest.mark.parametrize("bucket", [None, 86400, 60])
def test_start_gaps_matches_brute_force(spark, bucket):
    rows, tl = random_timeline(spark)
    got = {r.application_id: (r.prev_application_id, r.gap_seconds)
           for r in U.start_gaps(tl, bucket_seconds=bucket).collect()}
    for c in {r[0] for r in rows}:
        apps = sorted((r for r in rows if r[0] == c), key=lambda r: (r[3], r[1]))
        prev = None
        for r in apps:
            exp = (None, None) if prev is None else (prev[1], (r[3] - prev[3]).total_seconds())
            assert got[r[1]] == exp
            prev = r


def test_burst_of_one_hour_is_spread(spark):
    """All starts in one hour of one cluster: each window task has a like share, and results are those of fixed buckets."""
    df = spark.range(40_000).select(
        F.lit("1").alias("cluster_id"), F.format_string("application_1_%05d", "id").alias("application_id"), F.format_string("%05d", "id").alias("app_number"),
        F.expr("timestamp_ntz'2017-01-01 10:00:00' + make_dt_interval(0, 0, 0, cast((id * 7919) % 3600 AS int))").alias("start_time"),
    )
    tl = df.withColumn("end_time", F.expr("start_time + INTERVAL 90 SECOND")).withColumn("duration_seconds", F.lit(90.0))
    ranged = U._bucketed(tl.select("cluster_id", "start_time", "application_id"), ["cluster_id", "start_time", "application_id"], "start_time", None)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = sorted(r["count"] for r in ranged.repartition(8, "cluster_id", "bucket").groupBy(F.spark_partition_id()).count().collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) == 8 and tasks[-1] <= 2 * tasks[4]
    assert U.concurrency(tl).collect() == U.concurrency(tl, bucket_seconds=60).collect()
    gaps = lambda b: U.start_gaps(tl, bucket_seconds=b).agg(F.count("gap_seconds"), F.sum("gap_seconds"), F.sum(F.xxhash64("application_id", "prev_application_id") % 1000)).first()
    assert gaps(None) == gaps(60)


def test_histogram_and_density_vs_brute_force(spark):
    rows, tl = random_timeline(spark)
    top = "1"
    xs = [r[5] for r in rows if r[0] == top]
    h = C.duration_histogram(tl, bins=50).orderBy("bin").collect()
    lo, hi = min(xs), max(xs)
    exp = [0] * 50
    for x in xs:
        exp[min(int(math.floor((x - lo) / (hi - lo) * 50)) + 1, 50) - 1] += 1
    assert [r["count"] for r in h] == exp and h[0].bin_lo == lo and h[-1].bin_hi == hi
    d = C.duration_density(tl, grid=200).orderBy("point").collect()
    n = len(xs)
    mean = sum(xs) / n
    sd = math.sqrt(sum((x - mean) ** 2 for x in xs) / (n - 1))
    bw = sd * n ** (-0.2)
    for r in d[::37]:
        g = lo + (hi - lo) * r.point / 199
        dens = sum(math.exp(-0.5 * ((g - x) / bw) ** 2) for x in xs) / (n * bw * math.sqrt(2 * math.pi))
        assert abs(r.density - round(dens * 1e6, 6)) < 2e-6
    # log scale drops zero durations
    hl = C.duration_histogram(tl, bins=10, scale="log").collect()
    assert sum(r["count"] for r in hl) == sum(1 for x in xs if x > 0)


def test_chart_parameters_checked(spark):
    _, tl = random_timeline(spark, n=10)
    with pytest.raises(ValueError):
        C.duration_density(tl, grid=1)
    with pytest.raises(ValueError):
        C.duration_histogram(tl, bins=0)
    with pytest.raises(ValueError):
        C.duration_histogram(tl, scale="sqrt")


def test_profile_and_longest(spark):
    rows, tl = random_timeline(spark)
    prof = {r.cluster_id: r for r in U.duration_profile(tl).collect()}
    for c in prof:
        xs = sorted(r[5] for r in rows if r[0] == c)
        n = len(xs)
        p95 = xs[math.ceil(0.95 * n) - 1]
        assert prof[c].n == n and prof[c].p95_seconds == p95 and prof[c].median_seconds == xs[math.ceil(0.5 * n) - 1]
        assert abs(prof[c].top_share - sum(x for x in xs if x >= p95) / sum(xs)) < 1e-12
    longest = U.longest_applications(tl).collect()[0]
    assert longest.duration_seconds == max(r[5] for r in rows)
