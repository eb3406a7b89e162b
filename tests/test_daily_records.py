"""Daily summary (pushdown, exactness) and multi-line records across file splits."""

import math
import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from logtide.operators import chartdata as C
from logtide.operators import daily as D
from logtide.operators import quantiles as Q
from logtide.operators import records as RC
from logtide.operators import usage as U
from logtide.operators.quantiles import quantiles_of_counts, value_counts
from logtide.operators.ranking import place_by_count
from logtide.plans import reports as R
from logtide.sources.logs import read_logs


def trips(spark, tmp):
    rows = []
    for i in range(400):
        t = datetime(2020, 12, 30) + timedelta(hours=3 * i)
        rows.append((t, float(i % 7), 0.5 if i % 3 else 0.0, float(i % 50) + 0.25, float(i % 4), i % 5))
    path = os.path.join(tmp, "trips.parquet")
    spark.createDataFrame(
        rows,
        "tpep_pickup_datetime timestamp_ntz, trip_distance double, mta_tax double, fare_amount double, "
        "tip_amount double, passenger_count int",
    ).write.parquet(path)
    return rows, spark.read.parquet(path)


def test_daily_summary_values_and_pushdown(spark, tmp):
    rows, df = trips(spark, tmp)
    out = D.daily_summary(df, year=2021)
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    try:
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PushedFilters: [IsNotNull(tpep_pickup_datetime), GreaterThanOrEqual(tpep_pickup_datetime" in plan
    assert "LessThan(tpep_pickup_datetime" in plan
    got = out.collect()
    assert [(r.dt_year, r.dt_month, r.dt_day) for r in got[:2]] == [(2021, 2, 17), (2021, 2, 16)]  # newest first
    days = {}
    for t, dist, tax, fare, tip, pax in rows:
        if t.year == 2021:
            days.setdefault((t.year, t.month, t.day), []).append((dist, tax, fare, tip, pax))
    assert len(got) == len(days)
    for r in got:
        v = days[(r.dt_year, r.dt_month, r.dt_day)]
        fares = sorted(x[2] for x in v)
        assert r.num_trips == len(v)
        assert abs(r.mean_trip_distance - sum(x[0] for x in v) / len(v)) < 1e-12
        assert r.max_mta_tax == max(x[1] for x in v) and r.min_tip_amount == min(x[3] for x in v)
        assert r.q95_fare_amount == fares[math.ceil(0.95 * len(fares)) - 1]
        assert r.mean_passenger_count == math.ceil(sum(x[4] for x in v) / len(v))
    types = {f.name: f.dataType.simpleString() for f in out.schema.fields}
    assert types["dt_year"] == "int" and types["num_trips"] == "bigint" and types["mean_passenger_count"] == "bigint"
    ov = D.daily_overview(out).collect()[0]
    assert ov.days == len(days) and ov.total_trips == sum(len(v) for v in days.values())
    assert str(ov.first_date) == "2021-01-01"


def test_exact_quantile_by_month(spark, tmp):
    rows, df = trips(spark, tmp)
    got = {(r.dt_year, r.dt_month): r.q95_fare_amount for r in D.daily_summary(df, quantile="exact", grain="month").collect()}
    for key, q in got.items():
        fares = sorted(x[3] for x in rows if (x[0].year, x[0].month) == key)
        assert q == fares[math.ceil(0.95 * len(fares)) - 1]


def test_exact_quantile_of_a_hot_group(spark):
    """90 % of the rows in one group, many equal values, a null group and null values; no percentile_disc in the plan."""
    import random

    rnd = random.Random(5)
    rows = [("hot", rnd.choice([1.0, 1.0, 1.0, rnd.random() * 1000])) for _ in range(1800)]
    rows += [(k, float(rnd.randrange(5))) for k in ("a", None) for _ in range(100)] + [("a", None), ("n", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    out = quantiles_of_counts(value_counts(df, ["k"], "v"), ["k"], "v", shares)
    assert "percentile_disc" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.k: r for r in out.collect()}
    assert set(got) == {"hot", "a", None}
    for k, r in got.items():
        v = sorted(x for g, x in rows if g == k and x is not None)
        assert all(r[name] == v[max(1, math.ceil(p * len(v))) - 1] for name, p in shares.items()), k


def test_exact_quantile_with_a_far_value(spark):
    """One value 10^12 away from a group's others: still only a small share of the group is ranked in one task."""
    import random

    rnd = random.Random(6)
    rows = [("hot", rnd.random()) for _ in range(60_000)] + [("hot", 1e12), ("hot", -1e12)] + [("b", 1.0), ("b", 5.0), ("b", float("nan"))]
    df = spark.createDataFrame(rows, "name string, v double")
    counts = value_counts(df, ["name"], "v")
    plain = lambda levels: sorted(map(str, quantiles_of_counts(counts, ["name"], "v", {"a": 0.3, "b": 0.95}, levels).collect()))
    assert plain(1) == plain(3)
    shares = {"least": 0.0, "rank": 0.5, "most": 1.0}
    got = {r.name: r for r in quantiles_of_counts(counts, ["name"], "v", shares).collect()}
    hot = sorted(v for k, v in rows if k == "hot")
    assert (got["hot"].least, got["hot"].rank, got["hot"].most) == (-1e12, hot[math.ceil(0.5 * len(hot)) - 1], 1e12)
    assert (got["b"].least, got["b"].rank) == (1.0, 5.0) and math.isnan(got["b"].most)
    wanted = F.array(F.struct(F.lit("rank").alias("name"), F.ceil(F.col("_all") / 2).alias("rank")))
    rows1 = Q._inside(counts.withColumnsRenamed({"name": "k"}), ["k"], "v", wanted)
    rows2 = Q._inside(rows1, ["k", "name"], "v", None)
    first, second = rows1.filter("k = 'hot'").count(), rows2.filter("k = 'hot'").count()
    assert 0 < first < 60_000 * 2 / Q.BUCKETS and 0 < second < 60_000 * 2 / 1024 / 10


def scans(df):
    """File scans in the plan that ran, scalar subqueries included; a reused exchange counts once."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found, skip = 0, None
    for line in plan.toString().splitlines():
        if not line.startswith((" ", ":", "+-")):
            continue  # the rest of a literal line break
        depth = len(line) - len(line.lstrip(" :+-"))
        if skip is not None and depth >= skip:
            continue
        skip = depth if "== Initial Plan ==" in line else None
        found += "FileScan" in line
    return found


def write_split_file(tmp, lines):
    path = os.path.join(tmp, "application_1_0001", "container_1_0001_01_000002.log")
    os.makedirs(os.path.dirname(path))
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")


def test_records_across_splits(spark, tmp):
    lines = ["orphan continuation before any head", "and another"]
    exp = [(0, 0, lines[0]), (0, 1, lines[1])]
    for i in range(3000):
        rec = [f"21/05/02 10:{(i // 60) % 60:02d}:{i % 60:02d} {'ERROR' if i % 5 == 0 else 'INFO'} comp.X: message {i}"]
        rec += [f"\tat frame {i}.{j}" for j in range(700 if i == 1500 else i % 4 if i % 5 == 0 else 0)]
        lines += rec
        exp += [(i + 1, p, "\n".join(rec[100 * p : 100 * p + 100])) for p in range((len(rec) + 99) // 100)]
    write_split_file(tmp, lines)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        logs = read_logs(spark, tmp, with_order=True)
        assert logs.rdd.getNumPartitions() > 5  # the file is really split
        recs = RC.assemble_records(logs, max_lines=100).orderBy("record_no", "part")
        rows = recs.collect()
        assert scans(RC.assemble_records(read_logs(spark, tmp, with_order=True))) == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r.record_no, r.part, r.text) for r in rows] == exp
    assert rows[0].ts is None and rows[0].lines == 1 and rows[2].log_level == "ERROR"
    many = RC.multiline_records(read_logs(spark, tmp, with_order=True), max_lines=100)
    assert many.filter("record_no = 1501").count() == 8 and many.filter("record_no = 0").count() == 0


def test_unstamped_file_makes_no_long_row(spark, tmp):
    write_split_file(tmp, [f"line {i}" for i in range(50_000)])
    out = RC.read_records(spark, tmp).agg({"lines": "max", "record_no": "max", "part": "max"}).collect()[0]
    assert (out["max(lines)"], out["max(record_no)"], out["max(part)"]) == (1, 0, 49_999)


def test_read_records_edge_cases(spark, tmp):
    files = {
        "a.log": "17/01/01 00:00:00 INFO a: b\r\n\tat x\r\n17/01/01 00:00:01 WARN c: d\r\n",
        "b.log": "orphan\n\n17/01/01 00:00:00 ERROR e: f\nmore",
        "c.log": "",
        "d.log": "\n",
        "e.log": "17/13/40 10:00:00 INFO bad: stamp\ncont\n",
    }
    for name, body in files.items():
        with open(os.path.join(tmp, name), "w", newline="") as f:
            f.write(body)
    got = sorted((os.path.basename(r.file_path), r.record_no, r.part, r.lines, r.text, r.ts is None) for r in RC.read_records(spark, tmp).collect())
    assert got == [
        ("a.log", 1, 0, 2, "17/01/01 00:00:00 INFO a: b\n\tat x", False),
        ("a.log", 2, 0, 1, "17/01/01 00:00:01 WARN c: d", False),
        ("b.log", 0, 0, 1, "orphan", True),
        ("b.log", 0, 1, 1, "", True),
        ("b.log", 1, 0, 2, "17/01/01 00:00:00 ERROR e: f\nmore", False),
        ("d.log", 0, 0, 1, "", True),
        ("e.log", 1, 0, 2, "17/13/40 10:00:00 INFO bad: stamp\ncont", True),
    ]


def test_single_scan_by_construction(spark, tmp):
    write_split_file(tmp, ["21/05/02 10:00:00 INFO a: b"] * 3)
    logs = lambda: read_logs(spark, tmp)
    assert scans(U.top_cluster_apps(U.app_spans(logs()))) == 1
    summary = lambda: U.cluster_summary(U.app_spans(logs()), ordered=False)
    assert scans(C.bar_data(summary())) == 1 and scans(R.usage_report(summary())) == 1


def test_places_by_count(spark):
    import random

    rnd = random.Random(2)
    rows = [(f"{rnd.randrange(10**6):013d}{i}", rnd.choice([1, 1, 1, 2, 7])) for i in range(500)]
    df = spark.createDataFrame(rows, "cluster_id string, num_applications long")
    got = [r.cluster_id for r in place_by_count(df, "num_applications", "cluster_id", "place").orderBy("place").collect()]
    assert got == [c for c, _ in sorted(rows, key=lambda r: (-r[1], r[0]))]
    assert place_by_count(df.limit(0), "num_applications", "cluster_id", "place").count() == 0


def test_places_of_ids_with_a_common_beginning(spark):
    """10^5 ids of one count that share 20 characters: every task ranks a like share of them."""
    df = spark.range(100_000).select(F.format_string("application_00000000%07d", "id").alias("k"), F.lit(1).alias("n")).repartition(8)
    out = place_by_count(df, "n", "k", "place")
    assert [r.place for r in out.orderBy("k").collect()] == list(range(1, 100_001))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = sorted(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) == 8 and tasks[-1] <= 2 * tasks[4]
