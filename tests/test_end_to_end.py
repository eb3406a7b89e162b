"""The three runs on files, and the driver contract."""

import os

import pytest

from logtide.plans import analyses as A
from logtide.plans import catalog, oracle
from logtide.sources import tables as TB
from logtree import write_tree


def read(p):
    with open(p) as f:
        return f.read()


def test_level_distribution_run(spark, tmp):
    root = write_tree(os.path.join(tmp, "logs"))
    out = A.level_distribution(spark, root, os.path.join(tmp, "out"))
    assert read(out["counts"]).splitlines() == ["log_level,count", "INFO,11", "WARN,1", "ERROR,1", "DEBUG,1"]
    assert read(out["summary"]).splitlines()[0] == "Total log lines processed: 17"
    assert len(read(out["sample"]).splitlines()) == 11


def test_cluster_usage_run_and_restart(spark, tmp):
    root = write_tree(os.path.join(tmp, "logs"))
    outdir = os.path.join(tmp, "out")
    out = A.cluster_usage(spark, root, outdir, bins=5, grid=7)
    parts = sorted(p for p in os.listdir(out["timeline"]) if p.startswith("part-"))
    rows = [line for p in parts for line in read(os.path.join(out["timeline"], p)).splitlines()[1:]]
    assert [r.split(",")[1] for r in rows] == [
        "application_1440487435730_0039", "application_1485248649253_0001", "application_1485248649253_0002"
    ]
    stats = read(out["stats"])
    assert stats.startswith("Total unique clusters: 2\nTotal applications: 3\n")
    again = A.cluster_usage(spark, None, outdir, skip_spark=True, bins=5, grid=7)
    assert read(again["stats"]) == stats
    assert len(read(again["density"]).splitlines()) == 8


def test_daily_run(spark, tmp):
    from datetime import datetime

    p = os.path.join(tmp, "t.parquet")
    spark.createDataFrame(
        [(datetime(2021, 1, 1, h), 1.0, 0.5, 10.0, 1.0, 2) for h in range(5)] + [(datetime(2020, 12, 31), 1.0, 0.5, 1.0, 0.0, 1)],
        "tpep_pickup_datetime timestamp_ntz, trip_distance double, mta_tax double, fare_amount double, tip_amount double, passenger_count int",
    ).write.parquet(p)
    out, overview = A.daily_trip_summary(spark, [p], os.path.join(tmp, "out"), year=2021)
    assert read(out["daily"]).splitlines()[1].startswith("2021,1,1,5,1.0,0.5,10.0,1.0,2")
    assert overview.collect()[0].days == 1
    base = os.path.join(tmp, "tree")
    spark.read.parquet(p).write.parquet(TB.month_paths(base, 2021, [1])[0])
    out, overview = A.daily_trip_summary(spark, [base], os.path.join(tmp, "out2"), year=2021, months=[1])
    assert overview.collect()[0].total_trips == 5
    with pytest.raises(ValueError):
        A.daily_trip_summary(spark, [base], tmp, months=[])


def test_command_line(spark, tmp):
    root = write_tree(os.path.join(tmp, "logs"))
    out = os.path.join(tmp, "cli")
    assert A.main(["levels", "--input", root, "--out", out, "--style", "local"]) == 0
    assert read(os.path.join(out, "level_summary.txt")).splitlines()[0] == "Total log lines processed: 17"
    assert A.main(["usage", "--input", root, "--out", out]) == 0
    assert A.main(["usage", "--out", out, "--skip-spark"]) == 0
    assert read(os.path.join(out, "usage_stats.txt")).startswith("Total unique clusters: 2")


def test_entry_and_registry(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["cluster_id", "application_id", "app_number", "start_time", "end_time", "duration_seconds"]
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_all_queries_match_oracle(spark, sf):
    if not os.path.exists(sf):
        pytest.skip("no test data")
    import oracle_check as OC

    con = OC.duck(sf)
    ors = oracle.oracle_sql()
    bad = []
    for name, fn in catalog.queries().items():
        r = OC.compare(spark, name, fn, ors.get(name), con, sf)
        if r.get("ok") is False:
            bad.append(r)
    assert not bad, bad
