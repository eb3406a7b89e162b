"""All message tables from one scan against the parser of each message."""

import os

import pytest

from logtide.operators import messages as M
from logtide.sources.feeds import load_event_logs
from test_daily_records import scans

SF = "/root/testdata/sf0.001"


def same(a, b):
    return a.dtypes == b.dtypes and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_message_tables_are_those_of_the_parsers(spark, tmp):
    if not os.path.exists(SF):
        pytest.skip("no test data")
    logs = load_event_logs(spark, SF)
    path = os.path.join(tmp, "messages")
    M.write_message_tables(logs, path)
    total = 0
    for table in M.TABLES:
        got, want = M.read_message_table(spark, path, table), getattr(M, f"parse_{table}")(logs)
        assert same(got, want) and got.count() > 0, table
        total += got.count()
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(message" in plan
    assert total == spark.read.parquet(path).count() and len(M.TABLES) == 12
    assert {r.message: r.lines for r in M.message_counts(logs).collect()} == {t: M.read_message_table(spark, path, t).count() for t in M.TABLES}


def test_one_scan_several_messages_and_none(spark, tmp):
    line = "17/03/29 10:04:43 INFO x: Got assigned task 7 and Running task 1.0 in stage 2.0 (TID 7); Found block rdd_1_2 locally; Partition rdd_1_3 not found, computing it"
    folder = os.path.join(tmp, "application_1_0001")
    os.makedirs(folder)
    with open(os.path.join(folder, "container_1_0001_01_000002.log"), "w") as f:
        f.write(line + "\nplain\n task \nGot assigned task x\n\n")
    logs = spark.read.text(folder).selectExpr("value", "_metadata.file_path AS file_path")
    rows = {r.message: r for r in M.all_messages(logs).collect()}
    assert set(rows) == {"task_assigned", "task_events", "cache_lookups"} and M.all_messages(logs).count() == 3
    assert rows["task_assigned"].tid == 7 and rows["task_events"].event == "Running" and rows["cache_lookups"].hit is True
    for table in M.TABLES:
        assert same(M.message_table(M.all_messages(logs), table), getattr(M, f"parse_{table}")(logs)), table
    assert scans(M.message_counts(logs)) == 1
    assert M.all_messages(logs.limit(0)).count() == 0
