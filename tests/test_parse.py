"""Column parsers on the lines cited as test input, and on edge cases."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logtide.functions import parse as P
from logtide.operators import messages as M

LINES = [
    "21/05/02 07:15:09 INFO YarnAllocator: Will request 3 executor containers, each with 7 cores and 9216 MB memory including 921 MB overhead",
    "21/05/02 07:15:30 INFO executor.Executor: Running task 21.2 in stage 5.1 (TID 77)",
    "21/05/02 07:15:31 INFO rdd.HadoopRDD: Input split: hdfs://store-a:8020/lake/clicks/day7.bin:4096+65536",
    "21/05/02 07:16:02 INFO python.PythonRunner: Times: total = 640, boot = 210, init = 30, finish = 400",
    "21/05/02 07:16:40 INFO executor.Executor: Finished task 4.0 in stage 2.0 (TID 31). 1508 bytes result sent to driver",
    "21/05/02 07:14:50 INFO storage.MemoryStore: Block broadcast_3 stored as values in memory (estimated size 6.5 KB, free 81.2 MB)",
    "21/05/02 07:14:55 INFO spark.CacheManager: Partition rdd_4_2 not found, computing it",
    "21/05/02 07:14:56 INFO executor.CoarseGrainedExecutorBackend: Got assigned task 15",
    "21/05/02 07:14:58 INFO BlockManagerInfo: Added broadcast_2_piece5 in memory on node-b:40111 (size: 2.5 MB, free: 7.25 GB)",
    "21/05/03 11:00:04 INFO python.PythonRunner: Times: total = 88, boot = -1200, init = 1230, finish = 58",
    "21/05/03 11:00:09 INFO storage.BlockManager: Found block rdd_17_6 locally",
]
PATH = "file:/data/application_1609459200000_0002/container_1609459200000_0002_01_000003.log"


def logs_of(spark, lines, path=PATH):
    return spark.createDataFrame([(v, path) for v in lines], "value string, file_path string")


def one(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0]


def test_level_substring_and_word(spark):
    df = spark.createDataFrame(
        [("x INFORMATION y",), ("a WARN then ERROR",), ("info lower",), ("",), ("\tat foo(Bar.java:1)",), ("17/03/29 10:04:43 DEBUG x: y",)],
        "value string",
    )
    rows = df.select(P.log_level("value").alias("s"), P.log_level("value", "word").alias("w")).collect()
    assert [(r.s, r.w) for r in rows] == [("INFO", ""), ("WARN", "WARN"), ("", ""), ("", ""), ("", ""), ("DEBUG", "DEBUG")]
    with pytest.raises(ValueError):
        P.log_level("value", "nope")


def test_timestamp_parse(spark):
    df = spark.createDataFrame(
        [("17/03/29 10:04:43 INFO a: b",), ("17/13/40 10:00:00 INFO a: b",), (" 17/03/29 10:04:43",), ("16/02/29 23:59:59 x",),
         ("17/02/29 00:00:00 x",), ("17/03/12 02:30:00 x",), ("",)],
        "value string",
    )
    got = [r.ts for r in df.select(P.line_ts("value").alias("ts")).collect()]
    assert got == [datetime(2017, 3, 29, 10, 4, 43), None, None, datetime(2016, 2, 29, 23, 59, 59), None,
                   datetime(2017, 3, 12, 2, 30), None]
    assert df.select(P.line_ts("value").alias("ts")).schema["ts"].dataType.simpleString() == "timestamp_ntz"


def test_path_ids(spark):
    df = spark.createDataFrame(
        [(PATH,), ("/x/application_1577836800000_0039/container_1577836800000_0039_01_000001.log",),
         ("/x/application_1_12345/c.log",), ("/x/no_app/file.log",)],
        "file_path string",
    )
    rows = df.select(*P.path_ids("file_path"), P.container_id("file_path").alias("c"),
                     P.container_role("file_path").alias("role"), P.container_number("file_path").alias("n")).collect()
    assert tuple(rows[0])[:3] == ("application_1609459200000_0002", "1609459200000", "0002")
    assert rows[0].c == "container_1609459200000_0002_01_000003" and rows[0].role == "executor" and rows[0].n == 3
    assert tuple(rows[1])[:3] == ("application_1577836800000_0039", "1577836800000", "0039") and rows[1].role == "master"
    assert rows[2].app_number == "12345"  # five digits stay whole
    assert tuple(rows[3])[:3] == ("", "", "") and rows[3].role is None


def test_component_size_cluster_start(spark):
    df = spark.createDataFrame([(LINES[1],), (LINES[8],), ("no level here: x",)], "value string")
    assert [r.c for r in df.select(P.component("value").alias("c")).collect()] == ["executor.Executor", "BlockManagerInfo", ""]
    r = one(spark.range(1).select(
        P.size_bytes(F.lit("12.0"), F.lit("KB")).alias("kb"), P.size_bytes(F.lit("7.25"), F.lit("GB")).alias("gb"),
        P.size_bytes(F.lit("x"), F.lit("KB")).alias("bad"), P.cluster_start(F.lit("1609459200123")).alias("t")))
    assert r.kb == 12288.0 and r.gb == 7.25 * 1024**3 and r.bad is None
    assert r.t == datetime(2021, 1, 1, 0, 0, 0, 123000)


def test_elapsed_seconds(spark):
    r = one(spark.range(1).select(
        P.elapsed_seconds(F.lit("2017-01-01 00:00:00").cast("timestamp_ntz"), F.lit("2017-01-01 00:01:40").cast("timestamp_ntz")).alias("d"),
        P.elapsed_seconds(F.lit("2017-01-01 00:01:40").cast("timestamp_ntz"), F.lit("2017-01-01 00:00:00").cast("timestamp_ntz")).alias("neg")))
    assert r.d == 100.0 and r.neg == 0.0


def test_elapsed_seconds_ignore_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        ts = [P.parse_ts(F.lit(t)) for t in ("17/03/12 02:30:00", "17/03/12 03:30:00", "17/03/12 01:00:00")]
        r = one(spark.range(1).select(P.elapsed_seconds(ts[0], ts[1]).alias("gap"), P.elapsed_seconds(ts[2], ts[1]).alias("span"),
                                      P.seconds_between(ts[1], ts[2]).alias("neg")))
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert (r.gap, r.span, r.neg) == (3600.0, 9000.0, -9000.0)


def test_message_parsers(spark):
    logs = logs_of(spark, LINES)
    r = one(M.parse_executor_requests(logs))
    assert (r.executors, r.cores, r.memory_mb, r.overhead_mb) == (3, 7, 9216, 921)
    assert r.application_id == "application_1609459200000_0002" and r.ts == datetime(2021, 5, 2, 7, 15, 9)
    ev = {r.event: r for r in M.parse_task_events(logs).collect()}
    fields = ("task", "attempt", "stage", "stage_attempt", "tid", "result_bytes")
    assert [ev["Running"][f] for f in fields] == [21, 2, 5, 1, 77, None]
    assert [ev["Finished"][f] for f in fields] == [4, 0, 2, 0, 31, 1508]
    r = one(M.parse_input_splits(logs))
    assert (r.input_file, r.offset, r.length) == ("hdfs://store-a:8020/lake/clicks/day7.bin", 4096, 65536)
    times = sorted((r.total_ms, r.boot_ms, r.init_ms, r.finish_ms) for r in M.parse_python_times(logs).collect())
    assert times == [(88, -1200, 1230, 58), (640, 210, 30, 400)]
    r = one(M.parse_block_stored(logs))
    assert (r.block, r.stored_as, r.size_bytes, r.free_bytes) == ("broadcast_3", "values", 6.5 * 1024, 81.2 * 1024**2)
    r = one(M.parse_block_added(logs))
    assert (r.block, r.host, r.port, r.size_bytes, r.free_bytes) == ("broadcast_2_piece5", "node-b", 40111, 2.5 * 1024**2, 7.25 * 1024**3)
    c = sorted((r.block, r.hit) for r in M.parse_cache_lookups(logs).collect())
    assert c == [("rdd_17_6", True), ("rdd_4_2", False)]
    assert one(M.parse_task_assigned(logs)).tid == 15
    extra = logs_of(spark, ["21/05/02 07:14:40 INFO MemoryStore: MemoryStore started with capacity 512.5 MB",
                            "21/05/02 07:14:41 INFO Executor: Started reading broadcast variable 12",
                            "21/05/02 07:14:42 INFO YarnAllocator: Submitted container request (host: Any, capability: <memory:10137, vCores:7>)",
                            "21/05/02 07:14:43 INFO executor.Executor: Starting executor ID 4 on host node-c"])
    assert one(M.parse_memory_capacity(extra)).capacity_bytes == 512.5 * 1024**2
    assert one(M.parse_broadcast_reads(extra)).broadcast_id == 12
    r = one(M.parse_container_requests(extra))
    assert (r.memory_mb, r.vcores) == (10137, 7)
    r = one(M.parse_executor_starts(extra))
    assert (r.executor, r.host) == (4, "node-c")


def test_lines_with_a_marker_only_are_no_messages(spark):
    logs = logs_of(spark, ["21/05/02 07:15:09 INFO x: Will request nothing", "Got assigned task x", "\u00011\u00012 task ", None])
    assert M.parse_executor_requests(logs).count() == M.parse_task_assigned(logs).count() == M.parse_task_events(logs).count() == 0


def test_container_attempt_and_number(spark):
    df = spark.createDataFrame([("/x/container_1609459200000_0007_03_000012.log",), ("/x/other.log",)], "p string")
    rows = df.select(P.container_attempt("p").alias("a"), P.container_number("p").alias("n")).collect()
    assert [tuple(r) for r in rows] == [(3, 12), (None, None)]
