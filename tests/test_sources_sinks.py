"""Sources and sinks on real files in temp folders."""

import gzip
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logtide import sinks
from logtide.operators import levels as L
from logtide.operators import records as RC
from logtide.operators import usage as U
from logtide.sources import tables as TB
from logtide.sources.logs import LogFiles, list_log_files, read_logs
from logtree import all_lines, write_tree


def test_read_logs_recursive_glob_and_path(spark, tmp):
    root = write_tree(tmp)
    df = read_logs(spark, root)
    rows = df.collect()
    assert len(rows) == len(all_lines())  # the .gz is not read
    assert all(r.file_path.endswith(".log") for r in rows)
    got = sorted((os.path.relpath(r.file_path.replace("file:", ""), root), r.value) for r in rows)
    assert got == sorted(all_lines())
    # ``**`` form and no glob: the gz is decompressed and read too
    assert read_logs(spark, root, glob=None).count() == len(all_lines()) + 1
    plan = df.filter(F.col("file_path").contains("0039"))._jdf.queryExecution().executedPlan().toString()
    assert "file_path" in plan


def test_results_do_not_depend_on_file_size(spark, tmp):
    # One reading path: a space in the path, a byte order mark, a small and a large file.
    d = os.path.join(tmp, "application_1609459200000_0001 x")
    os.makedirs(d)
    head = "\ufeff21/05/02 07:00:00 INFO a: first\r\n\tcont\n"
    small, large = os.path.join(d, "small.log"), os.path.join(d, "large.log")
    body = "".join(f"21/05/02 07:{i // 60 % 60:02d}:{i % 60:02d} INFO a: line {i} {'x' * 80}\n" for i in range(90_000))
    for path, text in ((small, head), (large, head + body)):
        with open(path, "w", encoding="utf-8", newline="") as f:
            f.write(text)
    assert os.path.getsize(large) > 8 * 1024 * 1024
    plain = spark.read.option("recursiveFileLookup", "true").text(tmp).select("value", F.col("_metadata.file_path").alias("file_path"))
    logs = read_logs(spark, tmp, with_order=True)
    assert logs.select("value", "file_path").exceptAll(plain).isEmpty() and plain.exceptAll(logs.select("value", "file_path")).isEmpty()
    spans = {r.file_path.rsplit("/", 1)[1]: r for r in U.file_spans(logs).collect()}
    assert spans["small.log"].lines == 1 and spans["large.log"].lines == 90_001
    assert spans["small.log"].first_ts == spans["large.log"].first_ts == datetime(2021, 5, 2, 7, 0)
    assert {r.file_path for r in spans.values()} == {r.file_path for r in list_log_files(spark, tmp).collect()}
    assert all("%20x/" in r.file_path for r in spans.values())
    key = ["log_entry", "log_level"]
    sample = lambda df: sorted(map(tuple, L.level_sample(df, n=5, seed=1, method="hash").select(*key).collect()))
    assert sample(logs) == sample(plain)
    recs = RC.read_records(spark, tmp)
    first = {r.file_path.rsplit("/", 1)[1]: (r.lines, r.ts) for r in recs.filter("record_no = 1 AND part = 0").collect()}
    assert first == {n: (2, datetime(2021, 5, 2, 7, 0)) for n in ("small.log", "large.log")}


def test_whole_files_give_the_same_rows(spark, tmp):
    """Byte for byte what the text source gives, whatever is read whole."""
    d = os.path.join(tmp, "application_1609459200000_0001 x")
    os.makedirs(d)
    bodies = [
        b"", b"\n", b"\r", b"\r\n", b"a", b"a\r\rb\n\nc\r\n\r\n", b"\xef\xbb\xbfafter a mark\nb", b"\xef\xbb\xbf", b"\xef\xbb\xbf\xef\xbb\xbfx\n",
        b"not \xff UTF-8 \x80\nnext \xc3\r\n\xa9 cut\n", "ü 漢 😀\n\u0085\u2028x\n".encode(), b"nul \0 \x1c \x0b \x0c\nx\n",
        b"above \xff\n\n21/05/02 07:00:00 ERROR a: \xfe\n\tat \xfd\r21/05/02 07:00:01 INFO b\n", b"21/05/02 07:00:00 WARN a\n\n21/05/02 7:00:01\n\n", b"x" * 5000 + b"\n" + b"y" * 10,
    ]
    for i, body in enumerate(bodies):
        with open(os.path.join(d, f"f{i:02d}.log"), "wb") as f:
            f.write(body)
    with gzip.open(os.path.join(d, "packed.log.gz"), "wb") as f:
        f.write(b"in a\narchive\n")
    cols = [F.hex(F.encode("value", "UTF-8")).alias("shown"), F.hex(F.col("value").cast("binary")).alias("bytes"), "file_path", "file_size", "line_split"]
    for glob in ("*.log", None):
        read = lambda whole: read_logs(spark, tmp, glob, with_size=True, with_order=True, whole_bytes=whole)
        plain = read(None)
        want = sorted(map(tuple, plain.select(*cols).collect()))
        lines = [r.value for r in plain.filter(F.col("file_path").endswith("f05.log")).orderBy("line_order").collect()]
        assert len(want) > 20 and lines == ["a", "", "b", "", "c", ""]
        for whole in (1 << 20, 30, 0):
            assert read(whole).dtypes == plain.dtypes
            assert sorted(map(tuple, read(whole).select(*cols).collect())) == want
        assert [r.value for r in read(1 << 20).filter(F.col("file_path").endswith("f05.log")).orderBy("line_order").collect()] == lines
        records = lambda whole: sorted(map(str, RC.read_records(spark, tmp, glob, whole_bytes=whole).withColumn("text", F.hex(F.col("text").cast("binary"))).collect()))
        assert RC.read_records(spark, tmp, glob, whole_bytes=1 << 20).dtypes == RC.read_records(spark, tmp, glob).dtypes
        assert records(1 << 20) == records(30) == records(None)
    small = LogFiles(spark, tmp, whole_bytes=1 << 20)
    assert "Exchange" not in RC.records_of(small)._jdf.queryExecution().executedPlan().toString()
    assert small._text is None and LogFiles(spark, tmp, whole_bytes=30)._text is not None
    assert LogFiles(spark, tmp, None, whole_bytes=1 << 20)._text is not None


@pytest.mark.parametrize("whole", [None, 1 << 20])
def test_line_breaks(spark, tmp, whole):
    files = {
        "a.log": "l1\nl2\n", "b.log": "no newline at end", "c.log": "", "d.log": "x\r\ny\rz\n\n", "e.log": "\n",
        "f.log": "tab\there\nü unicode\n",
    }
    for name, body in files.items():
        with open(os.path.join(tmp, name), "w", newline="") as f:
            f.write(body)
    got = {}
    for r in read_logs(spark, tmp, with_order=True, whole_bytes=whole).orderBy("file_path", "line_order").collect():
        got.setdefault(os.path.basename(r.file_path), []).append(r.value)
    assert got == {"a.log": ["l1", "l2"], "b.log": ["no newline at end"], "d.log": ["x", "y", "z", ""], "e.log": [""],
                   "f.log": ["tab\there", "ü unicode"]}


def test_read_logs_size_and_listing(spark, tmp):
    root = write_tree(tmp)
    sizes = {r.file_path: r.file_size for r in read_logs(spark, root, with_size=True).select("file_path", "file_size").distinct().collect()}
    listed = {r.file_path: r.file_size for r in list_log_files(spark, root).collect()}
    assert sizes == listed and len(listed) == 5


def test_tables_and_months(spark, tmp):
    assert TB.month_paths("s3a://b/trips", 2021, [1, 12]) == [
        "s3a://b/trips/yyyy=2021/yellow_tripdata_2021-01.parquet",
        "s3a://b/trips/yyyy=2021/yellow_tripdata_2021-12.parquet",
    ]
    base = os.path.join(tmp, "trips")
    df = spark.createDataFrame(
        [(datetime(2021, m, 3), 2021, float(m)) for m in (1, 2, 3)] + [(datetime(2020, 5, 1), 2020, 9.0)],
        "tpep_pickup_datetime timestamp_ntz, yyyy int, fare_amount double",
    )
    df.write.partitionBy("yyyy").parquet(base)
    got = TB.read_months(spark, base, 2021, months=[1, 3], ts="tpep_pickup_datetime")
    assert sorted(r.fare_amount for r in got.collect()) == [1.0, 3.0]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "yyyy" in plan
    assert TB.read_tables(spark, base, header="true").count() == 4  # unknown option is harmless
    assert TB.read_months(spark, base, 2021, months=[], ts="tpep_pickup_datetime").count() == 0
    assert TB.read_months(spark, base, 2021).count() == 3
    with pytest.raises(ValueError):
        TB.read_months(spark, base, 2021, months=[1])


def test_month_files_keep_stray_rows(spark, tmp):
    base = os.path.join(tmp, "trips")
    for m, rows in {1: [datetime(2021, 1, 3), datetime(2021, 7, 1)], 2: [datetime(2021, 2, 3)]}.items():
        df = spark.createDataFrame([(t, 1.0) for t in rows], "tpep_pickup_datetime timestamp_ntz, fare_amount double")
        df.write.parquet(TB.month_paths(base, 2021, [m])[0])
    got = TB.read_month_files(spark, base, 2021, [1])
    assert sorted(r[0] for r in got.select("tpep_pickup_datetime").collect()) == [datetime(2021, 1, 3), datetime(2021, 7, 1)]
    assert TB.read_month_files(spark, base, 2021, []) is None
    assert TB.store_path("s3://b/x") == "s3a://b/x" and TB.store_path("/x") == "/x"


def test_resolve_input(tmp):
    assert TB.resolve_input("s3://bucket/logs/") == "s3a://bucket/logs"
    assert TB.resolve_input(None, env={"LOGTIDE_BUCKET": "s3://b"}) == "s3a://b/data"
    assert TB.resolve_input(None, env={}, sample=tmp) == tmp
    assert TB.resolve_input(None, env={}, sample=os.path.join(tmp, "none"), raw="data/raw") == "data/raw"


def test_small_csv_and_timeline_roundtrip(spark, tmp):
    tl = spark.createDataFrame(
        [("1577836800000", "application_1577836800000_0039", "0039", datetime(2015, 9, 1, 18, 14, 40), datetime(2015, 9, 1, 18, 19, 50), 310.0)],
        TB.TIMELINE_SCHEMA,
    )
    p = sinks.write_small_csv(tl, os.path.join(tmp, "timeline.csv"))
    with open(p) as f:
        text = f.read()
    assert text.splitlines() == [
        "cluster_id,application_id,app_number,start_time,end_time,duration_seconds",
        "1577836800000,application_1577836800000_0039,0039,2015-09-01 18:14:40,2015-09-01 18:19:50,310.0",
    ]
    back = TB.read_timeline(spark, p).collect()
    assert back == tl.collect()  # 0039 survives as text


def test_csv_quotes_are_doubled(spark, tmp):
    df = spark.createDataFrame([('say "hi", ok', "INFO")], "log_entry string, log_level string")
    p = sinks.write_small_csv(df, os.path.join(tmp, "s.csv"))
    with open(p) as f:
        assert f.read().splitlines()[1] == '"say ""hi"", ok",INFO'


def test_write_text_and_table(spark, tmp):
    lines = spark.createDataFrame([(2, "b"), (1, "a"), (3, "")], "line_no int, line string")
    p = sinks.write_text(lines, os.path.join(tmp, "r.txt"))
    with open(p) as f:
        assert f.read() == "a\nb\n\n"
    out = sinks.write_table(spark.range(10).withColumn("k", F.col("id") % 2), os.path.join(tmp, "t"), partition_by="k")
    assert spark.read.parquet(out).count() == 10


def test_a_failed_write_keeps_the_old_file(spark, tmp):
    path = os.path.join(tmp, "r.txt")
    lines = spark.createDataFrame([(1, "a")], "line_no int, line string")
    sinks.write_text(lines, path)
    sinks.write_text(lines.withColumn("line", F.lit("b")), path)
    with open(path) as f:
        assert f.read() == "b\n"
    assert sorted(n for n in os.listdir(tmp) if not n.startswith(".")) == ["r.txt"]
