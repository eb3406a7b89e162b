"""The event feed and the record plan on it: texts, parallel tasks, exchanges."""

import os
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from logtide.operators import records as RC
from logtide.sources import feeds


def event_rows(n, seed=1):
    rnd = random.Random(seed)
    kinds = ["click", "purchase", "signup", "view", "error", None]
    start = datetime(2024, 1, 1)
    return [(e, start + timedelta(seconds=rnd.randrange(40 * 86_400)), rnd.randrange(12), rnd.choice(kinds), rnd.random() * 500) for e in range(n)]


SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def test_texts_as_format_string_makes_them(spark):
    """Nulls, signs and numbers wider than the width as the formatter writes them; a pattern without widths does without it."""
    rows = [(n, s) for n in (None, 0, 7, 39, 9999, 10_000, 123_456_789_012, -1, -12_345) for s in (None, "", "a%d")]
    df = spark.createDataFrame(rows, "n long, s string")
    for pattern in ("%d", "%s|%d", "/x_%s_%04d_%02d.log", "%06d", "at %s: %04d%s"):
        cols = [F.col("s") if k == "s" else F.col("n") for k in (x[-1] for x in feeds.re.findall(r"%0?\d*[ds]", pattern))]
        got = df.select(feeds._fmt(pattern, *cols).alias("got"), F.format_string(pattern, *cols).alias("exp")).collect()
        assert all(r.got == r.exp for r in got), pattern
    plan = feeds.event_log_lines(spark.createDataFrame(event_rows(5), SCHEMA)).select("value")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("format_string") == 1  # module%02d, for what does not fit the width


def test_lines_of_one_row_group_are_made_by_many_tasks(spark, tmp):
    spark.createDataFrame(event_rows(4000), SCHEMA).coalesce(1).write.parquet(os.path.join(tmp, "events.parquet"))
    plain = feeds.load_event_logs(spark, tmp, spread=False)
    logs = feeds.load_event_logs(spark, tmp)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = [r["count"] for r in logs.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) == 8 and max(tasks) < 2 * sum(tasks) / len(tasks)
    assert sorted(map(str, logs.collect())) == sorted(map(str, plain.collect()))


def test_splits_of_the_feed_are_few_and_in_order(spark):
    logs = feeds.event_log_lines(spark.createDataFrame(event_rows(3000), SCHEMA))
    rows = logs.groupBy("file_path", "line_split").agg(F.min("line_order").alias("lo"), F.max("line_order").alias("hi"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in rows) / len(rows) > 40
    rows.sort(key=lambda r: (r.file_path, r.line_split))
    assert all(a.file_path != b.file_path or a.hi < b.lo for a, b in zip(rows, rows[1:]))


def test_records_move_each_line_twice(spark):
    """Lines are dealt out by (file, split) and by record, and not again for the join; a null split is a split of its own."""
    lines = []
    for f in ("a", "b"):
        for i in range(60):
            split = None if i < 7 else i // 10
            lines.append((f, f"21/05/02 10:00:{i:02d} INFO x: {i}" if i % 4 == 1 else f"\tat {i}", i, split))
    logs = spark.createDataFrame(lines, "file_path string, value string, line_order long, line_split long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        recs = RC.assemble_records(logs)
        plan = recs._jdf.queryExecution().executedPlan().toString()
        got = sorted((r.file_path, r.record_no, r.part, r.lines, r.text) for r in recs.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # The lines of each of the two branches, the splits by file and for the join, the records.
    assert plan.count("Exchange hashpartitioning") == 5 and plan.count("Window [") == 2
    exp = []
    for f in ("a", "b"):
        value = [v for p, v, _, _ in lines if p == f]
        exp.append((f, 0, 0, 1, value[0]))
        exp += [(f, k + 1, 0, len(value[i : i + 4]), "\n".join(value[i : i + 4])) for k, i in enumerate(range(1, 60, 4))]
    assert got == exp
    parts = RC.assemble_records(logs, max_lines=3)
    assert parts.filter("record_no > 0").groupBy().agg(F.max("part"), F.max("lines")).collect()[0][:] == (1, 3)
