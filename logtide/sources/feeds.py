"""Log and trip feeds derived from the driver's tables.

The driver's test data holds no Spark logs, so these functions turn every row
of ``events`` into the lines a Spark-on-YARN container writes, and rename
``lineitem`` / ``orders`` columns to the trip-table schema. The feed's work
grows with the tables it reads; nothing is sampled or capped.

The SQL twin of the log feed (for the DuckDB oracle) lives in
``logtide.plans.oracle`` and must build byte-identical lines.

Feed specification (fixed; one event -> its lines, ``e`` = event_id,
``u`` = user_id, ``v`` = floor(value), ``T`` = ts plus 31 days * (u % 3), to
the second):

* path: ``/logs/application_<c>_<a>/container_<c>_<a>_<p>_<k>.log`` with
  cluster ``c = 1704067200000 + (0 if u % 10 < 6 else u % 6)`` (one cluster has
  most applications), application number ``a = %04d u``, application attempt
  ``p`` = 02 if u % 9 = 4 else 01 and container ``k = %06d (e % (1 + u % 8) + 1)``
  (container 1 is the ApplicationMaster). When ``e % 50 = 49`` the path names
  no application: ``/logs/misc/daemon-<u % 4>.log``.
* click: ``Got assigned task``, ``Running task``, ``Input split`` at T, and
  ``Finished task ... bytes result sent to driver`` at T + v seconds except
  when ``e % 10 = 0`` (a task that never finishes). The task is attempt 1 when
  ``e % 17 = 0``, its stage attempt 1 when ``e % 11 = 0``.
* purchase: ``Times: total = ..`` (boot may be negative). When ``e % 97 = 0``
  the time stamp has the right shape but an impossible value (``24/13/40``).
  Then a line of one of 25 further components.
* signup: ``Will request``, a container request with ``capability``,
  ``MemoryStore started with capacity``, a WARN ``Lost task`` line that also
  names ERROR when ``e % 4 = 0``, and ``Starting executor ID k on host``.
* view: ``Block ... stored as values``, ``Added ... in memory on``, a cache
  miss (``e % 3 = 0``) or hit, ``Started reading broadcast variable`` and a
  line without a level word whose text holds ``INFORMATIONAL``.
* error: an ERROR head line, two continuation lines without time stamp, and
  an empty line when ``e % 3 = 0``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.sources.tables import read_tables

# Fixed values of the feed.
CLUSTER_BASE = 1704067200000
N_CLUSTERS = 6
N_CONTAINERS = 8
BAD_TS_TEXT = "24/13/40 25:61:61"

SPEC = r"%0?\d*[ds]"


def _fmt(pattern: str, *cols: Column) -> Column:
    """``format_string`` of a pattern with ``%s``, ``%d`` and ``%0<width>d`` only, as a concatenation.

    The text is the same, ``null`` for a null included. ``java.util.Formatter``, which
    reads the pattern again for each row, took most of the time of the whole feed.
    """
    texts, pieces = re.split(SPEC, pattern), []
    for text, spec, c in zip(texts, re.findall(SPEC, pattern), cols, strict=False):
        value = F.coalesce(c.cast("string"), F.lit("null"))
        if width := int(spec[1:-1] or 0):
            # Signs, longer numbers and nulls are left to the formatter.
            short = (c >= 0) & (c < 10**width)
            value = F.coalesce(F.when(short, F.lpad(c.cast("string"), width, "0")), F.format_string(spec, c))
        pieces += [F.lit(text), value]
    return F.concat(*pieces, F.lit(texts[-1]))


def _line(seq: int, t: Column, value: Column) -> Column:
    return F.struct(F.lit(seq).alias("seq"), t.alias("t"), value.alias("value"))


def event_log_lines(events: DataFrame) -> DataFrame:
    """Spark-on-YARN log lines made from ``events``.

    Columns: ``file_path STRING, value STRING`` (the shape of ``read_logs``)
    plus ``line_order STRUCT<t, event_id, seq>`` that sorts the lines of one
    file in writing order and ``line_split DATE``, a coarse part of that order
    (the month: all lines of one come before those of the next; most files have a line or two a day).
    """
    e = F.col("event_id")
    u = F.col("user_id")
    # What all lines of an event share is a column below the explode, so that it is made once for each event.
    v, t, tt, kind = (F.col(c) for c in ("v", "t", "tt", "event_type"))
    # Wall-clock time stamps (a no-op when Parquet is read as TIMESTAMP_NTZ).
    shared = {
        "v": F.floor("value").cast("bigint"),
        "t": F.timestamp_add("DAY", F.lit(31) * (u % 3), F.col("ts").cast("timestamp_ntz")),
    }
    t_fin = F.timestamp_add("SECOND", v, t)
    tt_fin = F.date_format(t_fin, "yy/MM/dd HH:mm:ss")

    cluster = F.lit(CLUSTER_BASE) + F.when(u % 10 < 6, 0).otherwise(u % N_CLUSTERS)
    app = _fmt("%04d", u)
    container = e % (F.lit(1) + u % N_CONTAINERS) + 1
    attempt = F.when(u % 9 == 4, 2).otherwise(1)
    path = F.when(e % 50 == 49, _fmt("/logs/misc/daemon-%d.log", u % 4)).otherwise(
        _fmt("/logs/application_%d_%s/container_%d_%s_%02d_%06d.log", cluster, app, cluster, app, attempt, container)
    )

    again, stage_again = F.when(e % 17 == 0, 1).otherwise(0), F.when(e % 11 == 0, 1).otherwise(0)
    task = _fmt("%d.%d in stage %d.%d (TID %d)", e % 13, again, e % 7, stage_again, e)
    mem = F.lit(1408) + F.lit(1024) * (u % 8)
    cores = F.lit(1) + e % 5
    rdd = _fmt("rdd_%d_%d", u % 30, e % 20)
    size = _fmt("%d.%d", v, e % 10)

    click = F.array(
        _line(0, t, _fmt("%s INFO executor.CoarseGrainedExecutorBackend: Got assigned task %d", tt, e)),
        _line(1, t, _fmt("%s INFO executor.Executor: Running task %s", tt, task)),
        _line(
            2,
            t,
            _fmt(
                "%s INFO rdd.HadoopRDD: Input split: hdfs://storage-1:8020/data/part-%d.txt:%d+%d",
                tt, e % 5, v * 1000, F.lit(1000) + e % 997,
            ),
        ),
        _line(
            3,
            t_fin,
            F.when(
                e % 10 != 0,
                _fmt(
                    "%s INFO executor.Executor: Finished task %s. %d bytes result sent to driver",
                    tt_fin, task, F.lit(1000) + v * 13,
                ),
            ),
        ),
    )
    purchase = F.array(
        _line(
            0,
            t,
            _fmt(
                "%s INFO python.PythonRunner: Times: total = %d, boot = %d, init = %d, finish = %d",
                F.when(e % 97 == 0, F.lit(BAD_TS_TEXT)).otherwise(tt),
                v + 50, e % 40 - 20, e % 30, v,
            ),
        ),
        _line(1, t, _fmt("%s INFO module%02d.Stage: step %d done", tt, e % 25, e)),
    )
    signup = F.array(
        _line(
            0,
            t,
            _fmt(
                "%s INFO yarn.YarnAllocator: Will request %d executor containers, each with %d cores "
                "and %d MB memory including 384 MB overhead",
                tt, F.lit(1) + e % 16, cores, mem,
            ),
        ),
        _line(
            1,
            t,
            _fmt(
                "%s INFO yarn.YarnAllocator: Submitted container request (host: Any, "
                "capability: <memory:%d, vCores:%d>)",
                tt, mem, cores,
            ),
        ),
        _line(
            2,
            t,
            _fmt("%s INFO storage.MemoryStore: MemoryStore started with capacity %d.%d MB", tt, v + 100, e % 10),
        ),
        _line(
            3,
            t,
            _fmt(
                "%s WARN scheduler.TaskSetManager: Lost task %d.0 in stage %d.0 (TID %d, host-%d): "
                "ExecutorLostFailure%s",
                tt, e % 13, e % 7, e, u % 9,
                F.when(e % 4 == 0, F.lit(" (ERROR exit code 143)")).otherwise(F.lit("")),
            ),
        ),
        _line(4, t, _fmt("%s INFO executor.Executor: Starting executor ID %d on host host-%d", tt, container, (u + container) % 9)),
    )
    view = F.array(
        _line(
            0,
            t,
            _fmt(
                "%s INFO storage.MemoryStore: Block broadcast_%d stored as values in memory "
                "(estimated size %s KB, free %d.%d MB)",
                tt, e % 50, size, F.lit(100) + u % 400, e % 7,
            ),
        ),
        _line(
            1,
            t,
            _fmt(
                "%s INFO storage.BlockManagerInfo: Added broadcast_%d_piece0 in memory on host-%d:%d "
                "(size: %s KB, free: %d.%d GB)",
                tt, e % 50, u % 9, F.lit(40000) + e % 1000, size, u % 20, e % 10,
            ),
        ),
        _line(
            2,
            t,
            F.when(
                e % 3 == 0,
                _fmt("%s INFO spark.CacheManager: Partition %s not found, computing it", tt, rdd),
            ).otherwise(_fmt("%s INFO storage.BlockManager: Found block %s locally", tt, rdd)),
        ),
        _line(3, t, _fmt("%s INFO broadcast.TorrentBroadcast: Started reading broadcast variable %d", tt, e % 50)),
        _line(4, t, _fmt("%s storage.BlockManager: INFORMATIONAL usage report for %s", tt, rdd)),
    )
    error = F.array(
        _line(0, t, _fmt("%s ERROR executor.Executor: Exception in task %s", tt, task)),
        _line(1, t, _fmt("java.io.IOException: Disk %d unavailable", e % 4)),
        _line(2, t, _fmt("\tat org.apache.spark.storage.DiskStore.put(DiskStore.scala:%d)", F.lit(40) + e % 60)),
        _line(3, t, F.when(e % 3 == 0, F.lit(""))),
    )
    lines = (
        F.when(kind == "click", click)
        .when(kind == "purchase", purchase)
        .when(kind == "signup", signup)
        .when(kind == "view", view)
        .when(kind == "error", error)
    )
    return (
        events.select("event_id", "user_id", "event_type", *[c.alias(k) for k, c in shared.items()])
        .select("*", path.alias("file_path"), F.date_format("t", "yy/MM/dd HH:mm:ss").alias("tt"))
        .select("file_path", "event_id", F.explode(F.filter(lines, lambda x: x["value"].isNotNull())).alias("l"))
        .select(
            "file_path",
            F.col("l.value").alias("value"),
            F.struct(F.col("l.t").alias("t"), "event_id", F.col("l.seq").alias("seq")).alias("line_order"),
            F.to_date(F.trunc("l.t", "MM")).alias("line_split"),
        )
    )


def trips_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """``lineitem`` under the trip-table names used by the daily summary."""
    return lineitem.select(
        F.col("l_shipdate").cast("timestamp_ntz").alias("tpep_pickup_datetime"),
        F.col("l_quantity").alias("trip_distance"),
        F.col("l_tax").alias("mta_tax"),
        F.col("l_extendedprice").alias("fare_amount"),
        F.col("l_discount").alias("tip_amount"),
        F.col("l_linenumber").alias("passenger_count"),
    )


def load_event_logs(spark, sf_dir: str, spread: bool = True) -> DataFrame:
    """The log feed of ``<sf_dir>/events.parquet``.

    A Parquet row group is read by one task, and a few bytes of it become some
    four lines of text. So with ``spread`` the events are dealt out before their lines are made.
    """
    events = read_tables(spark, f"{sf_dir}/events.parquet")
    return event_log_lines(events.repartition("event_id", "user_id", "ts") if spread else events)


def load_trips(spark, sf_dir: str) -> DataFrame:
    """The trip feed of ``<sf_dir>/lineitem.parquet``."""
    return trips_from_lineitem(read_tables(spark, f"{sf_dir}/lineitem.parquet"))
