"""Tasks, stages, resources, memory and cache measures from parsed messages.

Task pairing needs no join: Running and Finished lines of one task share the
key (application, container, stage and its attempt, task and its attempt, TID), so one ``groupBy`` with
conditional min/max pairs them in a single shuffle. A key holds two lines at
most, so no key can be hot. Per-application and per-stage measures then work
on one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.functions import parse as P
from logtide.functions.messages import MESSAGES
from logtide.operators import messages as M

TASK_KEY = ["application_id", "container_id", "stage", "stage_attempt", "task", "attempt", "tid"]
STAGE_KEY = ["application_id", "stage", "stage_attempt"]


def tasks(logs: DataFrame) -> DataFrame:
    """One row per task attempt: ``started, finished, duration_seconds, result_bytes``.

    ``finished`` is null for a task whose Finished line is missing.
    """
    ev = M.parse_task_events(logs)
    running = F.col("event") == "Running"
    finished = F.col("event") == "Finished"
    out = ev.groupBy(*TASK_KEY).agg(
        F.min(F.when(running, F.col("ts"))).alias("started"),
        F.max(F.when(finished, F.col("ts"))).alias("finished"),
        F.max("result_bytes").alias("result_bytes"),
    )
    return out.withColumn("duration_seconds", P.seconds_between("started", "finished"))


def unfinished_tasks(logs: DataFrame) -> DataFrame:
    """Tasks that started and never logged Finished."""
    return tasks(logs).filter(F.col("finished").isNull() & F.col("started").isNotNull())


def containers(logs: DataFrame) -> DataFrame:
    """``application_id, container_id, role, app_attempt, container_no``: containers seen in the file paths.

    Lines are reduced per file first (partial aggregate), so the path regexes
    run once per file.
    """
    files = logs.groupBy("file_path").agg(F.count(F.lit(1)).alias("lines"))
    return (
        files.select(
            P.application_id("file_path").alias("application_id"),
            P.container_id("file_path").alias("container_id"),
            P.container_role("file_path").alias("role"),
            P.container_attempt("file_path").alias("app_attempt"),
            P.container_number("file_path").alias("container_no"),
        )
        .filter((F.col("application_id") != "") & (F.col("container_id") != ""))
        .distinct()
    )


def idle_containers(logs: DataFrame) -> DataFrame:
    """Executor containers that logged no task at all.

    One pass instead of an anti join of two reads: task lines are counted
    per file (map-side partial aggregate), then per container; containers
    with zero task lines remain.
    """
    task_line = MESSAGES["task_event"].matches(F.col("value"))
    files = logs.groupBy("file_path").agg(F.count_if(task_line).alias("task_lines"))
    per = (
        files.select(
            P.application_id("file_path").alias("application_id"),
            P.container_id("file_path").alias("container_id"),
            P.container_role("file_path").alias("role"),
            "task_lines",
        )
        .filter((F.col("application_id") != "") & (F.col("container_id") != ""))
        .groupBy("application_id", "container_id", "role")
        .agg(F.sum("task_lines").alias("task_lines"))
    )
    return per.filter((F.col("role") == "executor") & (F.col("task_lines") == 0)).drop("task_lines")


def resource_requests(logs: DataFrame) -> DataFrame:
    """Per application: ``requests, executors, cores, memory_mb`` asked from YARN."""
    r = M.parse_executor_requests(logs)
    return r.groupBy("application_id").agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum("executors").alias("executors"),
        F.sum(F.col("executors") * F.col("cores")).alias("cores"),
        F.sum(F.col("executors") * F.col("memory_mb")).alias("memory_mb"),
    )


def request_shapes(logs: DataFrame) -> DataFrame:
    """Distribution of executor shapes: ``cores, memory_mb, requests, executors``."""
    r = M.parse_executor_requests(logs)
    return r.groupBy("cores", "memory_mb").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("executors").alias("executors")
    )


def request_vs_seen(logs: DataFrame) -> DataFrame:
    """Per application with requests: executors requested and executor containers seen.

    One pass: requested executors are summed per file (map-side partial
    aggregate), then per application together with the count of distinct
    executor containers that left a log file.
    """
    msg = MESSAGES["executor_request"]
    asked = F.get(msg.found(F.col("value")), F.lit(0))
    files = logs.select("file_path", asked.alias("_asked")).groupBy("file_path").agg(
        F.sum(msg.field(F.col("_asked"), "executors")).alias("requested"),
        F.count("_asked").alias("requests"),
    )
    role = P.container_role("file_path")
    per = files.select(
        P.application_id("file_path").alias("application_id"),
        F.when(role == "executor", P.container_id("file_path")).alias("executor"),
        "requested",
        "requests",
    ).filter(F.col("application_id") != "")
    return (
        per.groupBy("application_id")
        .agg(
            F.sum("requested").alias("requested"),
            F.sum("requests").alias("requests"),
            F.count_distinct("executor").alias("seen"),
        )
        .filter(F.col("requests") > 0)
        .select("application_id", "requested", F.col("seen").cast("bigint").alias("seen"))
    )


def task_time_by_app(task_table: DataFrame) -> DataFrame:
    """Per application: ``tasks, finished_tasks, mean_seconds`` (finished tasks only)."""
    return task_table.groupBy("application_id").agg(
        F.count(F.lit(1)).alias("tasks"),
        F.count("finished").alias("finished_tasks"),
        F.avg("duration_seconds").alias("mean_seconds"),
    )


def stage_skew(task_table: DataFrame) -> DataFrame:
    """Per (application, stage, stage attempt): ``tasks, median_seconds, max_seconds, skew`` (max / median).

    The median's buffer holds the distinct durations of one stage attempt,
    whole seconds: at most as many as the stage ran seconds.
    """
    done = task_table.filter(F.col("duration_seconds").isNotNull())
    med = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY duration_seconds)")
    out = done.groupBy(*STAGE_KEY).agg(
        F.count(F.lit(1)).alias("tasks"),
        med.alias("median_seconds"),
        F.max("duration_seconds").alias("max_seconds"),
    )
    return out.withColumn(
        "skew", F.when(F.col("median_seconds") > 0, F.col("max_seconds") / F.col("median_seconds"))
    )


def stage_timeline(task_table: DataFrame) -> DataFrame:
    """Per (application, stage, stage attempt): ``tasks, retried_tasks, first_start, last_finish``."""
    return task_table.groupBy(*STAGE_KEY).agg(
        F.count(F.lit(1)).alias("tasks"),
        F.count_if(F.col("attempt") > 0).alias("retried_tasks"),
        F.min("started").alias("first_start"),
        F.max("finished").alias("last_finish"),
    )


def host_load(logs: DataFrame) -> DataFrame:
    """Per executor host: ``containers, blocks, block_managers, added, added_bytes``.

    One pass over the lines that name a host: executor starts (which link a
    container to its host) and added blocks.
    """
    v = F.col("value")
    start, added = MESSAGES["executor_start"], MESSAGES["block_added"]
    rows = logs.filter(v.contains(start.marker) | v.contains(added.marker)).select(
        P.container_id("file_path").alias("_container"),
        F.get(start.found(v), F.lit(0)).alias("_start"),
        F.get(added.found(v), F.lit(0)).alias("_added"),
    )
    rows = rows.select(
        F.coalesce(start.field(F.col("_start"), "host"), added.field(F.col("_added"), "host")).alias("host"),
        F.when(F.col("_start").isNotNull() & (F.col("_container") != ""), F.col("_container")).alias("container"),
        added.field(F.col("_added"), "block").alias("block"),
        added.field(F.col("_added"), "port").alias("port"),
        added.field(F.col("_added"), "size_bytes").alias("size_bytes"),
    )
    return rows.filter(F.col("host").isNotNull()).groupBy("host").agg(
        F.count_distinct("container").alias("containers"),
        F.count_distinct("block").alias("blocks"),
        F.count_distinct("port").alias("block_managers"),
        F.count("block").alias("added"),
        F.sum("size_bytes").alias("added_bytes"),
    )


def memory_profile(logs: DataFrame) -> DataFrame:
    """Per application: ``capacity_bytes, blocks_stored, peak_block_bytes, min_free_bytes``.

    One pass: each message's regex runs once on the lines that hold its
    marker, and one ``groupBy`` folds them.
    """
    v = F.col("value")
    cap, blk = MESSAGES["memory_capacity"], MESSAGES["block_stored"]
    rows = logs.filter(v.contains(cap.marker) | v.contains(blk.marker)).select(
        P.application_id("file_path").alias("application_id"),
        F.get(cap.found(v), F.lit(0)).alias("_cap"),
        F.get(blk.found(v), F.lit(0)).alias("_blk"),
    )
    out = rows.groupBy("application_id").agg(
        F.max(cap.field(F.col("_cap"), "capacity_bytes")).alias("capacity_bytes"),
        F.count("_blk").alias("blocks_stored"),
        F.max(blk.field(F.col("_blk"), "size_bytes")).alias("peak_block_bytes"),
        F.min(blk.field(F.col("_blk"), "free_bytes")).alias("min_free_bytes"),
        F.count(F.coalesce("_cap", "_blk")).alias("_lines"),
    )
    return out.filter("_lines > 0").drop("_lines")


def cache_ratio(logs: DataFrame) -> DataFrame:
    """Per application: ``lookups, hits, hit_ratio`` of RDD block lookups."""
    c = M.parse_cache_lookups(logs)
    return c.groupBy("application_id").agg(
        F.count(F.lit(1)).alias("lookups"),
        F.count_if("hit").alias("hits"),
        F.avg(F.col("hit").cast("double")).alias("hit_ratio"),
    )


def python_times(logs: DataFrame) -> DataFrame:
    """Per application: Python worker runs and their summed / mean times (ms)."""
    p = M.parse_python_times(logs)
    return p.groupBy("application_id").agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum("total_ms").alias("total_ms"),
        F.sum("boot_ms").alias("boot_ms"),
        F.sum("init_ms").alias("init_ms"),
        F.sum("finish_ms").alias("finish_ms"),
        F.avg("total_ms").alias("mean_total_ms"),
    )


def input_bytes(logs: DataFrame) -> DataFrame:
    """Per input file: ``splits, bytes`` read by tasks."""
    s = M.parse_input_splits(logs)
    return s.groupBy("input_file").agg(F.count(F.lit(1)).alias("splits"), F.sum("length").alias("bytes"))
