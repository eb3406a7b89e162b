"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Every query reads the driver's tables (through the feeds of
``logtide.sources.feeds``) in full; ``logtide.plans.oracle`` holds the DuckDB
twin under the same name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.operators import chartdata as C
from logtide.operators import daily as D
from logtide.operators import inventory as I
from logtide.operators import levels as L
from logtide.operators import messages as M
from logtide.operators import records as RC
from logtide.operators import tasks as T
from logtide.operators import usage as U
from logtide.plans import reports as R
from logtide.sources.feeds import load_event_logs, load_trips
from logtide.sources.tables import read_tables

Query = Callable[[SparkSession, str], DataFrame]


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_event_logs(spark, sf_dir)


def _timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.app_spans(_logs(spark, sf_dir)).select(*U.TIMELINE_COLUMNS)


def _sql_view_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line count in Spark SQL over a DataFrame parameter (no view is left behind)."""
    return spark.sql("SELECT COUNT(*) AS total FROM {lines}", lines=_logs(spark, sf_dir))


def level_queries() -> dict[str, Query]:
    return {
        "level_counts": lambda s, d: L.level_counts(_logs(s, d)),
        "level_counts_word": lambda s, d: L.level_counts(_logs(s, d), mode="word", zero_fill=False, order="count"),
        "level_summary": lambda s, d: L.level_summary(_logs(s, d)),
        "level_histogram": lambda s, d: L.level_histogram(_logs(s, d)),
        "level_report_local": lambda s, d: R.level_report(_logs(s, d), style="local"),
        "sql_view_count": _sql_view_count,
        "level_report": lambda s, d: R.level_report(_logs(s, d)),
        "level_sample": lambda s, d: L.level_sample(_logs(s, d), n=10, seed=42, method="hash"),
        # rand() depends on the partitions: those of the table.
        "level_sample_random": lambda s, d: L.level_sample(load_event_logs(s, d, spread=False), n=10, seed=42, method="rand"),
        "level_occurrences": lambda s, d: L.level_occurrences(_logs(s, d)),
        "component_counts": lambda s, d: L.component_counts(_logs(s, d), top=20),
        "component_counts_all": lambda s, d: L.component_counts(_logs(s, d), top=None),
        "parse_quality": lambda s, d: L.parse_quality(_logs(s, d)),
        "error_lines": lambda s, d: L.lines_containing(_logs(s, d), "ERROR"),
    }


def usage_queries() -> dict[str, Query]:
    return {
        "app_timeline": lambda s, d: U.app_timeline(_logs(s, d)),
        "file_spans": lambda s, d: U.file_spans(_logs(s, d)),
        "cluster_summary": lambda s, d: U.cluster_summary(_timeline(s, d)),
        "usage_stats": lambda s, d: U.usage_stats(U.cluster_summary(_timeline(s, d), ordered=False)),
        "usage_report": lambda s, d: R.usage_report(U.cluster_summary(_timeline(s, d), ordered=False)),
        "top_cluster": lambda s, d: U.top_cluster(_timeline(s, d)),
        "top_cluster_apps": lambda s, d: U.top_cluster_apps(_timeline(s, d)),
        "longest_application": lambda s, d: U.longest_applications(_timeline(s, d), k=1),
        "cluster_activity": lambda s, d: U.cluster_activity(U.cluster_summary(_timeline(s, d), ordered=False)),
        "cluster_share": lambda s, d: U.cluster_share(U.cluster_summary(_timeline(s, d), ordered=False)),
        "cluster_work": lambda s, d: U.cluster_work(_timeline(s, d)),
        "monthly_starts": lambda s, d: U.monthly_starts(_timeline(s, d)),
        "duration_profile": lambda s, d: U.duration_profile(_timeline(s, d)),
        "cluster_distribution": lambda s, d: U.cluster_distribution(_timeline(s, d)),
        "concurrency": lambda s, d: U.concurrency(_timeline(s, d)),
        "start_gaps": lambda s, d: U.start_gaps(_timeline(s, d)),
        "concurrency_hourly": lambda s, d: U.concurrency(_timeline(s, d), bucket_seconds=3600),
        "start_gaps_hourly": lambda s, d: U.start_gaps(_timeline(s, d), bucket_seconds=3600),
    }


# The second daily summary (orders per order date).
ORDER_SPEC = (
    ("num_orders", "count", None),
    ("mean_totalprice", "avg", "o_totalprice"),
    ("max_totalprice", "max", "o_totalprice"),
    ("q95_totalprice", "q95", "o_totalprice"),
    ("min_totalprice", "min", "o_totalprice"),
)


def _orders_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_tables(spark, f"{sf_dir}/orders.parquet")
    orders = orders.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))
    daily = D.daily_summary(orders, ts="o_orderdate", spec=ORDER_SPEC)
    # Means of non-integer values are reported to 6 decimals.
    return daily.withColumn("mean_totalprice", F.round("mean_totalprice", 6))


def daily_queries() -> dict[str, Query]:
    return {
        "daily_summary": lambda s, d: D.daily_summary(load_trips(s, d), year=1997),
        "daily_overview": lambda s, d: D.daily_overview(D.daily_summary(load_trips(s, d), year=1997)),
        "monthly_summary_exact": lambda s, d: D.daily_summary(load_trips(s, d), quantile="exact", grain="month"),
        "orders_daily_summary": _orders_daily,
    }


def chart_queries() -> dict[str, Query]:
    return {
        "bar_data": lambda s, d: C.bar_data(U.cluster_summary(_timeline(s, d), ordered=False)),
        "duration_histogram": lambda s, d: C.duration_histogram(_timeline(s, d), bins=50),
        "duration_histogram_log": lambda s, d: C.duration_histogram(_timeline(s, d), bins=50, scale="log"),
        "duration_density": lambda s, d: C.duration_density(_timeline(s, d), grid=200),
    }


def message_queries() -> dict[str, Query]:
    return {
        "executor_requests": lambda s, d: M.parse_executor_requests(_logs(s, d)),
        "container_requests": lambda s, d: M.parse_container_requests(_logs(s, d)),
        "task_events": lambda s, d: M.parse_task_events(_logs(s, d)),
        "task_assigned": lambda s, d: M.parse_task_assigned(_logs(s, d)),
        "input_splits": lambda s, d: M.parse_input_splits(_logs(s, d)),
        "python_times": lambda s, d: M.parse_python_times(_logs(s, d)),
        "memory_capacity": lambda s, d: M.parse_memory_capacity(_logs(s, d)),
        "block_stored": lambda s, d: M.parse_block_stored(_logs(s, d)),
        "block_added": lambda s, d: M.parse_block_added(_logs(s, d)),
        "cache_lookups": lambda s, d: M.parse_cache_lookups(_logs(s, d)),
        "broadcast_reads": lambda s, d: M.parse_broadcast_reads(_logs(s, d)),
        "executor_starts": lambda s, d: M.parse_executor_starts(_logs(s, d)),
        "message_counts": lambda s, d: M.message_counts(_logs(s, d)),
    }


def _host_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Sums of fractional sizes are reported to 3 decimals.
    return T.host_load(_logs(spark, sf_dir)).withColumn("added_bytes", F.round("added_bytes", 3))


def task_queries() -> dict[str, Query]:
    return {
        "tasks": lambda s, d: T.tasks(_logs(s, d)),
        "unfinished_tasks": lambda s, d: T.unfinished_tasks(_logs(s, d)),
        "idle_containers": lambda s, d: T.idle_containers(_logs(s, d)),
        "containers": lambda s, d: T.containers(_logs(s, d)),
        "resource_requests": lambda s, d: T.resource_requests(_logs(s, d)),
        "request_shapes": lambda s, d: T.request_shapes(_logs(s, d)),
        "request_vs_seen": lambda s, d: T.request_vs_seen(_logs(s, d)),
        "task_time_by_app": lambda s, d: T.task_time_by_app(T.tasks(_logs(s, d))),
        "stage_skew": lambda s, d: T.stage_skew(T.tasks(_logs(s, d))),
        "stage_timeline": lambda s, d: T.stage_timeline(T.tasks(_logs(s, d))),
        "host_load": _host_load,
        "memory_profile": lambda s, d: T.memory_profile(_logs(s, d)),
        "cache_ratio": lambda s, d: T.cache_ratio(_logs(s, d)),
        "python_times_by_app": lambda s, d: T.python_times(_logs(s, d)),
        "input_bytes": lambda s, d: T.input_bytes(_logs(s, d)),
    }


def inventory_queries() -> dict[str, Query]:
    return {
        "inventory": lambda s, d: I.inventory(_logs(s, d)),
        "app_file_stats": lambda s, d: I.app_file_stats(_logs(s, d)),
        "top_apps_by_files": lambda s, d: I.top_apps_by_files(_logs(s, d), k=5),
    }


def record_queries() -> dict[str, Query]:
    return {
        "records": lambda s, d: RC.assemble_records(_logs(s, d)),
        "multiline_records": lambda s, d: RC.multiline_records(_logs(s, d)),
    }


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    out.update(record_queries())
    out.update(message_queries())
    out.update(task_queries())
    out.update(inventory_queries())
    out.update(level_queries())
    out.update(usage_queries())
    out.update(daily_queries())
    out.update(chart_queries())
    return out
