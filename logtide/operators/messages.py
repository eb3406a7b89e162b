"""Typed tables of log messages: ``parse_<name>(logs) -> DataFrame``.

Each keeps ``application_id, container_id, ts`` of its line and adds the
fields of its message (see ``logtide.functions.messages``). These are
narrow projections and filters of one scan: no shuffle.

``all_messages`` gives the rows of all of them from one pass over the lines,
with the fields of every message side by side; written once by
``write_message_tables`` (a folder for each message), each table is read from its own
folder and columns.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.functions import parse as P
from logtide.functions.messages import MESSAGES


#: The table of each message, by its formats; a cache lookup has two.
TABLES = {
    "executor_requests": ("executor_request",), "container_requests": ("container_request",), "executor_starts": ("executor_start",),
    "task_events": ("task_event",), "task_assigned": ("task_assigned",), "input_splits": ("input_split",), "python_times": ("python_times",),
    "memory_capacity": ("memory_capacity",), "block_stored": ("block_stored",), "block_added": ("block_added",),
    "cache_lookups": ("cache_hit", "cache_miss"), "broadcast_reads": ("broadcast_read",),
}
KEYS = ["application_id", "container_id", "ts"]
_TYPES = {"text": "string", "long": "bigint", "bytes": "double"}


def _fields(table: str) -> dict[str, str]:
    found = {name: _TYPES[kind] for name, kind, _ in MESSAGES[TABLES[table][0]].fields}
    return found | ({"hit": "boolean"} if table == "cache_lookups" else {})


def all_messages(logs: DataFrame) -> DataFrame:
    """``message`` (its table), ``application_id, container_id, ts`` and the fields of all messages, null where a message has none.

    A line is looked at once: the literal markers first, and the regex of a
    message only where its marker is. A line that holds several messages gives a row for each.
    """
    wide: dict[str, str] = {}
    for table in TABLES:
        wide |= _fields(table)

    def rows(table: str, name: str) -> Column:
        msg = MESSAGES[name]

        def row(parts: Column) -> Column:
            own = {n: msg.field(parts, n) for n, _, _ in msg.fields}
            if table == "cache_lookups":
                own["hit"] = F.lit(name == "cache_hit")
            return F.struct(F.lit(table).alias("message"), *[own.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in wide.items()])

        return F.transform(msg.found(F.col("value")), row)

    def found(table: str) -> Column:
        lists = [rows(table, name) for name in TABLES[table]]
        some = F.slice(F.concat(*lists), 1, 1) if len(lists) > 1 else lists[0]
        marked = [F.col("value").contains(MESSAGES[name].marker) for name in TABLES[table]]
        return F.when(reduce(or_, marked), some)

    markers = dict.fromkeys(MESSAGES[name].marker for names in TABLES.values() for name in names)
    lines = logs.filter(reduce(or_, [F.col("value").contains(m) for m in markers]))
    every = F.flatten(F.filter(F.array(*map(found, TABLES)), lambda x: x.isNotNull()))
    out = lines.select("value", "file_path", F.explode(every).alias("_m"))
    ids = (P.application_id("file_path").alias("application_id"), P.container_id("file_path").alias("container_id"))
    return out.select(*ids, P.line_ts("value").alias("ts"), "_m.*")


def message_table(messages: DataFrame, table: str) -> DataFrame:
    """One table of ``all_messages`` with its own columns, as its ``parse_`` function gives it."""
    return messages.filter(F.col("message") == table).select(*KEYS, *_fields(table))


def write_message_tables(logs: DataFrame, path: str) -> None:
    """All message tables from one scan, as Parquet below ``path``, a folder for each message."""
    all_messages(logs).write.partitionBy("message").parquet(path)


def read_message_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table that ``write_message_tables`` wrote; only its folder and columns are read."""
    return message_table(spark.read.parquet(path), table)


def message_counts(logs: DataFrame) -> DataFrame:
    """``message, lines, stamped, first_ts, last_ts`` of each message that occurs."""
    rows = all_messages(logs).select("message", "ts")
    return rows.groupBy("message").agg(F.count(F.lit(1)).alias("lines"), F.count("ts").alias("stamped"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def parse_message(logs: DataFrame, name: str) -> DataFrame:
    """Lines of message ``name`` with its typed fields; the message's regex runs once on each line with its marker."""
    msg = MESSAGES[name]
    found = logs.filter(F.col("value").contains(msg.marker)).withColumn("_parts", F.explode(msg.found(F.col("value"))))
    return found.select(
        P.application_id("file_path").alias("application_id"),
        P.container_id("file_path").alias("container_id"),
        P.line_ts("value").alias("ts"),
        *msg.columns(F.col("_parts")),
    )


def parse_executor_requests(logs: DataFrame) -> DataFrame:
    return parse_message(logs, "executor_request")


def parse_container_requests(logs: DataFrame) -> DataFrame:
    return parse_message(logs, "container_request")


def parse_task_events(logs: DataFrame) -> DataFrame:
    """Running / Finished task lines; Finished lines also carry ``result_bytes``."""
    return parse_message(logs, "task_event")


def parse_executor_starts(logs: DataFrame) -> DataFrame:
    """The host each executor container started on: ``executor, host``."""
    return parse_message(logs, "executor_start")


def parse_task_assigned(logs: DataFrame) -> DataFrame:
    return parse_message(logs, "task_assigned")


def parse_input_splits(logs: DataFrame) -> DataFrame:
    return parse_message(logs, "input_split")


def parse_python_times(logs: DataFrame) -> DataFrame:
    return parse_message(logs, "python_times")


def parse_memory_capacity(logs: DataFrame) -> DataFrame:
    return parse_message(logs, "memory_capacity")


def parse_block_stored(logs: DataFrame) -> DataFrame:
    return parse_message(logs, "block_stored")


def parse_block_added(logs: DataFrame) -> DataFrame:
    return parse_message(logs, "block_added")


def parse_cache_lookups(logs: DataFrame) -> DataFrame:
    """Cache lookups of RDD blocks: ``block, hit`` (true = found locally)."""
    hit, miss = MESSAGES["cache_hit"], MESSAGES["cache_miss"]
    v = F.col("value")
    both = F.concat(
        F.transform(hit.found(v), lambda p: F.struct(hit.field(p, "block").alias("block"), F.lit(True).alias("hit"))),
        F.transform(miss.found(v), lambda p: F.struct(miss.field(p, "block").alias("block"), F.lit(False).alias("hit"))),
    )
    rows = logs.filter(v.contains(hit.marker) | v.contains(miss.marker)).withColumn("_l", F.explode(F.slice(both, 1, 1)))
    return rows.select(
        P.application_id("file_path").alias("application_id"),
        P.container_id("file_path").alias("container_id"),
        P.line_ts(v).alias("ts"),
        F.col("_l.block").alias("block"),
        F.col("_l.hit").alias("hit"),
    )


def parse_broadcast_reads(logs: DataFrame) -> DataFrame:
    return parse_message(logs, "broadcast_read")
