"""Formats of common Spark-on-YARN log messages as column expressions.

Each message has a literal ``marker`` (a cheap ``contains`` test that runs
before any regex, so the regex only sees candidate lines), a Java regex and
the typed fields taken from its groups.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from logtide.functions.parse import size_bytes

# ---------------------------------------------------------------------------
# The message formats. ``(unit)`` stands for (B|KB|MB|GB|TB).
# ---------------------------------------------------------------------------
UNIT = r"(B|KB|MB|GB|TB)"
EXECUTOR_REQUEST = (
    r"Will request (\d+) executor containers?, each with (\d+) cores? "
    r"and (\d+) MB memory including (\d+) MB overhead"
)
CONTAINER_REQUEST = r"capability: <memory:(\d+), vCores:(\d+)>"
TASK_EVENT = (
    r"(Running|Finished) task (\d+)\.(\d+) in stage (\d+)\.(\d+) \(TID (\d+)\)"
    r"(?:\. (\d+) bytes result sent to driver)?"
)
EXECUTOR_START = r"Starting executor ID (\d+) on host (\S+)"
TASK_ASSIGNED = r"Got assigned task (\d+)"
INPUT_SPLIT = r"Input split: (\S+):(\d+)\+(\d+)$"
PYTHON_TIMES = r"Times: total = (-?\d+), boot = (-?\d+), init = (-?\d+), finish = (-?\d+)"
MEMORY_CAPACITY = r"MemoryStore started with capacity ([\d.]+) " + UNIT
BLOCK_STORED = (
    r"Block (\S+) stored as (values|bytes) in memory \(estimated size ([\d.]+) " + UNIT
    + r", free ([\d.]+) " + UNIT + r"\)"
)
BLOCK_ADDED = (
    r"Added (\S+) in memory on ([^:\s]+):(\d+) \(size: ([\d.]+) " + UNIT
    + r", free: ([\d.]+) " + UNIT + r"\)"
)
CACHE_HIT = r"Found block (rdd_\d+_\d+) locally"
CACHE_MISS = r"Partition (rdd_\d+_\d+) not found, computing it"
BROADCAST_READ = r"Started reading broadcast variable (\d+)"


SEPARATOR = "\u0001"


@dataclass(frozen=True)
class Message:
    """One log message format: literal marker, regex, output columns."""

    marker: str
    pattern: str
    fields: tuple  # of (name, kind, group index); kind in text, long, bytes

    def matches(self, value: Column) -> Column:
        return value.contains(self.marker) & value.rlike(self.pattern)

    def found(self, value: Column) -> Column:
        """Array with one element where ``value`` holds the message, else empty; the element is the array of its groups.

        One regex a line: it rewrites the line to its groups, which are then
        split. A group that takes no part is "".
        """
        n = max(idx + (kind == "bytes") for _, kind, idx in self.fields)
        groups = "".join(f"{SEPARATOR}${i}" for i in range(1, n + 1))
        line = F.when(value.contains(self.marker), F.translate(value, SEPARATOR, " "))
        parts = F.split(F.regexp_replace(line, f"(?s)^.*?{self.pattern}.*$", groups), SEPARATOR)
        return F.filter(F.array(parts), lambda p: (F.size(p) == n + 1) & (p[0] == ""))

    def field(self, parts: Column, name: str) -> Column:
        """The typed value of one field from the groups (null where there are none)."""
        for fname, kind, idx in self.fields:
            if fname == name:
                if kind == "text":
                    return parts[idx]
                if kind == "long":
                    return F.nullif(parts[idx], F.lit("")).try_cast("bigint")
                if kind == "bytes":
                    return size_bytes(parts[idx], parts[idx + 1])
                raise ValueError(kind)
        raise KeyError(name)

    def columns(self, parts: Column) -> list[Column]:
        return [self.field(parts, name).alias(name) for name, _, _ in self.fields]


MESSAGES = {
    "executor_request": Message(
        "Will request",
        EXECUTOR_REQUEST,
        (("executors", "long", 1), ("cores", "long", 2), ("memory_mb", "long", 3), ("overhead_mb", "long", 4)),
    ),
    "container_request": Message(
        "capability: <memory:", CONTAINER_REQUEST, (("memory_mb", "long", 1), ("vcores", "long", 2))
    ),
    "task_event": Message(
        " task ",
        TASK_EVENT,
        (
            ("event", "text", 1),
            ("task", "long", 2),
            ("attempt", "long", 3),
            ("stage", "long", 4),
            ("stage_attempt", "long", 5),
            ("tid", "long", 6),
            ("result_bytes", "long", 7),
        ),
    ),
    "executor_start": Message("Starting executor ID", EXECUTOR_START, (("executor", "long", 1), ("host", "text", 2))),
    "task_assigned": Message("Got assigned task", TASK_ASSIGNED, (("tid", "long", 1),)),
    "input_split": Message(
        "Input split: ", INPUT_SPLIT, (("input_file", "text", 1), ("offset", "long", 2), ("length", "long", 3))
    ),
    "python_times": Message(
        "Times: total = ",
        PYTHON_TIMES,
        (("total_ms", "long", 1), ("boot_ms", "long", 2), ("init_ms", "long", 3), ("finish_ms", "long", 4)),
    ),
    "memory_capacity": Message(
        "MemoryStore started with capacity", MEMORY_CAPACITY, (("capacity_bytes", "bytes", 1),)
    ),
    "block_stored": Message(
        " stored as ",
        BLOCK_STORED,
        (("block", "text", 1), ("stored_as", "text", 2), ("size_bytes", "bytes", 3), ("free_bytes", "bytes", 5)),
    ),
    "block_added": Message(
        " in memory on ",
        BLOCK_ADDED,
        (
            ("block", "text", 1),
            ("host", "text", 2),
            ("port", "long", 3),
            ("size_bytes", "bytes", 4),
            ("free_bytes", "bytes", 6),
        ),
    ),
    "cache_hit": Message("Found block rdd_", CACHE_HIT, (("block", "text", 1),)),
    "cache_miss": Message("not found, computing it", CACHE_MISS, (("block", "text", 1),)),
    "broadcast_read": Message(
        "Started reading broadcast variable", BROADCAST_READ, (("broadcast_id", "long", 1),)
    ),
}
