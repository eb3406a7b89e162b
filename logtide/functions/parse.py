"""Column expressions for Spark-on-YARN log lines and log paths.

Every function maps Columns to a Column, so the work stays in whole-stage
code generation. All of them are ANSI-safe: a piece that is missing becomes
the empty string (for text) or null (for numbers and timestamps), never an
error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These define the log format and the report order; they must
# stay exactly as written.
# ---------------------------------------------------------------------------
LEVELS = ("INFO", "WARN", "ERROR", "DEBUG")
LEVEL_PATTERN = r"(INFO|WARN|ERROR|DEBUG)"
LEVEL_WORD_PATTERN = r"\b(INFO|WARN|ERROR|DEBUG)\b"
TS_PATTERN = r"^(\d{2}/\d{2}/\d{2} \d{2}:\d{2}:\d{2})"
TS_FORMAT = "yy/MM/dd HH:mm:ss"
APPLICATION_PATTERN = r"(application_\d+_\d+)"
CLUSTER_PATTERN = r"application_(\d+)_\d+"
APP_NUMBER_PATTERN = r"application_\d+_(\d+)"
APP_NUMBER_WIDTH = 4
COMPONENT_PATTERN = r"(INFO|WARN|ERROR|DEBUG)\s+([^:]+):"
CONTAINER_PATTERN = r"(container_(\d+)_(\d+)_(\d+)_(\d+))"
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB")  # powers of 1024, in this order


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def log_level(value: Column | str, mode: str = "substring") -> Column:
    """Leftmost level word in the line, case-sensitive; "" when there is none.

    ``mode="substring"`` also matches inside words (``INFORMATION`` gives
    ``INFO``); ``mode="word"`` needs word boundaries on both sides.
    """
    if mode == "substring":
        pattern = LEVEL_PATTERN
    elif mode == "word":
        pattern = LEVEL_WORD_PATTERN
    else:
        raise ValueError(f"mode must be 'substring' or 'word', not {mode!r}")
    return F.regexp_extract(_c(value), pattern, 1)


def ts_text(value: Column | str) -> Column:
    """The ``yy/MM/dd HH:mm:ss`` prefix of a line, or "" when the shape is absent."""
    return F.regexp_extract(_c(value), TS_PATTERN, 1)


def parse_ts(text: Column | str) -> Column:
    """``yy/MM/dd HH:mm:ss`` text to TIMESTAMP_NTZ (years 2000-2099).

    Well-shaped but impossible values (month 13, 30 February, hour 24) give
    null. No session time zone takes part, so daylight-saving gaps do not
    move any value.
    """
    return F.concat(F.lit("20"), F.translate(_c(text), "/", "-")).try_cast("timestamp_ntz")


def line_ts(value: Column | str) -> Column:
    """Timestamp at the start of a log line, or null."""
    return parse_ts(ts_text(value))


def application_id(path: Column | str) -> Column:
    """First ``application_<cluster>_<number>`` in a path, or ""."""
    return F.regexp_extract(_c(path), APPLICATION_PATTERN, 1)


def cluster_id(app: Column | str) -> Column:
    """Cluster id (the ResourceManager start time in ms) of an application id."""
    return F.regexp_extract(_c(app), CLUSTER_PATTERN, 1)


def app_number(app: Column | str) -> Column:
    """Application number, zero padded to 4 digits; longer numbers stay whole.

    Kept as text so that ``0039`` survives. ``lpad`` alone would cut a five
    digit number to four, so it only pads.
    """
    raw = F.regexp_extract(_c(app), APP_NUMBER_PATTERN, 1)
    return F.when(F.length(raw) >= APP_NUMBER_WIDTH, raw).when(raw == "", raw).otherwise(
        F.lpad(raw, APP_NUMBER_WIDTH, "0")
    )


def component(value: Column | str) -> Column:
    """Logger name that follows the level, e.g. ``executor.Executor``; or ""."""
    return F.regexp_extract(_c(value), COMPONENT_PATTERN, 2)


def container_id(path: Column | str) -> Column:
    """First ``container_<cluster>_<app>_<attempt>_<number>`` in a path, or ""."""
    return F.regexp_extract(_c(path), CONTAINER_PATTERN, 1)


def container_attempt(path: Column | str) -> Column:
    """Application attempt of the container as int, or null."""
    return F.nullif(F.regexp_extract(_c(path), CONTAINER_PATTERN, 4), F.lit("")).try_cast("int")


def container_number(path: Column | str) -> Column:
    """Container number as int (1 is the ApplicationMaster), or null."""
    return F.nullif(F.regexp_extract(_c(path), CONTAINER_PATTERN, 5), F.lit("")).try_cast("int")


def container_role(path: Column | str) -> Column:
    """``master`` for container 1, ``executor`` for any other, null without a container."""
    n = container_number(path)
    return F.when(n == 1, F.lit("master")).when(n.isNotNull(), F.lit("executor"))


def cluster_start(cluster: Column | str) -> Column:
    """Start time of a cluster (its id is epoch milliseconds), UTC, as TIMESTAMP_NTZ."""
    ms = F.nullif(_c(cluster), F.lit("")).try_cast("bigint")
    return F.timestamp_add("MILLISECOND", ms, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def size_bytes(number: Column | str, unit: Column | str) -> Column:
    """``12.0`` and ``KB`` to 12288.0 bytes; null for an unknown unit or number."""
    num = F.nullif(_c(number), F.lit("")).try_cast("double")
    u = _c(unit)
    factor = F.when(u == "B", F.lit(1.0))
    for power, name in enumerate(SIZE_UNITS[1:], start=1):
        factor = factor.when(u == name, F.lit(float(1024**power)))
    return num * factor


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Seconds from ``start`` to ``end`` as double (negative if ``end`` is earlier).

    Computed from the interval ``end - start``, which for TIMESTAMP_NTZ
    involves no time zone: a value inside a daylight-saving gap of the
    session zone is not moved (``timestamp_diff`` would move it).
    """
    interval = (_c(end) - _c(start)).cast("interval second")
    return interval.cast("decimal(18,6)").cast("double")


def elapsed_seconds(start: Column | str, end: Column | str) -> Column:
    """Seconds from ``start`` to ``end`` as double, clipped below at 0."""
    return F.greatest(seconds_between(start, end), F.lit(0.0))


def parse_line(value: Column | str = "value", mode: str = "substring") -> list[Column]:
    """The three parsed fields of the level analysis as named columns."""
    v = _c(value)
    return [
        log_level(v, mode).alias("log_level"),
        ts_text(v).alias("timestamp"),
        v.alias("log_entry"),
    ]


def path_ids(path: Column | str = "file_path") -> list[Column]:
    """Application, cluster and application number columns of a path."""
    app = application_id(path)
    return [
        app.alias("application_id"),
        cluster_id(app).alias("cluster_id"),
        app_number(app).alias("app_number"),
    ]
