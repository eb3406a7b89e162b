"""Inventory of a log tree: entries, files, containers, applications.

All counts first reduce lines to one row per file (a map-side partial
aggregate), then work on files: the id regexes run once per file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.functions import parse as P


def file_stats(logs: DataFrame) -> DataFrame:
    """``file_path, lines, bytes`` per file.

    ``bytes`` is the file size when the input carries ``file_size`` (as
    ``read_logs(with_size=True)`` gives), else the UTF-8 length of its lines
    plus one newline each.
    """
    if "file_size" in logs.columns:
        size = F.max("file_size")
    else:
        size = F.sum(F.octet_length("value") + 1)
    return logs.groupBy("file_path").agg(F.count(F.lit(1)).alias("lines"), size.cast("bigint").alias("bytes"))


def app_file_stats(logs: DataFrame) -> DataFrame:
    """Per application: ``files, lines, bytes``."""
    f = file_stats(logs).select(P.application_id("file_path").alias("application_id"), "lines", "bytes")
    return (
        f.filter(F.col("application_id") != "")
        .groupBy("application_id")
        .agg(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes"))
    )


def top_apps_by_files(logs: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` applications with most files (a top-k report); ties by id."""
    return app_file_stats(logs).orderBy(F.desc("files"), "application_id").limit(k)


def inventory(logs: DataFrame) -> DataFrame:
    """One row: ``entries, files, containers, applications``."""
    f = file_stats(logs).select(
        "lines",
        P.application_id("file_path").alias("app"),
        P.container_id("file_path").alias("container"),
    )
    return f.agg(
        F.coalesce(F.sum("lines"), F.lit(0)).cast("bigint").alias("entries"),
        F.count(F.lit(1)).alias("files"),
        F.count_distinct(F.nullif("container", F.lit(""))).alias("containers"),
        F.count_distinct(F.nullif("app", F.lit(""))).alias("applications"),
    )
