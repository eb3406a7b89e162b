"""Parquet tables, saved results and input resolution."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIMELINE_SCHEMA = T.StructType(
    [
        T.StructField("cluster_id", T.StringType()),
        T.StructField("application_id", T.StringType()),
        T.StructField("app_number", T.StringType()),
        T.StructField("start_time", T.TimestampNTZType()),
        T.StructField("end_time", T.TimestampNTZType()),
        T.StructField("duration_seconds", T.DoubleType()),
    ]
)
CLUSTER_SUMMARY_SCHEMA = T.StructType(
    [
        T.StructField("cluster_id", T.StringType()),
        T.StructField("num_applications", T.LongType()),
        T.StructField("cluster_first_app", T.TimestampNTZType()),
        T.StructField("cluster_last_app", T.TimestampNTZType()),
    ]
)
DAILY_SCHEMA = T.StructType(
    [
        T.StructField("dt_year", T.IntegerType()),
        T.StructField("dt_month", T.IntegerType()),
        T.StructField("dt_day", T.IntegerType()),
        T.StructField("num_trips", T.LongType()),
        T.StructField("mean_trip_distance", T.DoubleType()),
        T.StructField("max_mta_tax", T.DoubleType()),
        T.StructField("q95_fare_amount", T.DoubleType()),
        T.StructField("min_tip_amount", T.DoubleType()),
        T.StructField("mean_passenger_count", T.LongType()),
    ]
)
CSV_OPTIONS = {"header": "true", "escape": '"', "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss"}


def read_tables(spark: SparkSession, *paths: str, **options: str) -> DataFrame:
    """Several Parquet files, directories or globs as one table.

    Reader options that Parquet does not know (such as ``header``) are
    ignored by Spark, not rejected.
    """
    return spark.read.options(**options).parquet(*paths)


def month_paths(
    base: str, year: int, months, prefix: str = "yellow_tripdata", partition: str = "yyyy"
) -> list[str]:
    """``<base>/<partition>=<year>/<prefix>_<year>-<MM>.parquet`` for each month."""
    return [f"{base.rstrip('/')}/{partition}={year}/{prefix}_{year}-{int(m):02d}.parquet" for m in months]


def read_month_files(
    spark: SparkSession, base: str, year: int, months, prefix: str = "yellow_tripdata", partition: str = "yyyy"
) -> DataFrame | None:
    """The files of the named months (see ``month_paths``), whatever time stamps their rows have; None without months."""
    paths = month_paths(store_path(base), year, months, prefix, partition)
    return read_tables(spark, *paths) if paths else None


def read_months(
    spark: SparkSession, base: str, year: int, months=None, partition: str = "yyyy", ts: str | None = None
) -> DataFrame:
    """A year of a ``<partition>=<year>`` directory tree, optionally only rows of some months.

    Reading the base directory makes ``<partition>`` a partition column, so
    the year filter prunes directories before any file is opened. ``months``
    keeps the rows whose ``ts`` (then required) lies in one of them, by range
    filters that reach the Parquet scan; an empty list gives no rows. For the
    rows of a month's *file* see ``read_month_files``.
    """
    if months is not None and ts is None:
        raise ValueError("months needs ts, the column they are taken from")
    df = spark.read.parquet(store_path(base)).filter(F.col(partition) == year)
    if months is None:
        return df
    dtype = df.schema[ts].dataType.simpleString()
    cond = F.lit(False)
    for m in sorted({int(m) for m in months}):
        hi_y, hi_m = (year + 1, 1) if m == 12 else (year, m + 1)
        lo, hi = (F.lit(f"{y:04d}-{n:02d}-01 00:00:00").cast(dtype) for y, n in ((year, m), (hi_y, hi_m)))
        cond = cond | ((F.col(ts) >= lo) & (F.col(ts) < hi))
    return df.filter(cond)


def read_timeline(spark: SparkSession, path: str) -> DataFrame:
    """A saved application timeline (CSV with header) under its declared schema.

    The schema keeps ids as text, so ``0039`` is not turned into ``39``.
    """
    return spark.read.schema(TIMELINE_SCHEMA).options(**CSV_OPTIONS).csv(path)


def read_daily_summary(spark: SparkSession, path: str) -> DataFrame:
    """A saved daily trip summary (CSV with header) under its declared schema."""
    return spark.read.schema(DAILY_SCHEMA).options(**CSV_OPTIONS).csv(path)


def read_cluster_summary(spark: SparkSession, path: str) -> DataFrame:
    """A saved cluster summary (CSV with header) under its declared schema."""
    return spark.read.schema(CLUSTER_SUMMARY_SCHEMA).options(**CSV_OPTIONS).csv(path)


def store_path(path: str) -> str:
    """``s3://`` as ``s3a://``, the name of Spark's reader for it; other paths unchanged."""
    return "s3a://" + path[len("s3://") :] if path.startswith("s3://") else path


def resolve_input(path: str | None = None, env: dict | None = None, env_var: str = "LOGTIDE_BUCKET",
                  sample: str = "data/sample", raw: str = "data/raw") -> str:
    """Input location: the argument, else ``$<env_var>/data``, else the sample
    directory if it exists, else the raw directory. ``s3://`` becomes ``s3a://``."""
    env = os.environ if env is None else env
    if path:
        out = path.rstrip("/")
    elif env.get(env_var):
        out = f"{env[env_var].rstrip('/')}/data"
    elif os.path.exists(sample):
        out = sample
    else:
        out = raw
    return store_path(out)
