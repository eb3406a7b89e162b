"""Writing results: small single-file CSV / text outputs and large directories.

Small results (level counts, a sample, a timeline of applications, reports)
are written as one file with a chosen name: ``coalesce(1)`` then a rename
through the Hadoop file system of the target path, so it works the same on
a local disk, HDFS or an object store. Large results stay directories of
part files (``write_table``); never coalesce those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logtide.sources.tables import CSV_OPTIONS


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def _single_file(df: DataFrame, path: str, fmt: str, options: dict) -> str:
    spark = df.sparkSession
    tmp = path + "._parts"
    df.coalesce(1).write.mode("overwrite").options(**options).format(fmt).save(tmp)
    fs, target, jvm = _fs(spark, path)
    tmp_path = jvm.org.apache.hadoop.fs.Path(tmp)
    parts = [s.getPath() for s in fs.listStatus(tmp_path) if s.getPath().getName().startswith("part-")]
    if len(parts) != 1:
        raise RuntimeError(f"expected one part file in {tmp}, found {len(parts)}")
    # The old result is moved aside first, so a failed rename loses nothing.
    old = jvm.org.apache.hadoop.fs.Path(path + "._old")
    had = fs.exists(target)
    if had:
        if fs.exists(old):
            fs.delete(old, False)
        if not fs.rename(target, old):
            raise RuntimeError(f"could not move the old {path} aside")
    if not fs.rename(parts[0], target):
        if had:
            fs.rename(old, target)
        raise RuntimeError(f"could not move {parts[0]} to {path}")
    if had:
        fs.delete(old, False)
    fs.delete(tmp_path, True)
    return path


def write_small_csv(df: DataFrame, path: str, order_by=None) -> str:
    """One CSV file at ``path`` with a header; quotes inside fields are doubled.

    For small results only: everything passes through one task.
    """
    if order_by:
        df = df.orderBy(*order_by) if isinstance(order_by, (list, tuple)) else df.orderBy(order_by)
    return _single_file(df, path, "csv", CSV_OPTIONS)


def write_text(lines: DataFrame, path: str) -> str:
    """A report (``line_no, line``) as one text file, lines in ``line_no`` order."""
    return _single_file(lines.orderBy("line_no").select("line"), path, "text", {})


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None, mode: str = "overwrite") -> str:
    """A large result as a directory of part files (optionally partitioned)."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.options(**CSV_OPTIONS)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.save(path)
    return path
