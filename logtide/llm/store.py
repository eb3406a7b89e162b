"""Intermediate tables in the folder that driver and executors share.

Every long job cuts its lineage by writing a Parquet table below
``spark.checkpoint.dir`` and reading it again: a lost executor then costs the
tasks it was running, not the whole history.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``.

    Where a local session names none (tests, a notebook), a temporary folder
    of this machine is set; a cluster session without one is an error, since
    its executors would not see such a folder.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="logtide-llm-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read from there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._llm_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` that no later step reads."""
    for t in tables:
        path = getattr(t, "_llm_path", None)
        if path:
            jvm, spark = t.sparkSession._jvm, t.sparkSession
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once a session, unless the driver's PYTHONPATH names its folder."""
    package = Path(__file__).resolve().parent.parent
    context = spark.sparkContext
    if str(package.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_llm_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="logtide-package-")) / "logtide.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(path))
    context._llm_shipped = True
