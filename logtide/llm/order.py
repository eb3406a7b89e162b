"""Positions in a total order over a whole table, without one task holding it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtide.llm.store import cut

_ROW_BITS = (1 << 33) - 1  # monotonically_increasing_id keeps the row of a partition in the low 33 bits


def ordered_ids(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` plus ``name``: a long that grows along ``order`` (with gaps).

    A range-partitioned sort, then the partition number and the row in it. The
    table is written before anyone reads the ids, so a task that is run again
    reads the same ones.
    """
    return cut(df.orderBy(*order).withColumn(name, F.monotonically_increasing_id()), "ordered")


def dense_ids(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` plus ``name``: 0, 1, 2, ... along ``order``.

    The broadcast table has one row for each sort partition.
    """
    t = ordered_ids(df, order, "_order_id")
    part = F.shiftrightunsigned("_order_id", 33)
    sizes = t.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    return (
        t.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.col("_order_id").bitwiseAND(F.lit(_ROW_BITS)))
        .drop("_part", "_start", "_order_id")
    )
