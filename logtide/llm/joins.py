"""Joins of texts with keys of some of them, with few texts shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 1 << 22


def slot(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def near_keys(rows: DataFrame, column: str, keys: DataFrame, key: str, slots: int = SLOTS) -> DataFrame:
    """``rows`` without most of those whose ``column`` is no ``key`` of ``keys``: what is left goes to the exact join.

    Keys fall into ``slots`` slots; the taken slots, at most that many numbers
    whatever the table, are broadcast. With many more keys than slots all rows
    pass, and the exact join has them all to do.
    """
    taken = keys.select(slot(F.col(key), slots).alias("_slot")).distinct()
    return rows.withColumn("_own", slot(F.col(column), slots)).join(F.broadcast(taken), F.col("_own") == F.col("_slot"), "left_semi").drop("_own")
