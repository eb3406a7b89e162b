"""Ranges of rows of like size along an order, and places in an order, without one task holding all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtide.operators.quantiles import with_place

RANGES = 1024
SAMPLE = 16  # rows drawn for each range


def with_range(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` plus ``name``: the number (from 0, ascending) of the row's range along ``order``, whose values tell all rows apart.

    A sample of a fixed size, the rows of smallest hash, is the same however often and
    wherever it is drawn. Every ``SAMPLE``-th of it in order cuts the rows into
    up to ``RANGES`` ranges of like size, however many rows share a
    first value, a beginning of a text or an hour.
    """
    at = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    drawn = df.select(at.alias("_o")).orderBy(F.xxhash64("_o"), "_o").limit(SAMPLE * RANGES - 1)
    cuts = drawn.agg(F.filter(F.sort_array(F.collect_list("_o")), lambda _, i: (i + 1) % SAMPLE == 0).alias("cuts"))
    return with_place(df.withColumn("_cuts", cuts.scalar()), F.col("_cuts"), at, RANGES, name).drop("_cuts")


def place_by_count(df: DataFrame, count: str, key: str, name: str) -> DataFrame:
    """``df`` plus ``name``: 1, 2, ... by ``count`` descending, then the text ``key`` ascending (unique, not null).

    Rows are ranked inside their range, after the numbers of rows in the ranges before.
    """
    ranged = with_range(df, [-F.col(count), F.col(key)], "_range")
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col("_range").alias("_r"), F.coalesce(before, F.lit(0)).alias("_start"))
    local = F.row_number().over(Window.partitionBy("_range").orderBy(F.desc(count), key))
    out = ranged.withColumn("_local", local).join(starts, F.col("_range") == F.col("_r"))
    return out.select(*df.columns, (F.col("_start") + F.col("_local")).cast("int").alias(name))
