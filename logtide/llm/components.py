"""Connected components of an edge table, by alternating large and small stars.

Each turn hooks the neighbours of every node to its smallest one; the edges
shrink to stars around the smallest node of each component in a few turns. A
hub is only the key of a join and of a partial minimum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.llm.store import cut, drop


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.shiftright(F.xxhash64("v", "u"), 20))).first())


def _turn(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("_m")).withColumn("_m", F.least("u", "_m"))
    large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("_m").alias("v"))
    large = cut(large.distinct(), "large")
    least = large.groupBy("u").agg(F.min("v").alias("_m"))
    pairs = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("_m").alias("v")), F.struct(F.col("v").alias("u"), F.col("_m").alias("v")))).alias("e"))
    out = cut(pairs.select("e.u", "e.v").filter("u > v").distinct(), "small")
    drop(large)
    return out


def stars(edges: DataFrame) -> DataFrame:
    """``u``, ``v``: each node but the smallest of a component, and that smallest one. ``edges`` has longs u, v; loops and repeats are ignored."""
    e = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "edges")
    mark = _mark(e)
    while mark[0]:
        nxt = _turn(e)
        drop(e)
        new = _mark(nxt)
        e = nxt
        if new == mark:
            break
        mark = new
    return e
