"""Exact search against plain Python integers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from logtide.llm import search

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, scale):
    ok = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if i % 50 == 0}):
        own = min(v for i, v in ok if i == q)
        scores = [(-sum(a * b for a, b in zip(own, v)), i) for i, v in ok if i != q and len(v) == len(own)]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return out


@pytest.mark.parametrize("block_rows", [4096, 3])
def test_matches_brute_force(spark, block_rows, monkeypatch):
    rnd = random.Random(block_rows)
    rows = []
    for i in range(700):
        v = [rnd.choice([0.5, -0.25, rnd.uniform(-1, 1)]) for _ in range(6)]
        rows.append((i, v if i % 3 else [0.5] * 6))  # a third of all vectors is the same: ties
    rows += [(701, None), (702, [None] * 6), (703, [float("nan")] * 6), (704, [float("inf")] + [0.0] * 5), (None, [1.0] * 6),
             (750, [1.0, 1.0]), (751, [1.0, 2.0]), (800, []), (801, []), (850, [0.1] * 3), (100, [0.9] * 6)]
    t = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(5)
    single = [(r.vec_id, r.embedding) for r in t.collect()]  # floats as stored
    got = [tuple(r) for r in search.top_k(t, F.col("vec_id") % 50 == 0, block_rows=block_rows).orderBy("query_id", "rank").collect()]
    assert got == brute(single, 5, 256)


def test_large_components_stay_exact(spark):
    rows = [(0, [3e9, 1.0, 7.0]), (1, [2e8 + 16, 1.0, 0.0]), (2, [2e8, 1.0, 3.0]), (3, [-1e9, 0.0, 0.0])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in search.top_k(t, F.col("vec_id") % 50 == 0, k=2, scale=1).orderBy("rank").collect()]
    assert got == brute(rows, 2, 1) and got[0][3] > 2**53


def test_odd_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    is_query = F.col("vec_id") % 50 == 0
    assert search.top_k(none, is_query).collect() == []
    one = spark.createDataFrame([(50, [1.0], 0)], SCHEMA)
    assert search.top_k(one, is_query).collect() == []
    few = spark.createDataFrame([(50, [1.0], 0), (7, [2.0], 0), (8, [1.0], 0)], SCHEMA)
    assert [tuple(r) for r in search.top_k(few, is_query, scale=1).orderBy("rank").collect()] == [(50, 1, 7, 2), (50, 2, 8, 1)]
