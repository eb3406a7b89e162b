"""Shared tables and positions in a total order."""

import os
import random

import pytest
from pyspark.sql import functions as F

from logtide.llm import order, store


def test_tables_go_to_the_folder_of_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert store.shared_dir(spark) == named.rstrip("/")
    t = store.cut(spark.range(5), "t")
    path = t._llm_path
    assert path.startswith(named.rstrip("/") + "/llm-t-") and t.count() == 5
    store.drop(t, spark.range(3))
    assert not os.path.exists(path.removeprefix("file:"))
    assert store.new_path(spark, "x") != store.new_path(spark, "x")


@pytest.mark.parametrize("parts", [1, 6])
def test_dense_ids(spark, parts):
    rnd = random.Random(parts)
    rows = [(rnd.choice([None, 1, 1, 1, rnd.randrange(90)]), rnd.random()) for _ in range(400)]
    t = spark.createDataFrame(rows, "a long, b double").repartition(parts)
    got = order.dense_ids(t, [F.col("a").asc_nulls_last(), F.col("b")], "no").orderBy("no").collect()
    assert [r.no for r in got] == list(range(400))
    assert [(r.a, r.b) for r in got] == sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert order.dense_ids(t.limit(0), [F.col("a")], "no").collect() == []
    ids = [r.no for r in order.ordered_ids(t, [F.col("b")], "no").orderBy("b").collect()]
    assert ids == sorted(set(ids))
