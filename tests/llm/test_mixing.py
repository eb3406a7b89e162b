"""Mixing against a plain Python apportionment."""

import math
import random
from collections import defaultdict

import pytest

from logtide.llm import mixing


def water_fill(sizes, weights, share, cap):
    total, rate, full = sum(sizes.values()), 0.0, None
    while True:
        capped = {s for s in sizes if cap * sizes[s] <= rate * weights[s]}
        free = sum(weights[s] for s in sizes if s not in capped)
        if capped == full or not free:
            return {s: min(cap * sizes[s], rate * weights[s]) for s in sizes}
        full = capped
        rate = (share * total - sum(cap * sizes[s] for s in capped)) / free


def sainte_lague(weights, seats):
    got = dict.fromkeys(weights, 0)
    for _ in range(seats):
        best = min((k for k in weights if weights[k] > 0), key=lambda k: (-weights[k] / (2 * got[k] + 1), k))
        got[best] += 1
    return got


def random_docs(spark, n=900, seed=4):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        s = "hot" if rnd.random() < 0.4 else rnd.choice(["a", "é", "Z", "z", "😀", None, "b", "c"])
        rows.append((i, " ".join(["w"] * rnd.choice([0, 1, 30, 200])), s))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.mark.parametrize("shard_docs", [7, 512])
def test_mix_matches_brute_force(spark, shard_docs):
    rows, docs = random_docs(spark)
    got = mixing.mix(mixing.sized(docs), shard_docs=shard_docs, block_words=8).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    targets = water_fill(sizes, weights, 1.5, 2.0)
    assert len(got) == len(rows) and abs(sum(targets.values()) - 1.5 * sum(sizes.values())) < 1e-6 * sum(sizes.values())
    taken, shards = defaultdict(int), defaultdict(set)
    for r in got:
        assert r.size == len(rows[r.doc_id][1].split()) and r.source_size == sizes[r.source]
        assert abs(r.target - targets[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    n_shards = {s: math.ceil(sum(x[2] == s for x in rows) / shard_docs) for s in sizes}
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 8 * (1.5 + n_shards[s]), s


@pytest.mark.parametrize("seed", range(4))
def test_apportion_matches_highest_quotients(spark, seed):
    rnd = random.Random(seed)
    groups = {g: {k: rnd.choice([0, 1, 5, 5, rnd.randrange(1, 400)]) for k in range(rnd.randrange(1, 30))} for g in range(4)}
    groups[9] = {0: 0, 1: 0}
    seats = {g: rnd.randrange(0, 90) for g in groups}
    rows = [(g, k, float(w), seats[g]) for g, m in groups.items() for k, w in m.items()]
    t = spark.createDataFrame(rows, "g long, k long, w double, seats long")
    got = {(r.g, r.k): r.quota for r in mixing.apportion(t, "g", "k", "w", "seats").collect()}
    for g, m in groups.items():
        want = sainte_lague(m, seats[g]) if any(m.values()) else dict.fromkeys(m, 0)
        assert {k: got[g, k] for k in m} == want, g


def test_same_mix_in_any_partitioning(spark):
    _, docs = random_docs(spark, 300)
    a, b = (mixing.mix(mixing.sized(d), shard_docs=20).select("doc_id", "taken") for d in (docs.repartition(1), docs.repartition(9)))
    assert a.exceptAll(b).isEmpty()


def test_odd_rows(odd_docs, no_docs):
    got = mixing.mix(mixing.sized(odd_docs)).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.taken <= 2 * r.size for r in got)
    assert {r.size for r in got if r.doc_id in (3, 4, 5)} == {0}
    assert mixing.mix(mixing.sized(no_docs)).collect() == []
    out = mixing.mixed_documents(odd_docs)
    assert out.columns == odd_docs.columns
    rows = out.collect()
    assert sum(len(r.text.split()) for r in rows) == sum(r.taken for r in got)
    assert all(r.size == -1 and r.taken == -2 and r.n_chars == len(r.text) for r in rows)
    assert mixing.mixed_documents(no_docs).collect() == []
