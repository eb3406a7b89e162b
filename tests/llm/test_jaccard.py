"""Jaccard join and components against brute force."""

import itertools
import random
from collections import Counter

import pytest

from logtide.llm import components, jaccard
from test_fingerprints import plain_shingles


def near_docs(rnd, n_groups=25, size=8, hot=90):
    docs = []
    for g in range(n_groups):
        base = [f"g{g}w{rnd.randrange(400)}" for _ in range((120 if g == 0 else rnd.choice([6, 40, 200])))]
        for _ in range(hot if g == 0 else rnd.randrange(1, size)):
            t = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
                t[rnd.randrange(len(t))] = f"x{rnd.randrange(10**6)}"
            docs.append("a common line of some nine words here now\n" * (rnd.random() < 0.3) + " ".join(t))
    rnd.shuffle(docs)
    return docs


def brute(docs):
    """{id: (class, links, copies)} of a dict id -> text, every pair compared."""
    sets = {i: plain_shingles(t) for i, t in docs.items()}
    reps = {}
    for i in sorted(docs):
        if sets[i]:
            reps.setdefault(frozenset(sets[i]), []).append(i)
    parent = {i: i for i in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)

    degree = Counter()
    for (s, a), (t, b) in itertools.combinations(reps.items(), 2):
        shared = len(s & t)
        if 5 * shared >= 4 * (len(s) + len(t) - shared):
            degree[a[0]] += 1
            degree[b[0]] += 1
            join(a[0], b[0])
    for ids in reps.values():
        for i in ids:
            join(ids[0], i)
    own = {i: ids for ids in reps.values() for i in ids}
    return {i: (find(i), degree[own[i][0]] if i in own else 0, len(own.get(i, [i]))) for i in docs}


@pytest.mark.parametrize("seed,leaf,weight", [(1, 4096, 1 << 22), (2, 16, 1 << 22), (3, 16, 700)])
def test_matches_brute_force(spark, seed, leaf, weight, monkeypatch):
    monkeypatch.setattr(jaccard, "LEAF", leaf)  # small leaves: the recursion and the tiles of pairs of blocks are used
    monkeypatch.setattr(jaccard, "WEIGHT", weight)
    monkeypatch.setattr(jaccard, "_ROWS", 16 if seed > 1 else 256)
    rnd = random.Random(seed)
    docs = dict(enumerate(near_docs(rnd)))
    t = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.class_id, r.links, r.copies) for r in jaccard.jaccard_classes(t).collect()}
    want = brute(docs)
    assert sum(x[1] for x in want.values()) > 300
    assert got == want


def test_rows_follow_a_group_of_near_copies(spark):
    """Members of leaves and rows of tiles grow with the group, not with its square."""
    made = []
    for n in (1000, 4000):
        rnd = random.Random(n)
        base = [f"w{rnd.randrange(10**6)}" for _ in range(150)]
        docs = [(i, " ".join(base[:k] + [f"x{i}"] + base[k:])) for i, k in ((i, rnd.randrange(150)) for i in range(n))]
        t = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
        sets = jaccard.described(t).withColumnRenamed("doc_id", "no").cache()
        leaves = jaccard.leaves(sets, 0.8, 0.999)
        made.append((n, leaves.count(), jaccard._tiles(leaves).count()))
    (n, few, tiles), (m, many, more) = made
    assert many <= 1.3 * few * m / n and more <= 1.3 * tiles * m / n


def test_patterned_words_are_not_one_set(spark):
    """Strings that any polynomial modulo 2^64 gives one value."""
    from corpus_pipeline import ngram_jaccard

    rows = []
    for n in (10, 11, 12, 13):
        pair = ["".join("ab"[(bin(i).count("1") + k) % 2] for i in range(1 << n)) for k in (0, 1)]
        rows += [(len(rows) + k, t) for k, t in enumerate(pair + [f"some words before {t} and a few behind" for t in pair])]
    t = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r.class_id == r.doc_id and r.copies == 1 for r in jaccard.jaccard_classes(t).collect())
    assert ngram_jaccard(spark, t, "").count() == len(rows)


def test_runs_reach_the_recall():
    assert jaccard.runs_for(0.999, 1) == 7 and jaccard.runs_for(0.999, 3) == 15
    assert jaccard.least_matches(0.8) == 37


def test_odd_rows(spark, odd_docs, no_docs):
    rows = jaccard.jaccard_classes(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.class_id, r.links, r.copies))
    assert by[1] == [(1, 0, 3)] and by[2] == [(1, 0, 3)] * 2 and by[None] == [(None, 0, 1)] * 2
    assert by[3] == [(3, 0, 1)] and by[4] == [(4, 0, 1)] and by[5] == [(5, 0, 1)] and by[8] == [(8, 0, 1)]
    assert by[6] == [(6, 1, 1)] and by[7] == [(6, 1, 1)] and by[9] == [(9, 0, 1)] * 2
    assert jaccard.jaccard_classes(no_docs).collect() == []
    named = odd_docs.withColumnsRenamed({"size": "a.b", "taken": "tick`", "links": "KEY"})
    kept = jaccard.keep_one_text(named)
    assert kept.columns == named.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 3, 4, 5, 6, 8, 9, 9, 10, 11, None, None]))
    assert jaccard.keep_one_text(no_docs).collect() == []


def test_texts_that_share_an_id_stay(spark):
    from corpus_pipeline import ngram_jaccard

    x, z = (" ".join(f"{c}{i}" for i in range(60)) for c in "xz")
    y = z + " y"  # near z
    alone = [f"{c}0 {c}1 {c}2" for c in "abcdefgh"]
    rows = [(5, x), (5, y), (2, z), (5, x), (3, ""), (3, None), (4, y)] + [(9, t) for t in alone]
    t = spark.createDataFrame([(t, i) for i, t in rows], "text string, doc_id long")
    want = sorted([(2, z), (5, x)] + [(9, t) for t in alone])
    kept = ngram_jaccard(spark, t, "")
    assert kept.columns == ["text", "doc_id"]
    kept = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(r for r in kept if r[1]) == want and [i for i, t in kept if not t] == [3]


def test_null_ids_take_part(spark, tmp_path):
    from corpus_pipeline import ngram_jaccard
    from logtide.llm import queries

    x, y, z = (" ".join(f"{c}{i}" for i in range(60)) for c in "xyz")
    rows = [(None, x), (None, x), (None, x + " near"), (7, x + " copy"), (None, y), (None, y + " near"), (None, y), (8, z), (None, None), (None, "")]
    t = spark.createDataFrame(rows, "doc_id long, text string")
    t.write.parquet(str(tmp_path / "documents.parquet"))
    got = [(r.doc_id, r.class_id, r.links, r.copies) for r in queries.queries()["op7_jaccard_join"](spark, str(tmp_path)).collect()]
    want = [(None, 7, 2, 2)] * 2 + [(None, 7, 2, 1), (7, 7, 2, 1), (8, 8, 0, 1)] + [(None, None, 1, 2)] * 2 + [(None, None, 1, 1)] + [(None, None, 0, 1)] * 2
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = sorted(((r.doc_id, r.text) for r in ngram_jaccard(spark, t, "").collect()), key=str)
    assert len(kept) == 5 and {(7, x + " copy"), (8, z), (None, None), (None, "")} < set(kept)
    assert sum(i is None and bool(t) and t.startswith("y0") for i, t in kept) == 1


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(110)] + [(i, i + 1) for i in range(300, 420)] + [(500, i) for i in range(501, 560)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.u: r.v for r in components.stars(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
