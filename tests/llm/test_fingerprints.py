"""Fingerprints against exact shingle sets and the order of documents."""

import hashlib
import random

import numpy as np
import pytest

from logtide.llm import fingerprints as FP
from logtide.llm import hashing


def plain_shingles(text, k=5):
    w = (text or "").encode().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    rnd = random.Random(1)
    texts = ["", None, " ", "a", " lead and trail \n", "é 漢 \x85 x", "y" * 5000, "w " * 4000] + [
        " ".join(rnd.choice(["ab", "b", "ccc", "é"]) for _ in range(rnd.randrange(300))) for _ in range(40)
    ]
    whole = [w.tolist() for _, w in hashing.word_hashes(texts)]
    monkeypatch.setattr(hashing, "PIECE", 64)
    assert [w.tolist() for _, w in hashing.word_hashes(texts)] == whole
    flat = [x for w in whole for x in w]
    names = [x for t in texts for x in (t or "").encode().split()]
    assert len(flat) == len(names) and len(set(flat)) == len(set(names))
    assert {h: n for h, n in zip(flat, names)} == dict(zip(flat, names)) and len(set(zip(flat, names))) == len(set(flat))


def test_patterned_words_differ():
    for n in (10, 12, 13):
        a, b = ("".join("ab"[(bin(i).count("1") + k) % 2] for i in range(1 << n)) for k in (0, 1))
        x, y, z, w = FP.sketches([a, b, f"in a {a} sentence of words", f"in a {b} sentence of words"])
        assert x.tolist() != y.tolist() and z.tolist() != w.tolist()


def test_sketch_measures():
    base = " ".join(f"w{i}" for i in range(3000))
    other = " ".join(f"w{i}" for i in range(1000, 4000))
    a, b = FP.sketches([base, other])
    sa, sb = plain_shingles(base), plain_shingles(other)
    assert abs(FP.resemblance(a, b) - len(sa & sb) / len(sa | sb)) < 0.15
    assert abs(FP.containment(a, b) - len(sa & sb) / len(sa)) < 0.2
    assert abs(FP.distinct(a) - len(sa)) < 0.3 * len(sa)
    assert FP.merged(a, b).tolist() == np.union1d(a, b)[: FP.K].tolist()
    short, same = FP.sketches(["one two three four five six", "one two three four five six"])
    assert FP.resemblance(short, same) == 1.0 and FP.distinct(short) == 2
    empty = FP.sketches([None])[0]
    assert FP.resemblance(empty, empty) == 1.0 and FP.resemblance(empty, short) == 0.0 and FP.containment(empty, a) == 1.0
    assert FP.decoded(FP._coded(a)).tolist() == a.tolist()


def test_merge_of_parts_is_the_whole(spark):
    rnd = random.Random(2)
    sets = {k: [rnd.getrandbits(62) for _ in range(n)] for k, n in (("hot", 3000), ("small", 5), ("none", 0))}
    rows = [(k, sorted(set(v[i::4]))[:16]) for k, v in sets.items() for i in range(4)]
    got = {r.key: r.sketch for r in FP.merge_fingerprints(spark.createDataFrame(rows, "key string, sketch array<long>"), "key", 16).collect()}
    assert got == {k: sorted(set(v))[:16] for k, v in sets.items()}


def test_fingerprint_keeps_columns(odd_docs):
    out = FP.fingerprint(odd_docs.withColumnRenamed("gone", "sketch"))
    assert out.columns == [c for c in odd_docs.columns if c != "gone"] + ["sketch"]
    assert {r.doc_id: len(r.sketch) for r in out.collect() if r.doc_id in (3, 4, 6)} == {3: 0, 4: 0, 6: 128}


@pytest.mark.parametrize("parts", [1, 7])
def test_edited_pairs(spark, parts):
    rnd = random.Random(parts)
    docs = {i: " ".join(f"w{rnd.randrange(40)}" for _ in range(rnd.randrange(0, 120))) + rnd.choice(["", "é", "\n"]) for i in rnd.sample(range(10**6), 150)}
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        t = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
        got = {r.doc_id: r for r in FP.edited_pairs(t).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    order = sorted(docs, reverse=True)
    for k, i in enumerate(order):
        a, b = docs[i], docs[order[(k + 1) % len(order)]]
        edit = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        sa, sb, se = plain_shingles(a), plain_shingles(b), plain_shingles(edit)
        r = got[i]
        assert r.n_chars == len(a) and r.edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        assert abs(r.near_edited - like(sa, se)) < 1e-9 and abs(r.near_next - like(sa, sb)) < 1e-9  # below k shingles: exact


def test_odd_rows(odd_docs, no_docs):
    rows = FP.edited_pairs(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert len({r.fingerprint for r in rows if r.doc_id in (1, 2)}) == 1
    assert FP.edited_pairs(no_docs).collect() == []
    alone = FP.edited_pairs(odd_docs.filter("doc_id = 6")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0
    assert len(FP.edited_pairs(odd_docs.filter("doc_id IS NULL")).collect()) == 2
