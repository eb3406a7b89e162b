"""Line dedup against a brute-force search for repeated runs."""

import random

import pytest

from logtide.llm import lines


def brute(docs, min_words):
    """{position in docs: (kept text, lines removed)}; docs in order of (doc_id, ...)."""
    seqs = []
    for text in docs:
        ls = text.split("\n")
        seqs.append([(i, x, len(x.split())) for i, x in enumerate(ls) if x.split()])
    seen, gone = {}, [set() for _ in docs]
    for d, s in enumerate(seqs):
        for i in range(len(s)):
            total = 0
            for j in range(i, len(s)):
                total += s[j][2]
                if total >= min_words:
                    key = tuple(x[1] for x in s[i : j + 1])
                    if key in seen:
                        gone[d].update(x[0] for x in s[i : j + 1])
                    else:
                        seen[key] = (d, i)
    out = []
    for d, text in enumerate(docs):
        ls = text.split("\n")
        kept = [x for i, x in enumerate(ls) if i not in gone[d]]
        left = sum(bool(x.split()) for x in kept)
        out.append((text if not gone[d] else "\n".join(kept) if left else "", len(gone[d]), left))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_matches_brute_force(spark, seed):
    rnd = random.Random(seed)
    pool = [" ".join(rnd.choice("abcdefg") for _ in range(rnd.choice([1, 1, 2, 5, 12]))) for _ in range(14)] + ["", "  "]
    docs = []
    for _ in range(60):
        docs.append("\n".join(rnd.choice(pool) for _ in range(rnd.randrange(0, 14))))
        if rnd.random() < 0.4:
            docs.append(rnd.choice(docs))
    t = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.text, r.n_removed, r.n_left) for r in lines.dedup_lines(t, min_words=10).collect()}
    want = brute(docs, 10)
    assert [got[i] for i in range(len(docs))] == want


def test_periodic_text_and_no_repeat(spark):
    t = spark.createDataFrame([(1, "\n".join(["x y"] * 40)), (2, "a b\nc d")], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in lines.dedup_lines(t, min_words=6).collect()}
    assert got == {1: ("x y", 39), 2: ("a b\nc d", 0)}
    t = t.filter("doc_id = 2")
    assert lines.dedup_lines(t, min_words=6).first().n_removed == 0


def test_odd_rows(odd_docs, no_docs):
    out = lines.dedup_lines(odd_docs.withColumnRenamed("links", "n_lines"))
    assert out.columns == [c for c in odd_docs.columns if c != "links"] + ["n_lines", "n_removed", "n_left"]
    got = sorted(((r.doc_id or 99, r.n_removed, r.n_left, r.text) for r in out.collect()), key=str)
    by = {}
    for i, removed, left, text in got:
        by.setdefault(i, []).append((removed, left, None if text is None else len(text)))
    text = odd_docs.filter("doc_id = 1").first().text
    assert by[1] == [(0, 1, len(text))] and by[2] == [(1, 0, 0)] * 2  # copies in order of doc_id; null ids come last
    assert (1, 0, 0) in by[99] and (0, 0, None) in by[99]
    assert by[3] == [(0, 0, None)] and by[4] == [(0, 0, 0)] and by[5] == [(0, 0, 4)]
    assert by[6] == [(0, 1, by[6][0][2])] and by[8] == [(0, 1, 300_000)]
    assert all(r.gone == "x" and r.size == -1 for r in out.collect())
    assert lines.dedup_lines(no_docs).collect() == []
