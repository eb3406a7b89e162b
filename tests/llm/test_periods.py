"""Periodic runs against a plain search of every period."""

import hashlib
import random
import re
import zlib

from logtide.llm import periods
from logtide.llm.queries import queries
from tests.llm.conftest import ROOT

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = f"{ROOT}/../testdata/sf0.001"


def plain_runs(w, repeats=4, least=6):
    found, taken = [], set()
    for q in range(1, len(w) // repeats + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            # A smaller period of the same stretch was there first.
            if i + q - s >= max(least, repeats * q) and not any(a <= s and i + q <= b for a, b in taken):
                taken.add((s, i + q))
                found.append((s, i + q - s, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def edited(doc_id, text):
    w = WORD.findall(text or "")
    if doc_id is None or not w:
        return w
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return w
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [w[a + (i - a) % p] if i >= a else w[i] for i in range(len(w))]


def of_texts(texts, **options):
    words = [periods.words_of(t) for t in texts]
    return [([tuple(r) for r in runs.tolist()], left) for runs, left in periods._described(words, options.get("repeats", 4), options.get("least", 6))]


def test_runs_are_those_of_a_plain_search():
    rnd = random.Random(5)
    texts = ["", "a", "a a a a a", "a a a a a a", "a " * 500, "a b " * 3, "a b " * 4, None, " \n"]
    for k in (1, 2, 3):
        texts += [" ".join(rnd.choice("abc"[:k]) for _ in range(rnd.randrange(1, 120))) for _ in range(60)]
    for _ in range(120):
        w = []
        while len(w) < 90:
            part = [rnd.choice("abcdef") for _ in range(rnd.randrange(1, 13))]
            w += (part * rnd.randrange(1, 8))[: rnd.randrange(1, 70)]
        texts.append(" ".join(w))
    fibonacci = ["a", "a b"]
    while len(fibonacci[-1]) < 900:
        fibonacci.append(fibonacci[-1] + " " + fibonacci[-2])
    texts += [fibonacci[-1], " ".join(fibonacci[-1].split()[:300] * 5)]
    for repeats in (3, 4):
        for text, (runs, left) in zip(texts, of_texts(texts, repeats=repeats)):
            w = (text or "").split()
            assert runs == plain_runs(w, repeats)
            assert left == plain_collapsed(w, runs)


def test_texts_of_a_group_do_not_mix():
    a, b = "x y x y x y x y x y", "y x y x y x y x"
    for texts in ([a], [b], [a, b, a], ["x " * 3, "x " * 3]):
        assert of_texts(texts) == [of_texts([t])[0] for t in texts]


def test_long_text():
    w = [f"w{i % 977}" for i in range(200_000)]
    (runs, left), = of_texts([" ".join(["head", *w, "tail"])])
    assert runs == [(1, 200_000, 977)] and len(left.split()) == 979


def test_odd_rows(spark, odd_docs, no_docs):
    named = odd_docs.withColumns({"Runs": odd_docs.size, "a.b": odd_docs.size, "tick`": odd_docs.size})
    got = periods.periodic_runs(named)
    assert got.columns == [*odd_docs.columns, "a.b", "tick`", "runs", "collapsed"]
    rows = got.collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        w = WORD.findall(r.text or "")
        if len(w) < 1000:
            assert [tuple(x) for x in r.runs] == plain_runs(w)
        assert r.collapsed == plain_collapsed(w, [tuple(x) for x in r.runs])
    assert periods.run_digest(periods.periodic_runs(periods.replanted(no_docs))).count() == 0
    assert {r.n_runs for r in periods.run_digest(periods.periodic_runs(periods.replanted(odd_docs))).collect() if r.doc_id is None} == {0}


def test_query_on_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries()["op12_periodic_runs"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    some = 0
    for r in rows:
        w = edited(r.doc_id, docs[r.doc_id])
        if len(w) > 6000:
            continue
        runs = plain_runs(w)
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        some += bool(runs)
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(plain_collapsed(w, runs).encode()).hexdigest()
    assert some >= 10
