"""Toxicity against plain Kneser-Ney models, and on held-out rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from logtide.llm import toxicity
from logtide.llm.queries import queries
from tests.llm.conftest import ROOT

SF = f"{ROOT}/../testdata/sf0.1"
K, D = toxicity.ORDER, toxicity.DISCOUNT


def plain_words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


class Plain:
    """Both models with probabilities in full, and no shortcut for what cancels."""

    def __init__(self, texts):
        self.counts = [Counter(), Counter()]
        for text, y in texts:
            for w in set(plain_words(text)):
                self.counts[y].update(toxicity.grams_of(w))
        self.kinds = {K: set(self.counts[0]) | set(self.counts[1])}
        self.left = {}
        for k in range(K - 1, 0, -1):
            self.left[k] = Counter(g[1:] for g in self.kinds[k + 1])
            self.kinds[k] = set(self.left[k])
        self.after = {}
        for k, own in [*self.left.items(), *((y, c) for y, c in ((-1, self.counts[0]), (-2, self.counts[1])))]:
            total, number = Counter(), Counter()
            for g, n in own.items():
                total[g[:-1]] += n
                number[g[:-1]] += 1
            self.after[k] = (total, number)

    def shared(self, g):
        if not g:
            return 1 / (len(self.left[1]) + 1)
        total, number = self.after[len(g)]
        if not total[g[:-1]]:
            return self.shared(g[1:])
        return (max(self.left[len(g)][g] - D, 0) + D * number[g[:-1]] * self.shared(g[1:])) / total[g[:-1]]

    def p(self, g, y):
        total, number = self.after[-1 - y]
        if not total[g[:-1]]:
            return self.shared(g[1:])
        return (max(self.counts[y][g] - D, 0) + D * number[g[:-1]] * self.shared(g[1:])) / total[g[:-1]]

    def raw(self, text):
        words = plain_words(text)
        return sum(math.log(self.p(g, 1) / self.p(g, 0)) for w in words for g in toxicity.grams_of(w)) / len(words) if words else 0.0


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5


@pytest.fixture(scope="module")
def sample(spark):
    rnd = random.Random(4)
    parts = ["an", "to", "re", "li", "ß", "é", "漢", "x9"]
    bad = ["vilek", "vilem", "grobu", "grobi"]
    rows, labels = [], []
    for i in range(400):
        toxic = int(rnd.random() < 0.3)
        words = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 4))) for _ in range(rnd.randrange(5, 60))]
        if toxic:
            for _ in range(1 + len(words) // 15):
                words.insert(rnd.randrange(len(words)), rnd.choice(bad))
        rows.append((i, rnd.choice([" ", ", ", "_"]).join(words).title()))
        if i % 3:
            labels.append((i, toxic))
    labels += [(labels[0][0], labels[0][1]), (7_000, 1), (None, 1), (10, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return rows, docs, spark.createDataFrame(labels, "doc_id long, toxic int"), labels


def test_values_against_plain_models(spark, sample):
    rows, docs, labels, given = sample
    y = {i: v for i, v in given if v is not None}
    taught = [(t, y[i]) for i, t in rows if i in y and fold(i) > 1]
    plain = Plain(taught)
    grams = toxicity.gram_counts(spark.createDataFrame(taught, "text string, y int").repartition(3))
    assert {r.gram: (r.ordinary, r.toxic) for r in grams.collect()} == {g: (plain.counts[0][g], plain.counts[1][g]) for g in plain.kinds[K]}
    values = toxicity.ratios(grams).toArrow()
    model = toxicity.Model(values.column("gram").to_pylist(), values.column("value").to_numpy())
    for _, text in rows[:60] + [(0, "unseen Ωmega zzz 12345 vilex")]:
        words = plain_words(text)
        assert abs(model.words(words).sum() / len(words) - plain.raw(text)) < 1e-9
    # Probabilities of the classes sum to 1 with what is unknown.
    context = Counter(g[:-1] for g in plain.kinds[K]).most_common(1)[0][0]
    characters = [g for g in plain.left[1]]
    for k in (0, 1):
        assert sum(plain.p(context + x, k) for x in characters) == pytest.approx(1, abs=0.02)


def test_broadcast_and_join_agree_and_find(spark, sample):
    rows, docs, labels, given = sample
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    other = {r.doc_id: r for r in toxicity.classify(docs, labels, entries=0).collect()}
    assert got == other and len(got) == len(rows)
    truth = {i: any(w[:4] in ("vile", "grob") for w in plain_words(t)) for i, t in rows}
    assert all(got[i].held_out == (fold(i) == 0) for i in truth)
    right = [got[i].predicted == truth[i] for i in truth if got[i].held_out]
    assert np.mean(right) > 0.95


def test_odd_rows(spark, odd_docs, no_docs, sample):
    _, docs, labels, _ = sample
    more = odd_docs.withColumns({"y": odd_docs.size, "raw": odd_docs.size, "row": odd_docs.size})
    rows = toxicity.classify(more, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (3, 4, 5)}) == 1
    assert len({r.score for r in rows if r.doc_id == 2}) == 1
    assert sorted(map(str, rows)) == sorted(map(str, toxicity.classify(more, labels, entries=0).collect()))
    assert toxicity.classify(no_docs, labels).count() == 0
    assert {r.predicted for r in toxicity.classify(docs, labels.limit(0)).collect()} == {0}
    ones = labels.withColumn("toxic", labels.toxic * 0 + 1)
    assert {r.predicted for r in toxicity.classify(docs, ones).collect()} == {1}


def test_long_text_in_parts(monkeypatch):
    text = "Word_two 3x,é\n" * 500
    whole = [w for part in toxicity.words_of(text) for w in part]
    monkeypatch.setattr(toxicity, "_PART", 64)
    assert [w for part in toxicity.words_of(text) for w in part] == whole == plain_words(text)


def test_query_on_whole_table(spark):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries()["op11_toxicity"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.predicted == (r.score >= 0.5) and r.held_out == (fold(r.doc_id) == 0) for r in rows)
    kept = [r for r in rows if r.doc_id in truth and r.held_out]
    # 200 toxic texts teach here; with five times as many 95 % are caught.
    assert np.mean([r.predicted for r in kept if truth[r.doc_id]]) > 0.5
    assert np.mean([r.predicted for r in kept if not truth[r.doc_id]]) < 0.01
