"""Language ID and quality: held-out accuracy, folds, odd rows."""

import os
import zlib

import numpy as np
import pytest

from logtide.llm import langid, quality

SF = "/root/testdata/sf0.01"


def need_data():
    if not os.path.exists(SF):
        pytest.skip("no test data")


def test_language_held_out_accuracy(spark):
    need_data()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.identify(docs.select("doc_id", "text", "lang")).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)


def test_held_out_languages_teach_nothing(spark):
    need_data()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    from pyspark.sql import functions as F

    false = docs.withColumn("lang", F.when(langid.fold(F.col("doc_id"), 4) == 2, "xx").otherwise(F.col("lang")))
    a, b = (langid.identify(d).select("doc_id", "lang_pred", "score") for d in (docs, false))
    assert a.exceptAll(b).isEmpty()


def test_language_odd_rows(spark, odd_docs, no_docs):
    rows = langid.identify(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: (r.lang_pred, r.score) for r in rows}
    assert by[3] == by[4] == by[5] == by[10] == ("und", 0.0)
    assert by[6][0] != "und" and 0 < by[6][1] <= 1 and by[8][0] in ("de", "en", "fr")
    assert langid.identify(no_docs).collect() == []
    unknown = langid.identify(odd_docs.drop("lang").selectExpr("*", "CAST(NULL AS STRING) AS lang"))
    assert {r.lang_pred for r in unknown.collect()} == {"und"}
    kept = langid.keep_identified(odd_docs)
    assert kept.columns == odd_docs.columns and {r.size for r in kept.collect()} == {-1}
    assert not {3, 4, 5, 10} & {r.doc_id for r in kept.collect()}


def test_long_texts_are_read_in_pieces_without_a_seam(monkeypatch):
    text = "Straße über 12 Häuser. " * 50
    whole = np.sort(np.concatenate([x for _, found in langid._pieces([text]) for x in found]))
    monkeypatch.setattr(langid, "_PIECE", 37)
    cut = np.sort(np.concatenate([x for _, found in langid._pieces([text]) for x in found]))
    assert whole.tolist() == cut.tolist()


def test_quality_held_out(spark):
    need_data()
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    held = [(rows[x.doc_id], x.quality) for x in labels.collect() if rows[x.doc_id].held_out]
    assert sum(r.predicted for r, q in held if q) >= 0.97 * sum(q for _, q in held)
    assert sum(r.predicted == q for r, q in held) >= 0.95 * len(held)


def test_isotonic_is_the_least_squares_fit():
    n = np.array([1, 0, 2, 1, 3, 1, 0, 1], float)
    y = np.array([0.5, 0, 0.2, 0.9, 1.5, 0.1, 0, 1.0])
    fit = quality.isotonic(y, n)
    assert (np.diff(fit) >= -1e-12).all()
    there = n > 0
    assert abs((fit[there] * n[there]).sum() - y.sum()) < 1e-9
    best = ((y[there] / n[there] - fit[there]) ** 2 * n[there]).sum()
    rng = np.random.default_rng(0)
    for _ in range(300):
        other = np.sort(np.clip(fit[there] + rng.normal(0, 0.1, there.sum()), 0, 1))
        assert ((y[there] / n[there] - other) ** 2 * n[there]).sum() >= best - 1e-12


def test_quality_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame(
        [(1, 1, 0), (2, 1, 0), (2, 0, 0), (3, 0, 0), (6, 1, 0), (7, None, 0), (8, 0, 0), (None, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int"
    )
    rows = quality.classify(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 2}) == 1
    assert {r.score for r in quality.classify(odd_docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(no_docs, labels).collect() == []


def plain_buckets(text):
    """Buckets of the 1- to 3-grams of a text with a letter in them, one after the other."""
    low = text.lower()
    codes = [ord(c) if c.isalpha() else 32 for c in low] + [32, 32]
    first, second, third = langid._FACTORS
    for i in range(len(low)):
        h, letter = 0, False
        for j in range(3):
            h = (h * third + codes[i + j] * first + j + 1) % 2**32
            letter |= codes[i + j] != 32
            if letter:
                yield (h * second % 2**32) >> (32 - langid.BUCKET_BITS)


def test_language_against_a_plain_version(spark):
    need_data()
    import math
    from collections import Counter

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").filter("length(text) < 1500").limit(150)
    rows = [tuple(r) for r in docs.collect()] + [(9_000_001, "Ünïcode 漢字 and 12", None), (9_000_002, "12 !", "en"), (9_000_003, None, "de")]
    fold = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    counts, n = {}, Counter()
    for i, text, lang in rows:
        if text is not None and lang is not None and not fold(i):
            counts.setdefault(lang, Counter()).update(plain_buckets(text))
            n[lang] += 1
    total = {x: sum(c.values()) for x, c in counts.items()}
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()}
    assert len(got) == len(rows) and len(counts) > 2
    for i, text, _ in rows:
        found = list(plain_buckets(text or ""))
        if not found:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        logs = {x: math.log(n[x] / sum(n.values())) + sum(math.log((counts[x][b] + 0.5) / (total[x] + 0.5 * 2**langid.BUCKET_BITS)) for b in found) for x in counts}
        best = max(sorted(logs), key=logs.get)
        assert got[i].lang_pred == best and got[i].held_out == fold(i)
        assert abs(got[i].score - 1 / sum(math.exp(min(700, v - logs[best])) for v in logs.values())) < 0.01


def test_quality_against_a_plain_version(spark):
    need_data()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").filter("length(text) < 4000")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    texts, y = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.quality for r in labels.collect()}
    fold = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    taught = [i for i in sorted(texts) if i in y and not fold(i)]
    x = np.array([quality.describe(texts[i]) for i in taught])
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    draw = np.random.default_rng(7)
    directions, phases = draw.normal(0, 0.6, (x.shape[1], quality.FEATURES)), draw.uniform(0, 2 * np.pi, quality.FEATURES)

    def features(rows):
        z = np.clip((rows - mean) / scale, -8, 8) @ directions + phases
        return np.hstack([np.cos(z) * np.sqrt(2 / quality.FEATURES), np.ones((len(rows), 1))])

    z, target = features(x), np.array([y[i] for i in taught], float)
    small = 1e-3 * len(taught) / quality.FEATURES
    weights = np.linalg.lstsq(np.vstack([z, np.sqrt(small) * np.eye(z.shape[1])]), np.append(target, np.zeros(z.shape[1])), rcond=None)[0]
    place = lambda raw: np.clip(((raw + 0.5) / 2 * quality.BINS).astype(int), 0, quality.BINS - 1)
    bins = place(z @ weights)
    curve = quality.isotonic(np.bincount(bins, target, quality.BINS), np.bincount(bins, minlength=quality.BINS).astype(float))
    every = sorted(texts)
    raw = features(np.array([quality.describe(texts[i]) for i in every])) @ weights
    middles = -0.5 + (np.arange(quality.BINS) + 0.5) * 2 / quality.BINS
    want = dict(zip(every, np.clip(np.interp(raw, middles, curve), 0, 1)))
    got = {r.doc_id: r for r in quality.classify(docs.repartition(4), labels).collect()}
    assert sorted(got) == every
    differ = [abs(got[i].score - want[i]) for i in every]
    assert np.median(differ) < 1e-4 and np.quantile(differ, 0.99) < 0.02
    assert np.mean([got[i].predicted == (want[i] >= 0.3) for i in every]) > 0.995
