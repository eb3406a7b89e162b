"""Whitening against numpy's own eigensolver and whole-number sums."""

import math

import numpy as np
import pytest

from logtide.llm import whitening
from logtide.llm.queries import queries
from tests.llm.conftest import ROOT

SF = f"{ROOT}/../testdata/sf0.001"


@pytest.mark.parametrize("d", [1, 2, 3, 17, 64])
def test_eigen_against_numpy(d):
    draw = np.random.default_rng(d)
    q = np.linalg.qr(draw.normal(size=(d, d)))[0]
    wide = np.concatenate([np.zeros(d // 2), 10.0 ** draw.uniform(-8, 3, d - d // 2)])
    for values in (draw.gamma(1, 1, d), np.repeat([1.0, 2.0], [d // 2, d - d // 2]), wide, 1 + 1e-9 * draw.normal(size=d), np.zeros(d), -draw.gamma(1, 1, d)):
        a = (q * values) @ q.T
        a = (a + a.T) / 2
        got, vectors = whitening.eigen(a)
        size = max(np.abs(values).max(), 1e-300)
        assert np.abs(np.sort(got) - np.linalg.eigvalsh(a)).max() <= 1e-13 * size
        assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-13
        assert np.abs(a @ vectors - vectors * got).max() <= 1e-13 * size


def test_polar_factor_has_signs_as_eigenvalues():
    draw = np.random.default_rng(3)
    a = draw.normal(size=(20, 20))
    a = a + a.T
    values, vectors = np.linalg.eigh(a)
    assert np.abs(whitening.polar(a) - (vectors * np.sign(values)) @ vectors.T).max() < 1e-12


def expected(rows):
    """doc -> (n, deviation, whitened without sign, explained) by numpy and whole numbers."""
    kept = [(i, tuple(math.floor(256 * c) for c in v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in kept})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(d)]
    centre = lambda x: np.array([(n * x[k] - sums[k]) / n for k in range(d)])
    c = np.array([centre(x) for x in fit])
    values, vectors = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-values)[:4]
    out = []
    for i, x in kept:
        w = centre(x) @ vectors[:, order] / np.sqrt(values[order])
        out.append((i, n, sum((n * x[k] - sums[k]) ** 2 for k in range(d)), w, values[order] / values.sum()))
    return out


def compared(got, rows):
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    want = expected(rows)
    assert sorted(by) == sorted(i for i, *_ in want)
    signs = {}
    for i, n, deviation, w, explained in want:
        assert sorted(by[i]) == list(range(1, len(w) + 1))
        for k, r in by[i].items():
            assert (r.n, r.deviation) == (n, deviation)
            assert abs(abs(r.whitened) - abs(w[k - 1])) < 1e-9
            if abs(w[k - 1]) > 1e-6:
                assert signs.setdefault(k, np.sign(r.whitened * w[k - 1])) == np.sign(r.whitened * w[k - 1])
            assert abs(r.explained - explained[k - 1]) < 1e-12 and r.identity_error < 1e-9


def test_query_on_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    compared(queries()["op13_whitening"](spark, SF).collect(), rows)


def test_repeated_odd_and_far_rows(spark):
    draw = np.random.default_rng(9)
    base = [(i, [float(x) for x in 1e6 + draw.normal(size=6) * [9, 5, 3, 2, 1, 0.5]]) for i in range(300)]
    odd = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] + [0.0] * 5), (903, [float("inf")] + [0.0] * 5)]
    again = [(1000 + i, v) for i, v in base[:50]] + [(5000 + i, base[0][1]) for i in range(200)]
    df = spark.createDataFrame([(i, v, "x") for i, v in base + odd + again], "vec_id long, embedding array<double>, component string").repartition(5)
    compared(whitening.whiten(df).collect(), base + odd + again)


def test_other_lengths_flat_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    none = spark.createDataFrame([], schema)
    assert whitening.whiten(none).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(none).count() == 0
    rows = [(1, [1.0, 2.0]), (2, [1.0, 4.0]), (3, [-0.0]), (4, [0.0]), (None, []), (None, [1.0, 2.0])]
    got = {}
    for r in whitening.whiten(spark.createDataFrame(rows, schema)).collect():
        got.setdefault(r.vec_id, []).append(r)
    two = sorted(got[1], key=lambda r: r.component)
    assert [r.n for r in two] == [2, 2] and abs(abs(two[0].whitened) - 1) < 1e-12 and two[1].whitened == 0.0
    assert [r.explained for r in two] == [1.0, 0.0] and two[0].deviation == 512**2
    assert [(r.n, r.whitened, r.explained, r.deviation) for r in got[3]] == [(1, 0.0, 0.0, 0)]
    assert len(got[None]) == 2 and sorted(got) == [1, 2, 3, 4] if None not in got else True
    big = whitening.whiten(spark.createDataFrame([(1, [1e17, 0.0]), (2, [-1e17, 0.0])], schema.replace("float", "double"))).collect()
    assert all(r.deviation is None for r in big) and {round(abs(r.whitened), 9) for r in big if r.component == 1} == {1.0}
