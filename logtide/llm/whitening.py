"""Embedding whitening: principal components by QDWH divide and conquer, applied from a broadcast.

Spark adds up the fit list (sums, then products of the centred rows, a matrix a
partition, added in two levels); the driver holds one d x d matrix at a time
and splits it: the polar factor of the shifted covariance, by QR-based dynamically weighted
Halley steps, gives the projectors onto the eigenvectors above and below the
shift, and each of the two invariant subspaces is split further until it is one
component. Then each row is centred and projected in its own task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logtide.llm.store import cut

COMPONENTS = 4
SCALE = 256
_SLICE = 4096
_EPS = np.finfo(float).eps
_LOW = (1 << 32) - 1


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal (symmetric) polar factor of a symmetric matrix: its eigenvalues become their signs."""
    d = len(a)
    norm = np.linalg.norm(a)
    if not norm:
        return np.eye(d)
    x = a / norm
    least = max(np.abs(np.diag(np.linalg.qr(x, mode="r"))).min() / math.sqrt(d), 1e-15)
    for _ in range(30):
        square = least * least
        gap = (4 * (1 - square) / square**2) ** (1 / 3) if square < 1 else 0.0
        root = math.sqrt(1 + gap)
        one = root + math.sqrt(max(0.0, 8 - 4 * gap + 8 * (2 - square) / (square * root))) / 2
        two = (one - 1) ** 2 / 4
        three = one + two - 1
        q = np.linalg.qr(np.vstack([math.sqrt(three) * x, np.eye(d)]))[0]
        new = two / three * x + (one - two / three) / math.sqrt(three) * q[:d] @ q[d:].T
        new = (new + new.T) / 2
        moved = np.linalg.norm(new - x)
        x, least = new, min(1.0, least * (one + two * square) / (1 + three * square))
        if 1 - least < 10 * _EPS and moved < _EPS ** (1 / 3):
            break
    return x


def _shifts(a: np.ndarray) -> Iterator[float]:
    """Places to cut the eigenvalues: the middle of the diagonal, its mean, then between."""
    diagonal = np.sort(np.diag(a))
    yield float(np.median(diagonal))
    yield float(diagonal.mean())
    for share in (0.25, 0.75, 0.1, 0.9, 0.4, 0.6):
        yield float(diagonal[0] + share * (diagonal[-1] - diagonal[0]))
        yield float(diagonal.mean() + (share - 0.5) * diagonal.std())


def _halves(a: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of two invariant subspaces, of the eigenvalues above and below a shift; None if they are all equal."""
    d = len(a)
    best, off = None, math.inf
    draw = np.random.default_rng(d)
    for shift in _shifts(a):
        upper = (polar(a - shift * np.eye(d)) + np.eye(d)) / 2
        k = round(np.trace(upper))
        if not 0 < k < d:
            continue
        basis = np.linalg.qr(upper @ draw.normal(size=(d, k)))[0]
        whole = np.linalg.qr(upper @ basis, mode="complete")[0]
        left = np.linalg.norm(whole[:, k:].T @ a @ whole[:, :k])
        if left < off:
            best, off = (whole[:, :k], whole[:, k:]), left
        if off <= 4 * d * _EPS * size:
            break
    return best


def eigen(a: np.ndarray, size: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of a symmetric matrix, in no order."""
    d = len(a)
    size = np.linalg.norm(a) if size is None else size
    if d == 1 or np.linalg.norm(a - np.diag(np.diag(a))) <= _EPS * size:
        return np.diag(a).copy(), np.eye(d)
    halves = _halves(a, size)
    if halves is None:
        return np.diag(a).copy(), np.eye(d)
    values, vectors = zip(*(eigen(_even(v.T @ a @ v), size) for v in halves))
    return np.concatenate(values), np.hstack([v @ w for v, w in zip(halves, vectors)])


def _even(a: np.ndarray) -> np.ndarray:
    return (a + a.T) / 2


@dataclass
class Whitening:
    """Fit of one vector length: rows n, exact sums, components (columns, by falling variance), variances, all variance."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    total: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: the whole part of the mean goes off in integers, so large means cost no digits."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - whole).astype(np.float64) - rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Unit variance on each component; 0 on a component without variance."""
        scale = np.where(self.live, np.sqrt(np.where(self.live, self.variances, 1.0)), np.inf)
        return (self.centred(x) @ self.components) / scale

    @property
    def live(self) -> np.ndarray:
        return self.variances > len(self.sums) * _EPS * max(self.total, 0.0)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)^2, exact; None beyond a 64-bit integer."""
        most = self.n * int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))) + max(map(abs, self.sums))
        if most * most * len(self.sums) < 1 << 62:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(1).tolist()
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist()]
        return [v if v < 1 << 63 else None for v in exact]


def whole_vectors(rows: DataFrame, vector: str, scale: int = SCALE) -> DataFrame:
    """``rows`` whose ``vector`` has no null or non-finite entry, with ``x``: floor(scale * entry) as array<long>."""
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(math.inf)), F.lit(False))
    good = rows.filter(F.col(vector).isNotNull()).filter(F.forall(vector, finite))
    return good.withColumn("x", F.transform(vector, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("long") + F.lit(0)))


def _matrix(batch: pa.RecordBatch, column: int, d: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _summed(rows: DataFrame, size: int, dtype, part) -> np.ndarray:
    """Sum of the arrays ``part(batch)`` over all of ``rows``: in each task, in about the root of their number, on the driver one by one."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype)
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                total += part(batch.slice(at, _SLICE))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype)
        for batch in batches:
            for m in batch.column(0):
                total += np.frombuffer(m.as_py(), dtype)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    groups = max(1, math.isqrt(rows.rdd.getNumPartitions()))
    parts = rows.mapInArrow(each, "m binary").repartition(groups).mapInArrow(again, "m binary")
    total = np.zeros(size, dtype)
    for row in parts.toLocalIterator():
        total += np.frombuffer(row.m, dtype)
    return total


def fit(distinct: DataFrame, d: int, n: int, components: int = COMPONENTS) -> Whitening:
    """Fit of the n rows of ``distinct`` (x: array<long> of length d)."""

    def halves(batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(batch, 0, d)
        return np.concatenate([(x >> 32).sum(0), (x & _LOW).sum(0)])

    both = _summed(distinct, 2 * d, np.int64, halves).tolist()  # 2^31 rows and more stay exact
    model = Whitening(n, [(h << 32) + low for h, low in zip(both[:d], both[d:])], np.zeros((d, 0)), np.zeros(0), 0.0)

    def products(batch: pa.RecordBatch) -> np.ndarray:
        c = model.centred(_matrix(batch, 0, d))
        return (c.T @ c).ravel()

    v = _even(_summed(distinct, d * d, np.float64, products).reshape(d, d)) / n
    vectors = eigen(v)[1]
    values = np.einsum("ij,ij->j", vectors, v @ vectors)
    order = np.argsort(-values, kind="stable")[:components]
    first = np.abs(vectors[:, order]).argmax(0)  # either sign will do; this one does not depend on the split
    signs = np.where(vectors[first, order] < 0, -1.0, 1.0)
    model.components, model.variances, model.total = vectors[:, order] * signs, np.maximum(values[order], 0.0), float(np.trace(v))
    return model


def _projected(rows: DataFrame, model: Whitening) -> DataFrame:
    """``rows`` (x first, then others) with w: array<double> and deviation in the place of x."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    d = len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                x = _matrix(part, 0, d)
                w = sent.value.whitened(x)
                lists = pa.ListArray.from_arrays(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([lists, pa.array(sent.value.deviations(x), pa.int64()), *part.columns[1:]], names=["w", "deviation", *part.schema.names[1:]])

    added = [T.StructField("w", T.ArrayType(T.DoubleType())), T.StructField("deviation", T.LongType())]
    schema = T.StructType([*added, *rows.schema.fields[1:]])
    return rows.mapInArrow(run, schema)


def _identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, over components with variance."""
    at = np.flatnonzero(model.live).tolist()
    pairs = [(i, j) for i in at for j in at if i <= j]
    if not pairs:
        return 0.0
    w: list[Column] = [F.col("w")[i] for i in range(len(model.variances))]
    got = _projected(distinct, model).agg(*[F.covar_pop(w[i], w[j]) for i, j in pairs]).first()
    return float(max(abs(v - (i == j)) for v, (i, j) in zip(got, pairs)))


def whiten(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component.

    A vector takes part if it and all its entries are neither null nor
    non-finite; entries become x = floor(scale * entry) (at the ends of a
    64-bit integer where they are beyond it). The fit list is each distinct x
    once: n of them with sums S. Components are numbered from 1 by falling
    variance, at most as many as there are dimensions; ``whitened`` is x - S/n on
    the component over the root of its variance (0 on a component without
    variance, which ``identity_error`` leaves out); ``explained`` the component's
    share of all variance (0 if there is none); ``deviation`` the sum of
    (n * x - S)^2, null beyond a 64-bit integer. Vectors of another length are
    whitened by a fit of their own; empty vectors have no component and give no
    row. Repeated rows and null ids are rows like any other; other columns are
    not read; an empty table gives none.
    """
    taken = whole_vectors(rows.select(F.col(id_column).alias("_id"), F.col(vector).alias("_vector")), "_vector", scale).select("x", "_id")
    distinct = cut(taken.select("x").distinct(), "distinct_vectors")
    out = None
    for d, n in sorted(distinct.groupBy(F.size("x")).count().filter("size(x) > 0").collect()):
        own = distinct.filter(F.size("x") == d)
        model = fit(own, d, n, components)
        model.identity_error = _identity_error(own, model)
        explained = (model.variances / model.total if model.total > 0 else model.variances).tolist()
        t = _projected(taken.filter(F.size("x") == d), model)
        t = t.select("_id", "deviation", F.posexplode("w").alias("_at", "whitened"))
        t = t.select(
            F.col("_id").alias(id_column), (F.col("_at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
            F.array(*map(F.lit, explained))[F.col("_at")].alias("explained"), F.lit(model.identity_error).alias("identity_error"),
        )
        out = t if out is None else out.unionAll(t)
    if out is None:
        kind = taken.schema["_id"].dataType.simpleString()
        out = rows.sparkSession.createDataFrame([], f"`{id_column}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out
