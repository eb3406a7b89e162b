"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

``statistics`` describes each whole text by a few numbers. After scaling, their
Gaussian kernel is approximated by random cosine features; each partition sums
its part of the normal equations, Spark adds the parts, and the driver solves
one small system. The ridge scores are calibrated by isotonic regression over
a fixed grid of score bins. Everything is fit on all labelled rows; what the
driver holds is as large as the number of features and bins.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.llm.langid import fold
from logtide.llm.store import cut

FEATURES = 256
BINS = 1000
_SLICE = 512

#: What ``statistics`` measures, in order; shares are of the text's bytes unless they say otherwise.
STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "letters", "digits", "upper_of_letters", "punctuation", "symbols", "spaces",
    "line_feeds", "distinct_words", "top_word", "distinct_lines", "top_symbol", "marked_words", "plain_words",
)

_OTHER, _LOWER, _UPPER, _DIGIT, _POINT, _SYMBOL, _SPACE, _FEED = range(8)
_CLASS = np.zeros(256, np.uint8)
_CLASS[:32] = _OTHER
_CLASS[[9, 11, 12, 13, 32]] = _SPACE
_CLASS[10] = _FEED
_CLASS[33:127] = _SYMBOL
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = _POINT
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_CLASS[ord("A") : ord("Z") + 1] = _UPPER
_CLASS[ord("a") : ord("z") + 1] = _LOWER
_CLASS[128:] = _LOWER  # letters of other scripts


def describe(text: str | None) -> list[float]:
    """The statistics of one text; null and empty give zeros."""
    data = (text or "").encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, np.uint8)
    bytes_ = np.bincount(raw, minlength=256)
    n = np.bincount(_CLASS, weights=bytes_, minlength=8)
    size, letters = max(1, len(data)), n[_LOWER] + n[_UPPER]
    words = data.split()
    counts = Counter(words)
    lines = data.split(b"\n")
    ends = Counter()
    for w, c in counts.items():
        ends[w[-1]] += c
    marked = sum(c for b, c in ends.items() if _CLASS[b] == _SYMBOL)
    plain = sum(c for b, c in ends.items() if _CLASS[b] in (_LOWER, _UPPER, _DIGIT))
    some = max(1, len(words))
    symbols = np.where((_CLASS == _SYMBOL) | (_CLASS == _POINT), bytes_, 0)
    return [
        np.log1p(len(data)), np.log1p(len(words)), (len(data) - n[_SPACE] - n[_FEED]) / some, letters / size, n[_DIGIT] / size,
        n[_UPPER] / max(1, letters), n[_POINT] / size, n[_SYMBOL] / size, n[_SPACE] / size, n[_FEED] / size,
        len(counts) / some, max(counts.values(), default=0) / some, len(set(lines)) / len(lines), symbols.max() / size,
        marked / some, plain / some,
    ]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, x: array<double> of ``STATISTICS`` of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _SLICE):
                part = batch.slice(start, _SLICE)
                x = [describe(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Model:
    """Scaling, random directions and phases, ridge weights, calibration (values at the middles of the score bins)."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray | None = None
    calibrated: np.ndarray | None = None
    low: float = -0.5
    high: float = 1.5

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        z = np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([z, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def bins(self, raw: np.ndarray) -> np.ndarray:
        at = (raw - self.low) / (self.high - self.low) * BINS
        return np.clip(at.astype(np.int64), 0, BINS - 1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        middles = self.low + (np.arange(BINS) + 0.5) * (self.high - self.low) / BINS
        # Rounded: the last bits of a matrix product depend on the rows it is computed with.
        return np.round(np.clip(np.interp(np.round(self.raw(x), 9), middles, self.calibrated), 0, 1), 6)


def _vectors(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def isotonic(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Means of y (weights n) made non-decreasing by pooling adjacent violators; empty places are interpolated."""
    there = np.flatnonzero(n > 0)
    blocks: list[list[float]] = []  # sum, weight, places
    for i in there:
        blocks.append([y[i], n[i], 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, w, c = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + w, blocks[-1][2] + c]
    fitted = np.repeat([b[0] / b[1] for b in blocks], [int(b[2]) for b in blocks])
    return np.interp(np.arange(len(n)), there, fitted)


def fit(train: DataFrame, features: int = FEATURES, ridge: float = 1e-3, width: float = 0.6, seed: int = 7) -> Model | None:
    """Model from rows (x, y); None without rows. ``ridge`` is per row, ``width`` scales the random directions."""
    d = len(STATISTICS)
    parts = [F.avg(F.col("x")[i]) for i in range(d)] + [F.stddev_pop(F.col("x")[i]) for i in range(d)]
    first = train.agg(F.count("*"), *parts).first()
    if not first[0]:
        return None
    draw = np.random.default_rng(seed)
    scale = np.array(first[1 + d :], float)
    model = Model(
        np.array(first[1 : 1 + d], float), np.where(scale > 1e-9, scale, 1.0),
        draw.normal(0, width, (d, features)), draw.uniform(0, 2 * np.pi, features),
    )

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((features + 1, features + 2))
        for batch in batches:
            z, y = model.features(_vectors(batch, 0)), batch.column(1).to_numpy(zero_copy_only=False)
            total += z.T @ np.hstack([z, y[:, None]])
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], names=["i", "j", "v"])

    sums = train.select("x", "y").mapInArrow(equations, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    a = np.zeros((features + 1, features + 2))
    a[sums.column("i").to_numpy(), sums.column("j").to_numpy()] = sums.column("v").to_numpy()
    gram = a[:, :-1] + ridge * first[0] / features * np.eye(features + 1)
    model.weights = np.linalg.solve(gram, a[:, -1])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y_sum, n = np.zeros(BINS), np.zeros(BINS)
        for batch in batches:
            at = model.bins(model.raw(_vectors(batch, 0)))
            y_sum += np.bincount(at, batch.column(1).to_numpy(zero_copy_only=False), BINS)
            n += np.bincount(at, minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS, dtype=np.int32)), pa.array(y_sum), pa.array(n)], names=["bin", "y", "n"])

    got = train.select("x", "y").mapInArrow(binned, "bin int, y double, n double").groupBy("bin").agg(F.sum("y").alias("y"), F.sum("n").alias("n")).toArrow()
    y, n = np.zeros(BINS), np.zeros(BINS)
    y[got.column("bin").to_numpy()], n[got.column("bin").to_numpy()] = got.column("y").to_numpy(), got.column("n").to_numpy()
    model.calibrated = isotonic(y, n)
    return model


def score(rows: DataFrame, model: Model | None) -> DataFrame:
    """``rows`` (x first, then others) with ``score`` in the place of x; 0.5 without a model."""
    if model is None:
        return rows.withColumn("x", F.lit(0.5)).withColumnRenamed("x", "score")
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(sent.value.scores(_vectors(batch, 0))), *batch.columns[1:]], names=["score", *batch.schema.names[1:]])

    return rows.mapInArrow(run, rows.withColumn("x", F.lit(0.0)).withColumnRenamed("x", "score").schema)


def held_out(doc_id: Column) -> Column:
    """The fold that teaches nothing: crc32 of the id as text modulo 5 is 0."""
    return fold(doc_id, 5) == 0


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 if score >= threshold).

    Learns from rows of ``labels`` (doc_id, quality) that are not held out;
    several labels of one document count as their mean, null labels as none.
    Null and empty texts are scored like any other. Repeated rows are scored
    alike; null doc_ids are held out. Without a label all scores are 0.5. Other
    columns are not read.
    """
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.avg("quality").alias("y"))
    table = cut(statistics(docs), "statistics")
    model = fit(cut(table.join(known, "doc_id").select("x", "y"), "labelled"))
    rows = score(table.select("x", "doc_id", held_out(F.col("doc_id")).alias("held_out")), model)
    return rows.select("doc_id", "held_out", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
