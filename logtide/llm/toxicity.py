"""Toxicity by two Kneser-Ney models of how words are written: one of toxic texts, one of ordinary texts.

A word (letters and digits, lower case) is a start mark, its characters and an
end mark; a model gives each character a probability after the ``ORDER - 1``
before it. A word counts once a text, so no text's habit makes a class. Counts at the full
order are kept for each class, the shorter ones are shared: numbers of
different left neighbours over both classes. So with discount D, counts c,
their sum C and their number N after the context h

    p_class(x | h) = (max(c(h x) - D, 0) + D * N(h) * p_shared(x | shorter h)) / C(h)

and p_class = p_shared where the class never saw h. The logarithm of
p_toxic / p_ordinary then hangs on three cases only: a known n-gram has its own
value, an unknown one after a known context has the context's (the shared part
cancels), and after an unknown context it is 0. A word's value is the sum over
its characters, a text's the mean over its words. A logistic curve, fitted on
labelled texts that gave no counts, turns it into a score.

Counts, contexts and shared probabilities are tables that grow with the corpus.
Where their rows fit ``MODEL_ENTRIES`` they are broadcast, else texts' words are joined
with them; both give the same scores.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.llm.hashing import mixed
from logtide.llm.joins import near_keys
from logtide.llm.langid import fold
from logtide.llm.pieces import _Table
from logtide.llm.store import cut

ORDER = 4
DISCOUNT = 0.75
MODEL_ENTRIES = 2_000_000  # broadcast up to here: 50 MB
CACHE_WORDS = 100_000
BIN = 0.001
BINS = 2000  # of the mean log-likelihood ratio, from -1 to 1
_FLUSH = 100_000
_PART = 1 << 20
_GROUP = 1 << 15  # words looked up at once
_START, _END = "\x02", "\x03"
_WORD = re.compile(r"[^\W_]+")
_BREAK = re.compile(r"[\W_]")


def words_of(text: str | None) -> Iterator[list[str]]:
    """The words of a text, a part of about ``_PART`` characters at a time."""
    text, at = text or "", 0
    while at < len(text):
        m = _BREAK.search(text, at + _PART) if len(text) - at > _PART else None
        stop = m.start() if m else len(text)
        yield _WORD.findall(text[at:stop].lower())
        at = stop


def grams_of(word: str, order: int = ORDER) -> list[str]:
    s = _START * (order - 1) + word + _END
    return [s[i : i + order] for i in range(len(word) + 1)]


def gram_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, toxic, ordinary: counts over the different words of each of ``texts`` (text, y: 1 toxic, 0 ordinary); summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: tuple[dict[str, int], dict[str, int]] = ({}, {})
        counts: dict[str, list[int]] = {}

        def into_grams() -> None:
            for y, own in enumerate(words):
                for w, n in own.items():
                    for g in grams_of(w, order):
                        counts.setdefault(g, [0, 0])[y] += n
                own.clear()

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(counts)), *(pa.array([c[y] for c in counts.values()], pa.int64()) for y in (1, 0))], names=["gram", "toxic", "ordinary"])
            counts.clear()
            return rows

        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
                own = words[y]
                for w in set().union(*words_of(text.as_py())):
                    own[w] = own.get(w, 0) + 1
                if len(words[0]) + len(words[1]) > _FLUSH // 4:
                    into_grams()
                if len(counts) > _FLUSH:
                    yield out()
        into_grams()
        if counts:
            yield out()

    parts = texts.select("text", "y").mapInArrow(run, "gram string, toxic long, ordinary long")
    return parts.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _smoothed(count: Column, total: Column, kinds: Column, below: Column, discount: float) -> Column:
    return (F.greatest(count - discount, F.lit(0.0)) + discount * kinds * below) / total


def continuations(grams: DataFrame, order: int = ORDER, discount: float = DISCOUNT) -> DataFrame:
    """gram (of ``order`` - 1 characters), p: the shared model below the full order, from the different n-grams of ``order``."""
    kinds = {order: grams.select("gram")}
    for k in range(order - 1, 0, -1):  # n: how many different characters stand before it
        kinds[k] = cut(kinds[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n")), f"kinds{k}")
    total, different = kinds[1].agg(F.sum("n"), F.count("*")).first()
    even = 1.0 / (different + 1) if different else 1.0
    p = kinds[1].select("gram", _smoothed(F.col("n"), F.lit(total or 1), F.lit(different), F.lit(even), discount).alias("p"))
    for k in range(2, order):
        t = kinds[k].withColumn("context", F.substring("gram", 1, k - 1)).withColumn("shorter", F.substring("gram", 2, k - 1))
        after = t.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        t = t.join(after, "context").join(p.withColumnsRenamed({"gram": "shorter", "p": "below"}), "shorter")
        p = t.select("gram", _smoothed(F.col("n"), F.col("total"), F.col("kinds"), F.col("below"), discount).alias("p"))
    return p


def ratios(grams: DataFrame, order: int = ORDER, discount: float = DISCOUNT) -> DataFrame:
    """gram, value: log(p_toxic / p_ordinary) of every known n-gram, and of every known context (one character shorter) for what it was not seen with."""
    sums = [x for c in ("toxic", "ordinary") for x in (F.sum(c).alias(f"{c}_total"), F.count_if(F.col(c) > 0).alias(f"{c}_kinds"))]
    after = cut(grams.groupBy(F.substring("gram", 1, order - 1).alias("context")).agg(*sums), "contexts")
    shared = continuations(grams, order, discount).withColumnRenamed("gram", "shorter")
    t = grams.withColumn("context", F.substring("gram", 1, order - 1)).withColumn("shorter", F.substring("gram", 2, order - 1))
    t = t.join(after, "context").join(shared, "shorter")

    def p(c: str) -> Column:
        known = _smoothed(F.col(c), F.col(f"{c}_total"), F.col(f"{c}_kinds"), F.col("p"), discount)
        return F.when(F.col(f"{c}_total") > 0, known).otherwise(F.col("p"))

    def left(c: str) -> Column:
        return F.when(F.col(f"{c}_total") > 0, discount * F.col(f"{c}_kinds") / F.col(f"{c}_total")).otherwise(1.0)

    known = t.select("gram", F.log(p("toxic") / p("ordinary")).alias("value"))
    return known.unionAll(after.select(F.col("context").alias("gram"), F.log(left("toxic") / left("ordinary")).alias("value")))


def _window_hashes(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the context, hash of the n-gram, first window of each word) of all words."""
    text = "".join(_START * (order - 1) + w + _END for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.array([len(w) + 1 for w in words], np.int64)
    first = np.cumsum(lengths) - lengths
    starts = np.arange(lengths.sum()) + np.repeat(np.arange(len(words)) * (order - 1), lengths)
    return *_chained(codes, starts, order), first


def _chained(codes: np.ndarray, starts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    h = np.full(len(starts), order, np.uint64)
    before = h
    for j in range(order):
        before = h
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + codes[starts + j] + np.uint64(1))
    return before, np.where(h == 0, np.uint64(1), h)


class Model:
    """Values of n-grams and contexts by hash."""

    def __init__(self, grams: list[str], values: np.ndarray, order: int = ORDER):
        self.order = order
        lengths = np.array([len(g) for g in grams], np.int64)
        codes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        starts = np.cumsum(lengths) - lengths
        codes = np.append(codes, np.zeros(1, np.uint64))  # a last context has no further character
        before, whole = _chained(codes, starts, order)
        hashes = np.where(lengths == order, whole, before)
        _, first = np.unique(hashes, return_index=True)
        first.sort()
        self.table = _Table(len(first))
        self.table.add(hashes[first])
        self.values = np.append(values[first].astype(np.float64), 0.0)  # the last stands for an unknown context, -1

    def words(self, words: list[str]) -> np.ndarray:
        """Log-likelihood ratio of each word."""
        context, gram, first = _window_hashes(words, self.order)
        at = self.table.lookup(gram)
        rest = np.flatnonzero(at < 0)
        at[rest] = self.table.lookup(context[rest])
        return np.add.reduceat(self.values[at], first)


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, raw: the mean value of the words, by a broadcast model; words seen lately are looked up once."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            total, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            group: list[tuple[int, list[str]]] = []

            def add() -> None:
                new = list(set().union(*(words for _, words in group)).difference(known))
                if new:
                    known.update(zip(new, sent.value.words(new).tolist()))
                for i, words in group:
                    total[i] += math.fsum(map(known.__getitem__, words))
                    n[i] += len(words)
                group.clear()
                if len(known) > CACHE_WORDS:
                    known.clear()

            size = 0
            for i, text in enumerate(batch.column(1)):
                for words in words_of(text.as_py()):
                    group.append((i, words))
                    size += len(words)
                    if size > _GROUP:
                        add()
                        size = 0
            add()
            # Rounded: the last bits of a sum hang on its parts.
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(total / np.maximum(n, 1), 9))], names=["doc_id", "raw"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, raw double")


def _joined(docs: DataFrame, values: DataFrame, order: int) -> DataFrame:
    """doc_id, raw as ``_scored``, for a model too large to broadcast: the words of the texts meet the table by n-gram."""
    rows = cut(docs.select("doc_id", "text").withColumn("row", F.xxhash64("doc_id", "text")), "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, row in zip(batch.column(0), batch.column(1).to_pylist()):
                counts: dict[str, int] = {}
                for part in words_of(text.as_py()):
                    for w in part:
                        counts[w] = counts.get(w, 0) + 1
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(counts), pa.int64()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["row", "word", "n"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, key in zip(batch.column(0), batch.column(1).to_pylist()):
                grams = grams_of(w.as_py(), order)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(grams), pa.int64()), pa.array(grams, pa.string()), pa.array([g[:-1] for g in grams], pa.string())], names=["key", "gram", "context"])

    once = rows.dropDuplicates(["row"]).select("text", "row")
    words = cut(once.mapInArrow(run, "row long, word string, n long").select("row", "n", "word", F.xxhash64("word").alias("key")), "words")
    t = words.select("word", "key").distinct().mapInArrow(pieces, "key long, gram string, context string")
    t = t.join(values.select("gram", "value"), "gram", "left").join(values.select(F.col("gram").alias("context"), F.col("value").alias("other")), "context", "left")
    per_word = t.groupBy("key").agg(F.sum(F.coalesce("value", "other", F.lit(0.0))).alias("value"))
    per_row = words.select("row", "n", "key").join(per_word, "key").groupBy("row").agg((F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("raw"))
    return rows.join(per_row, "row", "left").select("doc_id", F.round(F.coalesce("raw", F.lit(0.0)), 9).alias("raw"))


def logistic(at: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of the curve through the counts at the places ``at``, by Newton steps; targets keep a step from 0 and 1, so clean cuts have a finite slope."""
    high, low = (toxic.sum() + 1) / (toxic.sum() + 2), 1 / (ordinary.sum() + 2)
    x = np.stack([at, np.ones(len(at))], 1)
    n = toxic + ordinary
    w = np.array([0.0, math.log((toxic.sum() + 1) / (ordinary.sum() + 1))])

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float(np.sum(n * np.logaddexp(0, z) - z * (toxic * high + ordinary * low)))

    now = loss(w)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        slope = x.T @ (n * p - toxic * high - ordinary * low)
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2)
        step, rate = np.linalg.solve(curve, slope), 1.0
        while rate > 1e-6 and loss(w - rate * step) > now:
            rate /= 2
        w, before, now = w - rate * step, now, loss(w - rate * step)
        if before - now < 1e-9:
            break
    return float(w[0]), float(w[1])


def held_out(doc_id: Column) -> Column:
    """The fold that teaches nothing: crc32 of the id as text modulo 5 is 0."""
    return fold(doc_id, 5) == 0


def _curve(raw: DataFrame, known: DataFrame) -> tuple[float, float]:
    """(slope, offset) from the labelled rows that gave no counts; from all of them where these are of one class."""
    place = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("raw") + BINS * BIN / 2) / BIN)))
    rows = raw.join(known, "doc_id").groupBy(place.alias("place"), "y", "calibrates").count().collect()

    def fitted(rows: list) -> tuple[float, float] | None:
        n = np.zeros((2, BINS))
        for r in rows:
            n[r.y, int(r.place)] += r["count"]
        some = n.sum(0) > 0
        if not n[0].sum() or not n[1].sum():
            return None
        return logistic((np.arange(BINS)[some] + 0.5) * BIN - BINS * BIN / 2, n[1][some], n[0][some])

    found = fitted([r for r in rows if r.calibrates]) or fitted(rows)
    if found:
        return found
    return 0.0, (30.0 if rows and all(r.y for r in rows) else -30.0)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, entries: int = MODEL_ENTRIES, order: int = ORDER, discount: float = DISCOUNT) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 if score >= threshold): one row for each row of ``docs``.

    Learns from rows of ``labels`` (doc_id, toxic) that are not held out: those
    with crc32(doc_id) % 5 = 1 fit the curve, the others give counts. Several
    labels of one document count by their mean (toxic above a half), null labels
    as none. Null, empty and blank texts and texts without a letter or digit are
    scored as a text of which nothing is known (mean 0). Repeated rows are scored alike; rows that
    share a doc_id have their own scores; null doc_ids are held out. Without a
    label all scores are about 0, with labels of one class about that class. Other
    columns are not read; an empty table gives none.
    """
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.avg("toxic") > 0.5).cast("int").alias("y"))
    known = cut(known.withColumn("calibrates", fold(F.col("doc_id"), 5) == 1), "labels")
    teach = known.filter("NOT calibrates").select("doc_id", "y")
    texts = near_keys(docs.select("doc_id", "text"), "doc_id", teach, "doc_id").join(teach.hint("merge"), "doc_id")
    grams = cut(gram_counts(texts, order), "grams")
    values = cut(ratios(grams, order, discount), "ratios")
    if values.count() <= entries:
        got = values.toArrow()
        raw = _scored(docs, Model(got.column("gram").to_pylist(), got.column("value").to_numpy(), order))
    else:
        raw = _joined(docs, values, order)
    raw = cut(raw, "scored")
    slope, offset = _curve(raw, known)
    score = F.round(1 / (1 + F.exp(-(F.col("raw") * slope + offset))), 6)
    rows = raw.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
