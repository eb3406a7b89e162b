"""Bottom-k sketches of shingle hashes as document fingerprints.

The sketch of a text is the ``k`` smallest distinct hashes (63 bits) of its
word shingles, ascending. Sketches of parts merge into the sketch of the whole,
and give resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtide.llm.columns import numbered, without
from logtide.llm.hashing import shingle_hashes, word_hashes

K = 128
SHINGLE = 5
_SLICE = 256  # rows turned into Python strings at once


def sketches(texts: list[str | None], k: int = K, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sketch (int64, ascending) of each text; null is empty."""
    out = []
    for _, words in word_hashes(texts):
        x = (shingle_hashes(words, shingle) >> np.uint64(1)).astype(np.int64)
        if len(x) > 8 * k:  # most hashes of a long text are far above the k-th
            near = np.unique(x[x <= np.partition(x, 4 * k)[4 * k]])
            x = near if len(near) >= k else x
        out.append(np.unique(x)[:k])
    return out


def merged(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of the union of the two sets."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity; exact where both sets have fewer than k shingles. Two empty sets are alike."""
    both = np.union1d(a, b)
    if not len(both):
        return 1.0
    if len(a) >= k or len(b) >= k:
        both = both[:k]
    shared = np.intersect1d(a, b, assume_unique=True)
    return float(np.searchsorted(shared, both[-1], "right") / len(both))


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / 2.0**63)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b holds too; 1 for an empty a."""
    if not len(a):
        return 1.0
    r = resemblance(a, b, k)
    return min(1.0, r / (1 + r) * (distinct(a, k) + distinct(b, k)) / distinct(a, k))


def _coded(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<i8").tobytes()).decode()


def decoded(fingerprint: str) -> np.ndarray:
    """The sketch in a fingerprint string."""
    return np.frombuffer(base64.b64decode(fingerprint), "<i8")


def fingerprint(docs: DataFrame, text: str = "text", k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` plus ``sketch``: array<long>, the sketch of ``text`` (null: empty). A column ``sketch`` is replaced."""
    docs = without(docs, "sketch")
    names, at_text = docs.columns, docs.columns.index(text)
    docs = numbered(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                found = pa.array(sketches(part.column(at_text).to_pylist(), k, shingle), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*part.schema.names, "sketch"])

    schema = docs.withColumn("sketch", F.lit(None).cast("array<bigint>")).schema
    return docs.mapInArrow(run, schema).toDF(*names, "sketch")


def merge_fingerprints(parts: DataFrame, key: str, k: int = K) -> DataFrame:
    """key, sketch: the sketches of all parts of a key merged.

    Distinct hashes first, then the k smallest of a key; Spark keeps only k
    candidates of a key in each task before the shuffle, so a hot key is no
    one's burden.
    """
    hashes = parts.select(key, F.explode_outer("sketch").alias("_h")).distinct()
    first = Window.partitionBy(key).orderBy(F.col("_h").asc_nulls_last())
    kept = hashes.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= k)
    return kept.groupBy(key).agg(F.sort_array(F.collect_list("_h")).alias("sketch"))


def _ranges(docs: DataFrame, n: int) -> list[int]:
    """At most n - 1 doc_ids, ascending, below the largest one, that cut the ids into like parts."""
    shares = F.array(*[F.lit(i / n) for i in range(1, n)]) if n > 1 else F.array(F.lit(0.5))
    cuts, most = docs.agg(F.percentile_approx("doc_id", shares, F.lit(max(10_000, 20 * n))), F.max("doc_id")).first()
    return [] if n < 2 else sorted({x for x in cuts or [] if x < most})


def with_next(docs: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow(run)`` over ``docs`` (doc_id, text) in descending doc_id order.

    Each partition is a range of ids, sorted (null ids last, ties by text
    hash), ended by the document that follows its last one, with ``_extra`` =
    true; the one after the very last is the very first. So each text is
    shuffled once, and one document a range twice. The driver holds one id a
    range.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("_hash"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = spark.sparkContext.broadcast(np.array(_ranges(docs, n), np.int64))
    most, alone = docs.agg(F.max("doc_id"), F.min("_hash")).first()

    @F.pandas_udf("array<struct<part:int,extra:boolean>>")
    def parts(ids):
        own = np.searchsorted(cuts.value, ids.fillna(np.iinfo(np.int64).min).to_numpy(np.int64), "left")
        top = ids.isin(cuts.value).to_numpy()  # the first of its range follows the last of the range above
        return ids.__class__([[(int(p), False), (int(p) + 1, True)] if t else [(int(p), False)] for p, t in zip(own, top)])

    first = (F.col("doc_id") == F.lit(most)) if most is not None else F.col("doc_id").isNull() & (F.col("_hash") == F.lit(alone))
    wrap = F.array(F.struct(F.lit(0).alias("part"), F.lit(True).alias("extra")))
    to = F.when(F.coalesce(first, F.lit(False)), F.concat("_own", wrap)).otherwise(F.col("_own"))
    rows = docs.withColumn("_own", parts("doc_id")).withColumn("_to", F.explode(to))
    rows = rows.select("doc_id", "text", "_hash", F.col("_to.part").alias("_part"), F.col("_to.extra").alias("_extra"))
    rows = rows.repartitionById(len(cuts.value) + 1, "_part")
    rows = rows.sortWithinPartitions("_part", "_extra", F.col("doc_id").desc_nulls_last(), "_hash")
    return rows.select("doc_id", "text", "_part", "_extra").mapInArrow(run, schema)


EDIT_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def edited_pairs(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Fingerprints of each document and of its text with the second half taken from the next document.

    The next document has the next smaller doc_id (null ids come last, equal
    ids go by text hash; after the last comes the first). Null texts are empty;
    two empty texts resemble each other fully, an empty and another not at all.
    Repeated rows each give a row.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        """[doc_id, text, sketch, part, extra] in order."""
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                ids, texts, places, extras = (part.column(i).to_pylist() for i in range(4))
                texts = [t or "" for t in texts]
                yield from map(list, zip(ids, texts, sketches(texts, k, shingle), places, extras))

    def emit(pairs: list[tuple[list, list]]) -> pa.RecordBatch:
        edits = []
        for a, b in pairs:
            half = len(a[1]) // 2
            edits.append(a[1][: len(a[1]) - half] + b[1][:half])
        marks = sketches(edits, k, shingle)
        cols = [
            pa.array([a[0] for a, _ in pairs], pa.int64()),
            pa.array([len(a[1]) for a, _ in pairs], pa.int64()),
            [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edits],
            [_coded(a[2]) for a, _ in pairs],
            [_coded(m) for m in marks],
            [resemblance(a[2], m, k) for (a, _), m in zip(pairs, marks)],
            [resemblance(a[2], b[2], k) for a, b in pairs],
        ]
        return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, list) else c for c in cols], names=[c.split()[0] for c in EDIT_SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pairs, size = None, [], 0
        for row in rows(batches):
            if held is not None and row[3] == held[3]:
                pairs.append((held, row))
                size += len(held[1])
            held = None if row[4] else row
            if size >= 1 << 20 or len(pairs) >= _SLICE:
                yield emit(pairs)
                pairs, size = [], 0
        if pairs:
            yield emit(pairs)

    return with_next(docs, run, EDIT_SCHEMA)
