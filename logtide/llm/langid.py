"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams (1 to 3 characters) per language inside each
partition and sums the counts in Spark; the driver receives one number for each
language and bucket. The log-probability matrix is broadcast, and texts are
scored in numpy by adding up the matrix rows of the buckets that occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.llm.columns import field, numbered, quoted, row, without
from logtide.llm.store import cut

BUCKET_BITS = 15
MAX_LANGUAGES = 1000  # bound of the model: languages * 2^BUCKET_BITS numbers
_PIECE = 1 << 16  # characters worked on at once
_SLICE = 512
_FACTORS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
_letters: list[np.ndarray] = []


def _is_letter(codes: np.ndarray) -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0][codes]


def _pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Groups of (text number, buckets of its n-grams); a long text comes in several entries.

    Characters other than letters count as one and the same, and n-grams
    without a letter are left out.
    """
    at, found, size = [], [], 0
    for i, text in enumerate(texts):
        if not text:
            continue
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        for a in range(0, len(codes), _PIECE):
            c = codes[a : a + _PIECE + 2]  # two more: n-grams that start in this piece end there
            letter = _is_letter(c)
            c = np.where(letter, c, 32).astype(np.uint32)
            n = min(_PIECE, len(codes) - a)
            c = np.concatenate([c, np.full(max(0, n + 2 - len(c)), 32, np.uint32)])
            letter = c != 32
            h, any_letter = np.zeros(n, np.uint32), np.zeros(n, bool)
            for j in range(3):
                h = h * np.uint32(_FACTORS[2]) + c[j : n + j] * np.uint32(_FACTORS[0]) + np.uint32(j + 1)
                any_letter |= letter[j : n + j]
                at.append(i)
                found.append(((h * np.uint32(_FACTORS[1])) >> np.uint32(32 - BUCKET_BITS))[any_letter])
            size += n
            if size >= _PIECE:
                yield at, found
                at, found, size = [], [], 0
    if at:
        yield at, found


@dataclass
class Model:
    """languages, and for each bucket the log-probability in each of them (buckets x languages), and their log priors."""

    languages: list[str]
    log_p: np.ndarray
    prior: np.ndarray


def train(docs: DataFrame, smoothing: float = 0.5) -> Model:
    """Model of ``text`` by non-null ``lang``; rows without either teach nothing."""
    size = 1 << BUCKET_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, _SLICE):
                part = batch.slice(start, _SLICE)
                langs, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                for lang in langs:
                    rows[lang] = rows.get(lang, 0) + 1
                if len(rows) > MAX_LANGUAGES:
                    raise ValueError(f"more than {MAX_LANGUAGES} languages")
                for at, found in _pieces(texts):
                    by_lang: dict[str, list[np.ndarray]] = {}
                    for i, x in zip(at, found):
                        by_lang.setdefault(langs[i], []).append(x)
                    for lang, xs in by_lang.items():
                        one = np.bincount(np.concatenate(xs), minlength=size)
                        counts[lang] = counts[lang] + one if lang in counts else one
        for lang, n in rows.items():
            c = counts.get(lang, np.zeros(size, np.int64))
            seen = np.flatnonzero(c)
            names = pa.array([lang] * (len(seen) + 1), pa.string())
            yield pa.RecordBatch.from_arrays(
                [names, pa.array(np.append(seen, -1).astype(np.int32)), pa.array(np.append(c[seen], n).astype(np.int64))], names=["lang", "bucket", "n"]
            )

    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    sums = known.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    sums = cut(sums, "ngrams")
    n_languages = sums.filter("bucket < 0").count()  # checked before the counts come to the driver
    if n_languages > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    table = sums.toArrow()
    langs = table.column("lang").combine_chunks().dictionary_encode()
    languages = langs.dictionary.to_pylist()
    order = np.argsort(languages) if languages else np.zeros(0, int)
    place = np.empty(len(order), int)
    place[order] = np.arange(len(order))
    lang, bucket, n = langs.indices.to_numpy(), table.column("bucket").to_numpy(), table.column("n").to_numpy()
    counts, rows = np.zeros((size, len(languages))), np.zeros(len(languages))
    docs_row = bucket < 0
    rows[place[lang[docs_row]]] = n[docs_row]
    counts[bucket[~docs_row], place[lang[~docs_row]]] = n[~docs_row]
    log_p = np.log(counts + smoothing) - np.log(counts.sum(0) + smoothing * size)
    return Model([languages[i] for i in order], log_p.astype(np.float32), np.log(np.maximum(rows, 1) / max(rows.sum(), 1)))


def _posteriors(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    total = np.zeros((len(texts), len(model.languages)))
    seen = np.zeros(len(texts), bool)
    for at, found in _pieces(texts):
        keep = [(i, x) for i, x in zip(at, found) if len(x)]
        if not keep:
            continue
        rows = model.log_p[np.concatenate([x for _, x in keep])]
        starts = np.cumsum([0] + [len(x) for _, x in keep[:-1]])
        sums = np.add.reduceat(rows, starts, axis=0, dtype=np.float64)
        np.add.at(total, [i for i, _ in keep], sums)
        seen[[i for i, _ in keep]] = True
    if not model.languages:
        return ["und"] * len(texts), np.zeros(len(texts))
    total += model.prior
    best = total.argmax(1)
    score = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
    return [model.languages[b] if s else "und" for b, s in zip(best, seen)], np.where(seen, score, 0.0)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` plus ``lang_pred`` and ``score`` (posterior of the language given).

    ``und`` with score 0 where the text is null, empty or has no letter, and
    where the model knows no language. Ties go to the first language by code
    point. Texts of any length are read whole, in pieces. Columns named like
    the added ones are replaced.
    """
    docs = without(docs, "lang_pred", "score")
    names, at = docs.columns, docs.columns.index("text")
    docs = numbered(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _SLICE):
                part = batch.slice(start, _SLICE)
                found, scores = _posteriors(sent.value, part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string()), pa.array(scores)], names=[*part.schema.names, "lang_pred", "score"])

    schema = docs.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema
    return docs.mapInArrow(run, schema).toDF(*names, "lang_pred", "score")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text modulo ``folds``; null ids are in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def identify(docs: DataFrame) -> DataFrame:
    """``docs`` plus held_out, lang_pred, score; the model learns from the rows that are not held out (fold 2 of 4)."""
    docs = without(docs, "held_out")
    held = fold(F.col("doc_id"), 4) == 2
    model = train(docs.filter(~held))
    return predict(docs.withColumn("held_out", held), model)


def keep_identified(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose language is found with a posterior of ``least`` or more; ``lang`` stays as it is."""
    names = docs.columns
    rest = row(docs.select(*[quoted(c) for c in names if c not in ("doc_id", "text", "lang")])).alias("_rest")
    t = identify(docs.select("doc_id", "text", "lang", rest))
    t = t.filter((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return t.select(*[F.col(c) if c in ("doc_id", "text", "lang") else field("_rest", c) for c in names])
