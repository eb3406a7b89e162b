"""Periodic runs of words, by a dictionary of basic factors.

A run is a stretch of words whose smallest period q repeats at least ``REPEATS``
times, as long as it can be. For every power of two L, each stretch of L words
that occurs again in its text has a name (a pair of names of half the length).
An occurrence whose next one is q words on, L/2 < q <= L, proposes the period q.
Within a run of period q a stretch of L >= q words comes again after q words and
not before, so neighbouring occurrences with the same q (arithmetic progressions
of difference q that lie side by side) are the run: it goes from the first of
them to the end of the last one's successor. Each q belongs to one L, so no run
is found twice.

Names are compared, never hashed, and belong to one text; a stretch that does
not come again in its text has none, and nothing that contains it is looked at.
So the work is about n log n for n words however they repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logtide.llm.columns import numbered, without

REPEATS = 4
LEAST = 6
GROUP_WORDS = 1 << 18
_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def words_of(text: str | None) -> list[bytes]:
    """The words of a text: runs of characters other than space, tab, line feed, vertical tab, form feed, carriage return."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def runs_of(ids: np.ndarray, owner: np.ndarray, repeats: int = REPEATS, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs of many texts, one after the other, by start, then period.

    ``ids`` are numbers of words, ``owner`` the number of the text of each.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at = np.arange(len(ids), dtype=np.int64)
    key = owner.astype(np.int64) * (int(ids.max(initial=0)) + 1) + ids
    size = 1
    while len(at):
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        same = ordered[1:] == ordered[:-1]
        again = np.zeros(len(at), bool)
        again[:-1] |= same
        again[1:] |= same
        where = at[order]
        step = np.where(same, np.diff(where), 0)
        near = (step > size // 2) & (step <= size)
        first, q = where[:-1][near], step[near]
        if len(first):
            by = np.argsort(first, kind="stable")
            first, q = first[by], q[by]
            head = np.flatnonzero(np.append(True, (np.diff(first) != 1) | (np.diff(q) != 0)))
            tail = np.append(head[1:], len(first)) - 1
            start, period = first[head], q[head]
            length = first[tail] - start + period + size
            good = length >= np.maximum(least, repeats * period)
            found.append((start[good], length[good], period[good]))
        # Names of what occurs again, by place; then pairs of neighbours.
        name = np.full(len(ids) + 1, -1, np.int64)
        number = np.cumsum(np.append(True, ~same)) - 1
        name[where[again]] = number[again]
        at = np.flatnonzero(name[:-1] >= 0)
        other = name[np.minimum(at + size, len(ids))]
        at, other = at[other >= 0], other[other >= 0]
        key = name[at] * (int(number[-1]) + 1) + other
        size *= 2
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    start, length, period = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _numbered(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, owner) of the words of some texts."""
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for ws in words for w in ws), np.int64)
    return ids, np.repeat(np.arange(len(words)), [len(ws) for ws in words])


def kept_words(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of n words stay when each run keeps its first period only."""
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, start + period, 1)
    np.add.at(cover, start + length, -1)
    return np.cumsum(cover[:-1]) == 0


def _described(words: list[list[bytes]], repeats: int, least: int) -> Iterator[tuple[np.ndarray, str]]:
    """(runs: a row of start, length, period each; collapsed text) of each text."""
    ids, owner = _numbered(words)
    start, length, period = runs_of(ids, owner, repeats, least)
    keep = kept_words(len(ids), start, length, period) if len(start) else None
    base = np.cumsum([0, *map(len, words)])
    bounds = np.searchsorted(start, base)
    for k, ws in enumerate(words):
        mine = slice(bounds[k], bounds[k + 1])
        left = ws
        if bounds[k + 1] > bounds[k]:
            left = [ws[i] for i in np.flatnonzero(keep[base[k] : base[k + 1]]).tolist()]
        yield np.stack([start[mine] - base[k], length[mine], period[mine]], 1), b" ".join(left).decode("utf-8", "surrogatepass")


def periodic_runs(docs: DataFrame, text: str = "text", repeats: int = REPEATS, least: int = LEAST) -> DataFrame:
    """``docs`` plus ``runs``: array of (start, length, period) by start, then period, and ``collapsed``.

    A run is a stretch of consecutive words with smallest period q and a length
    of at least ``least`` and ``repeats`` * q (2 repeats or more would need
    longer successors, so ``repeats`` is 3 or more) that no neighbouring word
    extends. ``collapsed`` joins by one space the words that no run contains
    after its first q words. Null, empty and blank texts have no runs and an
    empty collapsed text. Repeated rows have the same result. Whole texts, of any
    length, are worked on one or more at a time (about ``GROUP_WORDS`` words).
    Columns named ``runs`` or ``collapsed``, in any case, are replaced; the
    others are returned as they are. An empty table gives none.
    """
    if repeats < 3:
        raise ValueError("repeats must be 3 or more")
    t = without(docs, "runs", "collapsed")
    names, at = t.columns, t.columns.index(text)
    t = numbered(t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            while done < batch.num_rows:
                words, size, upto = [], 0, done
                while upto < batch.num_rows and size < GROUP_WORDS:
                    words.append(words_of(batch.column(at)[upto].as_py()))
                    size += len(words[-1])
                    upto += 1
                runs, texts = zip(*_described(words, repeats, least))
                flat = np.concatenate(runs)
                offsets = np.cumsum([0, *map(len, runs)]).astype(np.int32)
                fields = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], names=["start", "length", "period"])
                part = batch.slice(done, upto - done)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(offsets, fields), pa.array(texts, pa.string())], names=[*part.schema.names, "runs", "collapsed"])
                done = upto

    schema = T.StructType([*t.schema.fields, T.StructField("runs", T._parse_datatype_string(_RUNS)), T.StructField("collapsed", T.StringType())])
    return t.mapInArrow(run, schema).toDF(*names, "runs", "collapsed")


def _number(name: str) -> str:
    return f"crc32(cast({name} AS string))"


def replanted(docs: DataFrame) -> DataFrame:
    """doc_id, text: ``docs`` with periodic stretches of known shape in every tenth text.

    With h = crc32 of the decimal doc_id and g = floor(h / 10), a text of n > 0
    words whose h ends in 0 has each word i from a = g % n on replaced by its
    word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)), words joined by one
    space. Other texts, and those without a doc_id, stay as they are.
    """
    t = docs.select("doc_id", "text", F.expr(f"{_number('doc_id')} % 10 = 0 AND text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'").alias("_hit"))
    words = "regexp_extract_all(text, '[^\\\\x20\\\\x09-\\\\x0D]+', 0)"
    t = t.withColumn("_words", F.expr(f"CASE WHEN _hit THEN {words} END")).withColumn("_g", F.expr(f"{_number('doc_id')} DIV 10"))
    t = t.withColumn("_a", F.expr("cast(_g % size(_words) AS int)")).withColumn("_p", F.expr("cast(1 + (size(_words) - _a) DIV (3 + _g % 8) AS int)"))
    edited = "array_join(transform(_words, (w, i) -> if(i < _a, w, element_at(_words, cast(1 + _a + (i - _a) % _p AS int)))), ' ')"
    return t.select("doc_id", F.expr(f"CASE WHEN _hit THEN {edited} ELSE text END").alias("text"))


def run_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period; nulls without one) and digests of the runs and of what is left."""
    best = "array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))"
    listed = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')"
    t = found.select("doc_id", "runs", "collapsed", F.expr(best).alias("_best"))
    return t.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.expr("-_best.start").alias("start"), F.col("_best.length").alias("length"), F.expr("-_best.period").alias("period"),
        F.expr("1000 * _best.length DIV -_best.period").alias("exponent_milli"), F.expr(f"sha2({listed}, 256)").alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
