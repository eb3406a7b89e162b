"""Line dedup: later copies of repeated line runs are deleted.

The corpus is the sequence of its non-blank lines, documents in doc_id order,
each document ended by a separator of its own (no run crosses documents). A
run of lines with ``min_words`` words or more that occurs earlier in the corpus
is a later copy, and its lines go.

Steps, DataFrame operations only:

1. ``line_table``: lines of each document as 128-bit hashes with word counts.
2. ``repeated_positions``: a line that occurs once ends every repeated run, so
   only positions of repeated lines enter the suffix array. Line ids are the
   ranks of the distinct repeated lines.
3. ``windows``: at each position the shortest run of ``min_words`` words that
   starts there, and the shortest that ends there.
4. Prefix doubling: rank of the 2^(k+1) lines at a position = rank of the pair
   (rank of its first 2^k lines, rank of the next 2^k), by a range-partitioned
   sort of the *distinct* pairs. Pairs that occur once are finished and leave.
   A round only keeps stretches that still hold a run of that many lines, so
   the number of rounds is at most log2(min_words).
5. LCP intervals: all suffixes that share the first m lines are one interval of
   depth m, named by the ranks of its first and last 2^k lines (2^k <= m <
   2^(k+1), overlapping). The smallest position in an interval is the
   original, all others are later copies.
6. Overlapping copies of one stretch add up to its maximal repeated run: each
   line of a maximal run of ``min_words`` words lies in the shortest run that
   starts at it, or in the shortest run that ends where the maximal run ends.
   So the union is exactly the later copies of all maximal repeated runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtide.llm.mixing import WORD
from logtide.llm.columns import field, quoted, without
from logtide.llm.order import dense_ids, ordered_ids
from logtide.llm.store import cut, drop

#: A position is document number * 2^27 + line number.
LINE_BITS = 27


def line_table(docs: DataFrame) -> DataFrame:
    """doc_no, doc_id, _hash, _copy, lines: array of (pos, a, b, words) of the non-blank lines."""
    lines = F.transform(
        F.split("text", "\n", -1),
        lambda x, i: F.struct(
            i.alias("pos"), F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), F.regexp_count(x, F.lit(WORD)).alias("words")
        ),
    )
    lines = F.filter(lines, lambda x: x.words > 0)
    t = docs.filter("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("_hash"), lines.alias("lines"))
    t = t.groupBy("doc_id", "_hash").agg(F.first("lines").alias("lines"), F.count("*").alias("_n"))
    copies = F.sequence(F.lit(0), F.least(F.col("_n") - 1, F.lit(1)).cast("int"))
    t = t.filter(F.size("lines") > 0).withColumn("_copy", F.explode(copies)).drop("_n")
    return dense_ids(t, [F.col("doc_id").asc_nulls_last(), F.col("_hash"), F.col("_copy")], "doc_no")


def repeated_positions(table: DataFrame) -> DataFrame:
    """doc_no, ord (place among the non-blank lines), pos, words, rank: positions of lines that occur twice or more."""
    at = table.select("doc_no", F.posexplode("lines").alias("ord", "line")).select("doc_no", "ord", "line.*")
    names = at.groupBy("a", "b").agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    names = ordered_ids(names, [F.col("a"), F.col("b")], "rank")
    return at.join(names, ["a", "b"]).drop("a", "b")


def windows(positions: DataFrame, min_words: int) -> tuple[DataFrame, DataFrame]:
    """(positions with their stretch and the longest window in it, windows as doc_no, first, m).

    Both frames hold at most ``min_words`` rows: each line has a word or more.
    """
    doc = Window.partitionBy("doc_no").orderBy("ord")
    t = positions.withColumn("stretch", F.col("ord") - F.row_number().over(doc))
    run = Window.partitionBy("doc_no", "stretch")
    t = t.withColumn("upto", F.sum("words").over(run.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)))
    t = t.withColumn("before", F.col("upto") - F.col("words"))
    ahead = run.orderBy("before").rangeBetween(0, min_words - 1)
    back = run.orderBy("upto").rangeBetween(-(min_words - 1), 0)
    t = t.withColumn("m_ahead", F.when(F.sum("words").over(ahead) >= min_words, F.count("*").over(ahead)))
    t = t.withColumn("m_back", F.when(F.sum("words").over(back) >= min_words, F.count("*").over(back)))
    t = t.withColumn("longest", F.max(F.greatest("m_ahead", "m_back")).over(run)).filter("longest IS NOT NULL")
    t = cut(t.drop("words", "upto", "before"), "positions")
    both = F.array(
        F.struct(F.col("ord").alias("first"), F.col("m_ahead").alias("m")),
        F.struct((F.col("ord") - F.col("m_back") + 1).alias("first"), F.col("m_back").alias("m")),
    )
    found = t.select("doc_no", F.explode(F.array_distinct(F.filter(both, lambda x: x.m.isNotNull()))).alias("w"))
    found = found.select("doc_no", F.col("w.first").cast("int").alias("first"), F.col("w.m").cast("int").alias("m")).distinct()
    return t, cut(found, "windows")


def _doubled(ranks: DataFrame, k: int) -> DataFrame:
    """Ranks of 2^(k+1) lines from ranks of 2^k lines; positions whose lines occur once are gone."""
    run = Window.partitionBy("doc_no", "stretch").orderBy("ord").rangeBetween(2**k, 2**k)
    pairs = ranks.filter(F.col("longest") >= 2 ** (k + 1)).withColumn("next", F.max("rank").over(run))
    pairs = cut(pairs.filter("next IS NOT NULL"), f"pairs{k}")
    names = pairs.groupBy("rank", "next").agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    names = ordered_ids(names, [F.col("rank"), F.col("next")], "_new")
    out = cut(pairs.join(names, ["rank", "next"]).drop("rank", "next").withColumnRenamed("_new", "rank"), f"ranks{k}")
    drop(pairs, names)
    return out


def _position(doc_no: Column, line: Column) -> Column:
    return F.shiftleft(doc_no, LINE_BITS) + line


def _intervals(ranks: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Windows of 2^k to 2^(k+1) - 1 lines with the name of their LCP interval."""
    at = ranks.select("doc_no", F.col("ord").cast("int").alias("ord"), "rank")
    some = found.filter((F.col("m") >= 2**k) & (F.col("m") < 2 ** (k + 1)))
    some = some.join(at.select("doc_no", F.col("ord").alias("first"), F.col("rank").alias("head")), ["doc_no", "first"])
    if k:
        some = some.withColumn("ord", F.col("first") + F.col("m") - 2**k)
        some = some.join(at.withColumnRenamed("rank", "tail"), ["doc_no", "ord"]).drop("ord")
    else:
        some = some.withColumn("tail", F.col("head"))
    return some.select("doc_no", "first", "m", F.lit(k).alias("k"), "head", "tail")


def copied_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """doc_id, _hash, _copy, gone: line numbers (from 0, ascending) of later copies, documents that have any."""
    table = line_table(docs)
    ranks, found = windows(repeated_positions(table), min_words)
    positions = ranks
    deepest = found.agg(F.max("m")).first()[0] or 0
    named, k = [], 0
    while deepest >= 2**k:
        named.append(_intervals(ranks, found, k))
        k += 1
        if deepest >= 2**k:
            ranks = _doubled(ranks, k - 1)
    if not named:
        return table.select("doc_id", "_hash", "_copy", F.array().cast("array<int>").alias("gone")).limit(0)
    every = named[0]
    for part in named[1:]:
        every = every.unionAll(part)
    # The same m lines start all suffixes of an interval, so m is part of its name.
    name = ["k", "m", "head", "tail"]
    every = cut(every.withColumn("at", _position(F.col("doc_no"), F.col("first"))), "intervals")
    firsts = every.groupBy(*name).agg(F.min("at").alias("original"), F.count("*").alias("_n")).filter("_n > 1")
    later = every.join(firsts, name).filter("at > original")
    later = later.groupBy("doc_no", F.col("first").alias("ord")).agg(F.max(F.col("first") + F.col("m")).alias("end"))
    doc = Window.partitionBy("doc_no").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    covered = positions.select("doc_no", F.col("ord").cast("int").alias("ord"), "pos").join(later, ["doc_no", "ord"], "left")
    covered = covered.withColumn("end", F.max("end").over(doc)).filter("ord < end")
    gone = covered.groupBy("doc_no").agg(F.sort_array(F.collect_list("pos")).alias("gone"))
    return table.select("doc_no", "doc_id", "_hash", "_copy").join(gone, "doc_no").drop("doc_no")


def dedup_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """``docs`` with later copies of repeated line runs deleted from ``text``.

    Adds ``n_lines`` (lines of the text, split at line feeds), ``n_removed``
    (lines deleted) and ``n_left`` (non-blank lines left). Lines match when they
    are equal, character by character. Blank lines take no part in runs and stay; of a text
    that loses all its other lines nothing is left (empty text). A null text
    stays null with 0 lines, an empty text stays empty. "Earlier" goes by
    doc_id (null last), then text hash, and by line in a document; an earlier
    occurrence may overlap. The first occurrence of a line always stays. Of
    repeated rows (same doc_id and text) one counts as the first. Other
    columns are kept; columns named like the added ones, in any case, are replaced.
    """
    names = without(docs, "n_lines", "n_removed", "n_left").columns
    # Rows are told apart by doc_id, text hash and the number among equal rows (0, then 1 for all others).
    key = ["_id", "_null", "_hash"]
    keys = [F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_null")]
    rest = [F.struct(*[quoted(c) for c in names if c not in ("doc_id", "text")]).alias("_rest")] if len(names) > 2 else []
    rows = docs.select("doc_id", "text", *rest, *keys, F.xxhash64("text").alias("_hash"))
    rows = rows.withColumn("_number", F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0))))
    gone = copied_lines(docs, min_words).select(*keys, "_hash", "_copy", "gone")
    # One row a document, so that the join needs no other partitioning than the numbering.
    gone = gone.groupBy(*key).agg(*[F.first(F.when(F.col("_copy") == i, F.col("gone")), True).alias(f"_gone{i}") for i in (0, 1)])
    t = rows.join(gone, key, "left").withColumn("_gone", F.when(F.col("_number") == 1, F.col("_gone0")).otherwise(F.col("_gone1")))
    lines = F.split("text", "\n", -1)
    # One character for each line up to the last one deleted: 1 deleted, 0 kept.
    before = lambda i: F.when(i > 0, F.col("_gone")[i - 1]).otherwise(-1)
    marks = F.transform("_gone", lambda x, i: F.concat(F.repeat(F.lit("0"), x - before(i) - 1), F.lit("1")))
    t = t.withColumn("_marks", F.split(F.array_join(marks, ""), ""))
    kept = F.filter(lines, lambda x, i: F.coalesce(F.get("_marks", i), F.lit("0")) != "1")
    t = t.withColumn("_kept", F.when(F.col("_gone").isNotNull(), kept).otherwise(lines))
    t = t.withColumn("_left", F.coalesce(F.when(F.col("text").isNotNull(), F.size(F.filter("_kept", lambda x: x.rlike(WORD)))), F.lit(0)))
    new = F.when(F.col("_gone").isNull(), F.col("text")).when(F.col("_left") == 0, "").otherwise(F.array_join("_kept", "\n"))
    return t.select(
        *[new.alias(c) if c == "text" else F.col(c) if c == "doc_id" else field("_rest", c) for c in names],
        F.coalesce(F.when(F.col("text").isNotNull(), F.size(lines)), F.lit(0)).alias("n_lines"),
        F.coalesce(F.when(F.col("_gone").isNotNull(), F.size("_gone")), F.lit(0)).alias("n_removed"),
        F.col("_left").alias("n_left"),
    )
