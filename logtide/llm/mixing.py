"""Mixing sources to target weights by Sainte-Lague apportionment.

Each source gets a target in words (``targets``). The targets are turned into
integer quotas of equal-size blocks by highest quotients, first among the
sources, then among the shards of each source (``apportion``). A shard lays its
documents end to end in a seeded order, cuts that stream into blocks and takes
as many from its start as its quota says, going round a second time where the
quota is above one pass (``mix``).

Nothing is one task's work: sources and shards are tables, ranks come from a
range-partitioned sort, and a hot source has as many shards as its rows need.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtide.llm.columns import field, quoted, without
from logtide.llm.order import dense_ids
from logtide.llm.store import cut

WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` plus ``size``: words of ``text`` (null or empty: 0)."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0)))


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """``sources`` (source, source_size) plus ``source_no`` and ``target``.

    Sources in code point order, null last, weigh ``weights`` in turn and
    share ``share`` times the sum of all sizes. A target stops at ``cap``
    times its source's size; the excess is shared again by weight until none
    is above. The loop reads one aggregate row a turn.
    """
    if not 0 < share < cap:
        raise ValueError("share must be above 0 and below cap")
    t = dense_ids(sources, [F.col("source").asc_nulls_last()], "source_no")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    t = cut(t.withColumn("weight", weight.cast("long")), "sources")
    most = F.lit(float(cap)) * F.col("source_size")
    rate, full = 0.0, -1
    while True:
        at_cap = most <= F.lit(rate) * F.col("weight")
        total, held, free, n = t.agg(
            F.sum("source_size"),
            F.sum(F.when(at_cap, F.col("source_size"))),
            F.sum(F.when(~at_cap, F.col("weight"))),
            F.count_if(at_cap),
        ).first()
        if n == full or not free:
            break
        rate, full = (share * total - cap * (held or 0)) / free, n
    return t.withColumn("target", F.least(most, F.lit(float(rate)) * F.col("weight")))


def apportion(members: DataFrame, group: str, key: str, weight: str, seats: str) -> DataFrame:
    """``members`` plus ``quota``: the Sainte-Lague seats of each of a group.

    ``seats`` (the same on all rows of a group) are given to the highest
    quotients weight / (2 k + 1), ties to the smaller ``key``. Starting from
    the rounded proportional share, at most half as many seats as there are
    members are still open (or given too often), so only the quotients next to
    that share are ranked: a few rows a member, in one range-partitioned sort.
    Members without weight get none.
    """
    sums = members.groupBy(group).agg(F.sum(weight).alias("_all"), F.count("*").alias("_n"))
    w, q0 = F.col(weight).cast("double"), F.col("_q0")
    t = members.join(sums, group).withColumn(
        "_q0", F.when(F.col("_all") > 0, F.floor(F.col(seats) * w / F.col("_all") + 0.5)).otherwise(0)
    )
    t = cut(t, "shares")
    open_ = t.groupBy(group).agg((F.first(seats) - F.sum("_q0")).alias("_open"))
    t = t.join(open_, group)
    # So many steps are enough for each member, see the divisor method: the divisor that gives
    # _n / 2 + |_open| seats more than asked for moves each share by no more than this.
    steps = F.ceil((F.abs("_open") + F.col("_n") / 2) * w / F.col("_all")) + 1
    more = t.filter((F.col("_open") != 0) & (w > 0)).select(
        group, key, weight, "_open", "_q0", F.explode(F.sequence(F.lit(0).cast("long"), steps)).alias("_k")
    )
    up = F.col("_open") > 0
    quotient = F.when(up, w / (2 * (q0 + F.col("_k")) + 1)).otherwise(w / (2 * (q0 - F.col("_k")) - 1))
    more = more.filter(up | (q0 - F.col("_k") >= 1)).withColumn("_quotient", quotient)
    # Seats are added from the highest quotient down, taken away from the lowest up.
    ranked = dense_ids(
        more, [F.col(group), F.when(up, -F.col("_quotient")).otherwise(F.col("_quotient")), F.when(up, F.col(key)).otherwise(-F.col(key)), F.col("_k")], "_rank"
    )
    first = ranked.groupBy(group).agg(F.min("_rank").alias("_first"))
    moved = (
        ranked.join(first, group)
        .filter(F.col("_rank") - F.col("_first") < F.abs("_open"))
        .groupBy(group, key)
        .agg(F.sum(F.signum("_open")).cast("long").alias("_moved"))
    )
    return (
        t.join(moved, [group, key], "left")
        .withColumn("quota", F.col("_q0") + F.coalesce("_moved", F.lit(0)))
        .drop("_all", "_n", "_q0", "_open", "_moved")
    )


def _drawn(seed: int) -> Column:
    """A seeded number for each doc_id, as hexadecimal text."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    block_words: int = 16,
    shard_docs: int = 512,
    seed: int = 17,
) -> DataFrame:
    """``docs`` (source, doc_id, size and any others) plus what the mix takes.

    Adds ``source_size``, ``target`` (words, of the document's source),
    ``quota`` (blocks of its shard) and ``taken`` (words of this document, in
    whole passes first, then from its start; repeats counted; never above
    ``cap`` times its size). The same rows give the same mix in any
    partitioning. Null sources are a source of their own, the last one; null
    doc_ids are ordinary ids; a document without words takes part with 0;
    repeated rows are documents of their own (which of two equal rows comes
    first makes no difference to the rows returned); an empty table gives an
    empty result. Columns named like the added ones are replaced.
    """
    own = ["source_size", "target", "quota", "taken"]
    names = without(docs, *own).columns
    others = [c for c in names if c not in ("doc_id", "source", "size")]
    docs = docs.select("doc_id", "source", "size", *[F.struct(*map(quoted, others)).alias("_others")] * bool(others))
    sources = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_docs"))
    sources = targets(sources, weights, share, cap)
    seats = sources.agg(F.sum("target")).first()[0] or 0.0
    sources = apportion(
        sources.withColumn("_one", F.col("source_no") * 0).withColumn("_seats", F.lit(math.floor(seats / block_words + 0.5)).cast("long")),
        "_one", "source_no", "target", "_seats",
    ).select("source", "source_no", "source_size", "target", "_docs", F.col("quota").alias("_source_quota"))
    sources = cut(sources, "quotas")

    shards = F.ceil(F.col("_docs") / shard_docs)
    placed = (
        docs.withColumnRenamed("source", "_source")
        .join(sources.withColumnRenamed("source", "_other"), F.col("_source").eqNullSafe(F.col("_other")))
        .drop("_other")
        .withColumnRenamed("_source", "source")
        .withColumn("_draw", _drawn(seed))
        .withColumn("_shard", F.conv(F.substring(_drawn(seed + 1), 1, 8), 16, 10).cast("long") % shards)
    )
    sizes = placed.groupBy("source_no", "_shard").agg(
        F.sum("size").alias("_shard_size"), F.first("_source_quota").alias("_source_quota")
    )
    quotas = apportion(sizes, "source_no", "_shard", "_shard_size", "_source_quota").select(
        "source_no", "_shard", "_shard_size", "quota"
    )
    stream = Window.partitionBy("source_no", "_shard").orderBy("_draw", "doc_id", "size")
    before = F.coalesce(F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    words = F.least(F.col("quota") * block_words, F.floor(F.lit(cap) * F.col("_shard_size")))
    passes = F.when(F.col("_shard_size") > 0, F.floor(words / F.col("_shard_size"))).otherwise(0)
    rest = words - passes * F.col("_shard_size")
    taken = passes * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_before")))
    t = placed.withColumn("_before", before).join(quotas, ["source_no", "_shard"]).withColumn("taken", taken.cast("long"))
    return t.select(*[field("_others", c) if c in others else F.col(c) for c in names], *own)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, one row for each pass taken.

    A document of which the mix takes a part is cut after the last word taken
    (white space between the words stays); one of which it takes nothing is
    left out. ``n_chars``, if there, is the length of the text given.
    """
    names = docs.columns
    rest = F.struct(*[quoted(n) for n in names if n != "text"]).alias("_rest")
    t = mix(sized(docs.select("doc_id", "source", "text", rest)), **options).filter("taken > 0")
    n = F.col("size")
    passes = F.sequence(F.lit(0), F.ceil(F.col("taken") / n).cast("int") - 1)
    t = t.withColumn("_words", F.explode(F.transform(passes, lambda i: F.least(n, F.col("taken") - i * n))))
    pieces = F.regexp_extract_all("text", F.lit(r"([\x20\x09-\x0D]*" + WORD + ")"), F.lit(1))
    begin = F.array_join(F.slice(pieces, 1, F.col("_words").cast("int")), "")
    t = t.withColumn("text", F.when(F.col("_words") == n, F.col("text")).otherwise(begin))
    made = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return t.select(*[made[c].alias(c) if c in made else field("_rest", c) for c in names])
