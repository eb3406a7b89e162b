"""Log-level distribution: counts, summary, sample and related line counts.

Input everywhere is a log DataFrame with a ``value`` column (one line per
row) and, where the file matters, ``file_path``; ``read_logs`` and the test
feed both give that shape.

Plan shape: every count here is one scan with map-side partial aggregation.
``level_totals`` is a single global aggregate (one partial row per map task);
counts, summary and report are projections of its one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtide.functions import parse as P


def level_histogram(logs: DataFrame, mode: str = "substring") -> DataFrame:
    """``log_level, n``: lines per level, ``""`` for lines without a level.

    At most five rows (a grouping by level).
    """
    return logs.groupBy(P.log_level("value", mode).alias("log_level")).agg(F.count(F.lit(1)).alias("n"))


def level_totals(logs: DataFrame, mode: str = "substring") -> DataFrame:
    """One row: ``total_lines`` and one count column per level (``n_INFO`` ...).

    A single global aggregate: the level is extracted once per line and
    counted conditionally, map tasks ship one partial row each. Counts,
    summary and report are all projections of this row, so one scan serves
    them and absent levels are zero by construction.
    """
    lvl = F.col("log_level")
    return logs.select(P.log_level("value", mode).alias("log_level")).agg(
        F.count(F.lit(1)).alias("total_lines"),
        *[F.count_if(lvl == name).alias(f"n_{name}") for name in P.LEVELS],
    )


def _level_rows(totals: DataFrame) -> DataFrame:
    """The totals row unpivoted: ``log_level, count, fixed_rank, total_lines, valid_lines``."""
    valid = sum((F.col(f"n_{name}") for name in P.LEVELS), F.lit(0))
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("log_level"), F.col(f"n_{name}").alias("count"), F.lit(i).alias("fixed_rank"))
            for i, name in enumerate(P.LEVELS, start=1)
        ]
    )
    return totals.select("total_lines", valid.alias("valid_lines"), F.inline(rows))


def _share(n: Column, valid: Column) -> Column:
    # Percent of lines *with* a level; 0 when there is none.
    return F.when(valid > 0, n / valid * 100.0).otherwise(F.lit(0.0))


def level_counts(
    logs: DataFrame | None = None,
    mode: str = "substring",
    zero_fill: bool = True,
    order: str = "fixed",
    totals: DataFrame | None = None,
) -> DataFrame:
    """``log_level, count, pct, rank``.

    ``zero_fill=True``: all four levels in the fixed order INFO, WARN, ERROR,
    DEBUG, with a 0 row for an absent level (the cluster report).
    ``zero_fill=False, order="count"``: only levels seen, most frequent first,
    ties by name (the local report). ``pct`` is the share of lines that have
    a level. ``totals`` (from ``level_totals``) may be passed instead of ``logs``.
    """
    t = totals if totals is not None else level_totals(logs, mode)
    rows = _level_rows(t)
    if not zero_fill:
        rows = rows.filter(F.col("count") > 0)
    if order == "fixed":
        rank = F.col("fixed_rank")
    elif order == "count":
        # At most four rows: a window without partition is one tiny task.
        rank = F.row_number().over(Window.orderBy(F.desc("count"), "log_level"))
    else:
        raise ValueError(f"order must be 'fixed' or 'count', not {order!r}")
    return rows.select(
        "log_level",
        F.col("count").cast("bigint").alias("count"),
        _share(F.col("count"), F.col("valid_lines")).alias("pct"),
        rank.cast("int").alias("rank"),
    ).orderBy("rank")


def level_summary(
    logs: DataFrame | None = None, mode: str = "substring", totals: DataFrame | None = None
) -> DataFrame:
    """One row: ``total_lines, valid_lines, unique_levels``.

    A line without level still counts in ``total_lines``.
    """
    t = totals if totals is not None else level_totals(logs, mode)
    counts = [F.col(f"n_{name}") for name in P.LEVELS]
    return t.select(
        F.col("total_lines").cast("bigint").alias("total_lines"),
        sum(counts, F.lit(0)).cast("bigint").alias("valid_lines"),
        sum((F.when(c > 0, 1).otherwise(0) for c in counts), F.lit(0)).cast("bigint").alias("unique_levels"),
    )


def level_rows(logs: DataFrame, mode: str = "substring") -> DataFrame:
    """Lines that carry a level: ``log_level, timestamp, log_entry`` (+ ``file_path``)."""
    cols = P.parse_line("value", mode)
    if "file_path" in logs.columns:
        cols.append(F.col("file_path"))
    return logs.select(*cols).filter(F.col("log_level") != "")


def level_sample(
    logs: DataFrame, n: int = 10, seed: int = 42, method: str = "hash", mode: str = "substring"
) -> DataFrame:
    """``n`` random lines with a level: ``log_entry, log_level``.

    Lines with a time stamp are sampled when at least one exists, otherwise
    all level lines. Both cases come from one top-k (no second job): rows
    are ordered by (has time stamp desc, random key); among the first ``n``,
    only rows of the best class are kept, which is the top-``n`` of lines with
    a time stamp whenever one exists.

    ``method="hash"`` orders by ``md5("<seed>:<file_path>:<line>")``: the same
    sample on any partitioning. ``method="rand"`` orders by ``rand(seed)``:
    varies with partitioning, as in a plain ``orderBy(rand)``.
    """
    rows = level_rows(logs, mode)
    if method == "hash":
        path = F.col("file_path") if "file_path" in rows.columns else F.lit("")
        key = F.md5(F.concat_ws(":", F.lit(str(seed)), path, F.col("log_entry")))
    elif method == "rand":
        key = F.rand(seed)
    else:
        raise ValueError(f"method must be 'hash' or 'rand', not {method!r}")
    has_ts = (F.col("timestamp") != "").alias("has_ts")
    top = rows.select("log_entry", "log_level", has_ts, key.alias("k")).orderBy(
        F.desc("has_ts"), "k"
    ).limit(n)
    # ``top`` holds at most n rows: a single-partition window over it is fine.
    best = F.max(F.col("has_ts").cast("int")).over(Window.partitionBy())
    return (
        top.withColumn("best", best)
        .filter(F.col("has_ts").cast("int") == F.col("best"))
        .orderBy("k")
        .select("log_entry", "log_level")
    )


def level_occurrences(logs: DataFrame) -> DataFrame:
    """``log_level, occurrences``: every level word in every line, not only the first."""
    return (
        logs.select(F.explode(F.regexp_extract_all("value", F.lit(P.LEVEL_PATTERN), 1)).alias("log_level"))
        .groupBy("log_level")
        .agg(F.count(F.lit(1)).alias("occurrences"))
    )


def component_counts(logs: DataFrame, top: int | None = 20) -> DataFrame:
    """``component, entries``: lines per logger, most frequent first (ties by name).

    ``top`` keeps the k largest (a top-k report); ``None`` keeps all.
    """
    out = (
        logs.select(P.component("value").alias("component"))
        .filter(F.col("component") != "")
        .groupBy("component")
        .agg(F.count(F.lit(1)).alias("entries"))
        .orderBy(F.desc("entries"), "component")
    )
    return out.limit(top) if top is not None else out


def parse_quality(logs: DataFrame) -> DataFrame:
    """One row: lines in total and lines lacking a time stamp, a level, a component."""
    v = F.col("value")
    return logs.agg(
        F.count(F.lit(1)).alias("total_lines"),
        F.count_if(P.ts_text(v) == "").alias("no_timestamp"),
        F.count_if(P.log_level(v) == "").alias("no_level"),
        F.count_if(P.component(v) == "").alias("no_component"),
        F.count_if(F.trim(v) == "").alias("blank_lines"),
    )


def lines_containing(logs: DataFrame, word: str = "ERROR") -> DataFrame:
    """Lines whose text contains ``word`` (``grep``), with their file."""
    cols = ["file_path", "value"] if "file_path" in logs.columns else ["value"]
    return logs.filter(F.col("value").contains(word)).select(*cols)
