"""Multi-line records: continuation lines joined to the line that opened them.

A *head* line starts with a time stamp; every other line (stack frames,
wrapped messages, blank lines) belongs to the nearest head above it in the
same file. Lines before the first head of a file belong to no record: they
have record number 0 and stay single rows.

Line order must be known: ``read_logs(with_order=True)`` supplies
``line_order`` (file split start, position) and ``line_split`` (the split);
the event feed supplies its own. No window spans a whole file: lines and heads
are counted inside each (file, split), and what earlier splits hold comes from
a per-split table (one row per split), so a very large file is processed by as
many tasks as it has splits. Both uses of the counted lines read the same
columns, so the plan has one scan and one exchange of the lines. Record numbers
are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logtide.functions import parse as P
from logtide.sources import logs as S

RECORDS_COLUMNS = ["file_path", "record_no", "part", "ts", "log_level", "lines", "text"]


def number_records(logs: DataFrame, order: str = "line_order", split: str | None = "line_split") -> DataFrame:
    """Adds ``record_no`` (0 above the first head), ``line_no`` (from 1 in the file) and ``line_in_record``.

    ``line_in_record`` is 0 for a head; above the first head it is the place
    in the file (from 0).
    """
    names = logs.columns
    # In a struct, a null split is a key like any other: the join below needs no other partitions than the windows.
    df = logs.withColumn("_split", F.struct(F.col(split) if split else F.lit(0)))
    keys = ["file_path", "_split"]
    # One exchange for both uses of the lines; the second may then count them without a sort.
    df = df.withColumn("_head", (P.ts_text("value") != "").cast("bigint")).repartition(*keys)
    local = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_line", F.count(F.lit(1)).over(local)).withColumn("_heads", F.sum("_head").over(local))
    df = df.withColumn("_last", F.max(F.when(F.col("_head") == 1, F.col("_line"))).over(local))
    # ``_any`` makes this branch read all columns, so that it shares the exchange of the lines.
    splits = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_lines"),
        F.sum("_head").alias("_all_heads"),
        F.max("_last").alias("_last_head"),
        F.max(F.hash(*[F.col(c) for c in names if c != split])).alias("_any"),
    )
    earlier = Window.partitionBy("file_path").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_lines").over(earlier), F.lit(0)))
    splits = splits.select(
        F.col("file_path").alias("_file"),
        F.col("_split").alias("_part"),
        "_before",
        F.coalesce(F.sum("_all_heads").over(earlier), F.lit(0)).alias("_heads_before"),
        F.max(F.col("_before") + F.col("_last_head")).over(earlier).alias("_head_before"),
        "_any",
    )
    same = (F.col("file_path") == F.col("_file")) & (F.col("_split") == F.col("_part")) & F.col("_any").isNotNull()
    df = df.join(splits, same)
    line = F.col("_before") + F.col("_line")
    head = F.coalesce(F.col("_before") + F.col("_last"), F.col("_head_before"))
    return df.select(
        *names,
        F.col("_head").alias("is_head"),
        (F.col("_heads_before") + F.col("_heads")).alias("record_no"),
        line.alias("line_no"),
        (line - F.coalesce(head, F.lit(1))).alias("line_in_record"),
    )


def assemble_records(
    logs: DataFrame, order: str = "line_order", split: str | None = "line_split", max_lines: int | None = None
) -> DataFrame:
    """``file_path, record_no, part, ts, log_level, lines, text``, one row per record.

    ``text`` is the head line and its continuation lines joined by newlines,
    in file order; ``part`` is 0. Lines above the first head of a file are
    single rows: record 0, ``part`` their place in the file. With ``max_lines``,
    all records come in parts (0, 1, ...) of at most that many lines, so that no
    row grows with a record; ``ts`` and ``log_level`` are those of the part's first line.
    ``number_records`` gives the lines themselves with their record and place.
    """
    if max_lines is not None and max_lines < 1:
        raise ValueError("max_lines must be at least 1")
    n = number_records(logs.select("file_path", "value", order, *[split] * bool(split)), order, split)
    # Without ``max_lines`` no place in a record is read, so that only lines and heads are counted in the plan.
    inside = F.floor(F.col("line_in_record") / max_lines) if max_lines else F.lit(0)
    part = F.when(F.col("record_no") > 0, inside).otherwise(F.col("line_no") - 1)
    recs = (
        n.withColumn("part", part.cast("bigint"))
        .groupBy("file_path", "record_no", "part")
        .agg(
            F.array_sort(F.collect_list(F.struct(F.col("line_no").alias("o"), F.col("value").alias("v")))).alias("ls"),
            F.count(F.lit(1)).alias("lines"),
        )
    )
    first = F.col("ls")[0]["v"]
    return recs.select(
        "file_path",
        "record_no",
        "part",
        P.line_ts(first).alias("ts"),
        P.log_level(first).alias("log_level"),
        "lines",
        F.array_join(F.transform("ls", lambda x: x["v"]), "\n").alias("text"),
    )


def multiline_records(
    logs: DataFrame, order: str = "line_order", split: str | None = "line_split", max_lines: int | None = None
) -> DataFrame:
    """Only records that have continuation lines (e.g. exceptions with a stack trace)."""
    recs = assemble_records(logs, order, split, max_lines)
    return recs.filter((F.col("record_no") > 0) & ((F.col("lines") > 1) | (F.col("part") > 0)))


def records_of_texts(texts: DataFrame) -> DataFrame:
    """Records of whole files (``file_path, text, raw``), as ``assemble_records`` gives them: no line is shuffled."""
    chunks = F.split("text", "\n(?=" + P.TS_PATTERN.removeprefix("^") + ")", -1)
    t = texts.filter("text IS NOT NULL").select("file_path", "raw", chunks.alias("_chunks"))
    stamped = P.ts_text(F.col("_chunks")[0]) != ""
    above = F.when(~stamped, F.split(F.col("_chunks")[0], "\n", -1)).otherwise(F.array().cast("array<string>"))
    heads = F.when(stamped, F.col("_chunks")).otherwise(F.slice("_chunks", 2, F.size("_chunks")))

    def row(text, number, part, lines):
        return F.struct(number.cast("bigint").alias("record_no"), part.cast("bigint").alias("part"), lines.cast("bigint").alias("lines"), text.alias("text"))

    rows = F.concat(
        F.transform(above, lambda x, i: row(x, F.lit(0), i, F.lit(1))),
        F.transform(heads, lambda x, i: row(x, i + 1, F.lit(0), F.size(F.split(x, "\n", -1)))),
    )
    t = t.select("file_path", "raw", F.inline(rows))
    first = F.substring_index("text", "\n", 1)
    return t.select("file_path", "record_no", "part", P.line_ts(first).alias("ts"), P.log_level(first).alias("log_level"), "lines", S.unraw(F.col("text"), F.col("raw")).alias("text"))


def records_of(files: S.LogFiles, max_lines: int | None = None) -> DataFrame:
    """Records of a listed log tree; files read whole are cut into records where they are read, without a shuffle."""
    texts, lines = files.whole_texts(), files.split_lines()
    if max_lines is not None or texts is None:
        return assemble_records(files.lines(with_order=True), max_lines=max_lines)
    whole = records_of_texts(texts)
    return whole if lines is None else whole.unionByName(assemble_records(lines))


def read_records(
    spark: SparkSession, path: str | list[str], glob: str | None = "*.log", recursive: bool = True, max_lines: int | None = None, whole_bytes: int | None = None
) -> DataFrame:
    """Records of the log files under ``path`` (see ``assemble_records``; ``whole_bytes`` as in ``LogFiles``)."""
    return records_of(S.LogFiles(spark, path, glob, recursive, whole_bytes), max_lines)
