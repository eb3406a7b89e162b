"""Reading a tree of text log files.

``read_logs`` (or ``LogFiles`` to list a tree once and derive several
DataFrames) gives one row per line (``value``) with, from the scan's hidden
``_metadata`` column, the file it came from. Every file, small or large, goes
through the text source unless ``whole_bytes`` is given.
``_metadata.file_path`` is used rather than ``input_file_name()``: with it a
predicate on the path still reaches the scan, and file size and split start
come for free. It is the one spelling of a path in this library (a URI: a
space is ``%20``).

Container logs are often many small files. Scans pack them into
partitions; ``spark.sql.files.openCostInBytes`` (what opening a file counts
for) of about 128 KB packs them more densely than the 4 MB default. The text source
also sets up a record reader for each file, which takes longer than reading a
few kilobytes: with ``whole_bytes``, files up to that size are read as they are
and cut into lines by expressions. The rows are the same, byte for byte (a byte order mark,
``\\r``, ``\\r\\n``, bytes that are no UTF-8 and a missing last line break included), so
this changes no result, only the time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Names that the text source decompresses.
COMPRESSED = r"(?i)\.(gz|bz2|deflate|zst|lz4|snappy|br)$"
BYTE_ORDER_MARK = "X'EFBBBF'"


def _text_of(content: Column) -> Column:
    """``text`` and ``raw`` of a file's bytes: lines as the text source cuts them, joined by ``\\n``; null without a line.

    A line ends at ``\\r\\n``, ``\\r`` or ``\\n``, and after the last one there is
    none. Bytes that are no UTF-8 (``raw``) go through a one-byte character
    set; ``unraw`` turns parts of them back, so that they stay as they are.
    """
    body = F.when(F.substring(content, 1, 3) == F.expr(BYTE_ORDER_MARK), F.expr("substring(content, 4)")).otherwise(content)
    raw = ~F.is_valid_utf8(body.cast("string"))
    text = F.when(raw, F.decode(body, "ISO-8859-1")).otherwise(body.cast("string"))
    text = F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, r"\r\n|\r", "\n")).otherwise(text)
    text = F.when(F.length(body) > 0, F.regexp_replace(text, r"\n\z", ""))
    return F.struct(text.alias("text"), raw.alias("raw"))


def unraw(text: Column, raw: Column) -> Column:
    return F.when(raw, F.encode(text, "ISO-8859-1").cast("string")).otherwise(text)


def _columns(with_path: bool, with_size: bool) -> list[Column]:
    path, size = F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_size").alias("file_size")
    return [path] * with_path + [size] * with_size


class LogFiles:
    """A log tree, listed when this object is made; lines are derived from that listing.

    ``whole_bytes``: files up to this size that are not compressed are read
    whole, one row a file until it is cut into lines; None reads all files with the text source. The
    rows do not depend on it. Which files are which is decided by the listing,
    so each is opened once, and the tree is listed again only if some file is larger.
    """

    def __init__(
        self, spark: SparkSession, path: str | list[str], glob: str | None = "*.log", recursive: bool = True, whole_bytes: int | None = None
    ):
        def listed(kind: str) -> DataFrame:
            reader = spark.read.format(kind)
            if recursive:
                reader = reader.option("recursiveFileLookup", "true")
            if glob:
                reader = reader.option("pathGlobFilter", glob)
            return reader.load([path] if isinstance(path, str) else list(path))

        self._whole = self._text = None
        if whole_bytes is None:
            self._text = listed("text")
            return
        small = (F.col("_metadata.file_size") <= whole_bytes) & ~F.col("_metadata.file_path").rlike(COMPRESSED)
        every = listed("binaryFile")
        self._whole = every.filter(small)
        if every.filter(~small).rdd.getNumPartitions():  # planned from the listing; no job
            self._text = listed("text").filter(~small)

    def whole_texts(self) -> DataFrame | None:
        """``file_path, text, raw`` of the files read whole (see ``_text_of``); None if there are none to be."""
        if self._whole is None:
            return None
        texts = self._whole.select(F.col("_metadata.file_path").alias("file_path"), _text_of(F.col("content")).alias("_t"))
        return texts.select("file_path", "_t.text", "_t.raw")

    def split_lines(self) -> DataFrame | None:
        """Lines in order of the files that the text source reads; None if there are none."""
        return None if self._text is None else self._text_lines(True, False, True)

    def lines(self, with_path: bool = True, with_size: bool = False, with_order: bool = False) -> DataFrame:
        """``value`` plus, as asked, ``file_path``, ``file_size``, ``line_order`` and ``line_split``."""
        files = None
        if self._whole is not None:
            cut = F.posexplode(F.split("_t.text", "\n", -1)).alias("pos", "value")
            cols = _columns(with_path, with_size)
            files = self._whole.select(*cols, _text_of(F.col("content")).alias("_t")).select("*", cut)
            files = files.withColumn("value", unraw(F.col("value"), F.col("_t.raw"))).drop("_t")
            order = [F.struct(F.lit(0).cast("bigint").alias("block"), F.col("pos").cast("bigint").alias("pos")).alias("line_order"), F.lit(0).cast("bigint").alias("line_split")]
            files = files.select("value", *files.columns[: len(cols)], *(order if with_order else []))
        if self._text is None:
            return files
        text = self._text_lines(with_path, with_size, with_order)
        return text if files is None else files.unionByName(text)

    def _text_lines(self, with_path: bool, with_size: bool, with_order: bool) -> DataFrame:
        cols = _columns(with_path, with_size)
        if with_order:
            # Inside one split the id grows in read order; splits of one file
            # are ordered by their start offset.
            start = F.col("_metadata.file_block_start")
            cols.append(F.struct(start.alias("block"), F.monotonically_increasing_id().alias("pos")).alias("line_order"))
            cols.append(start.alias("line_split"))
        return self._text.select("value", *cols)


def read_logs(
    spark: SparkSession,
    path: str | list[str],
    glob: str | None = "*.log",
    recursive: bool = True,
    with_path: bool = True,
    with_size: bool = False,
    with_order: bool = False,
    whole_bytes: int | None = None,
) -> DataFrame:
    """Lines of all files under ``path`` whose name matches ``glob``.

    Columns: ``value`` and, as asked, ``file_path``, ``file_size`` (bytes of
    the file) and ``line_order`` / ``line_split`` (file order of the lines,
    for ``records.assemble_records``). ``glob`` keeps archives such as a
    ``.tar.gz`` next to the logs out of the scan; ``None`` reads every file
    (compressed ones are decompressed). ``whole_bytes`` as in ``LogFiles``: the
    same rows, faster where most files are small.
    """
    return LogFiles(spark, path, glob, recursive, whole_bytes).lines(with_path, with_size, with_order)


def with_file_path(df: DataFrame) -> DataFrame:
    """Adds ``file_path`` to a file-source DataFrame (from ``_metadata``)."""
    return df.withColumn("file_path", F.col("_metadata.file_path"))


def list_log_files(spark: SparkSession, path: str, glob: str = "*.log") -> DataFrame:
    """``file_path, file_size, modified`` of the files under ``path`` without reading them.

    The binary-file source lists files on the executors' side of the plan;
    selecting no ``content`` column means no file body is read.
    """
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(path)
        .select(
            F.col("_metadata.file_path").alias("file_path"),
            F.col("length").alias("file_size"),
            F.col("modificationTime").alias("modified"),
        )
    )
