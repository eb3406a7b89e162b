"""The corpus pipeline: documents in, token ids of the mixed corpus out.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of ``documents``.

1. ``language_id``: documents without a letter, or whose best language has a
   posterior below 0.3, go (a word of two letters may fit several languages).
2. ``line_dedup``: later copies of repeated line runs are deleted; a document
   that loses its last line with it goes.
3. ``ngram_jaccard``: one document of each class of near duplicates stays;
   different texts that share a doc_id are documents of their own.
4. ``mixing``: documents are taken, cut or repeated so that the sources come to
   their target sizes.
5. ``byte_bpe``: byte-level BPE ids of what was taken, and their decoding.

Null texts go in the first stage. Empty tables pass through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.llm import bpe, jaccard, langid, lines, mixing
from logtide.llm.columns import field, row, without
from logtide.llm.store import new_path, ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return langid.keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    packed = docs.select("doc_id", "text", row(without(docs, "text")).alias("_row"))
    t = lines.dedup_lines(packed).filter("n_removed = 0 OR n_left > 0")
    made = {"text": F.col("text"), "n_chars": F.length("text").cast("long").alias("n_chars")}
    return t.select(*[made.get(c, field("_row", c)) for c in docs.columns])


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return jaccard.keep_one_text(docs, null_ids=True)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return bpe.encode_and_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("mixing", mixing_stage),
    ("byte_bpe", byte_bpe),
]

#: Language ID and BPE have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
