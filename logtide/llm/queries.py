"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.llm import bpe, fingerprints, idfiles, jaccard, langid, licenses, lines, mixing, oracle, periods, quality, search, toxicity, whitening
from logtide.llm.store import cut, ship

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(_documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", "text")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = cut(mixing.sized(_documents(spark, sf_dir)).select("doc_id", "source", "size"), "sizes")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "quota")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(_documents(spark, sf_dir), labels)


def op4_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return idfiles.tokenize_to_files(_documents(spark, sf_dir), path, end_id=0, encode_special_tokens=False)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_documents(spark, sf_dir))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_and_decode(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(_documents(spark, sf_dir), null_ids=True)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(_documents(spark, sf_dir))


def op9_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search.top_k(vectors, F.col("vec_id") % 50 == 0, k=5, scale=256)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang")
    return langid.identify(docs).select("doc_id", "held_out", "lang_pred", "score")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.classify(_documents(spark, sf_dir), labels)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.run_digest(periods.periodic_runs(periods.replanted(_documents(spark, sf_dir))))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _shipped(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    every = {
        "op1_line_dedup": op1_line_dedup,
        "op2_mixing": op2_mixing,
        "op3_quality": op3_quality,
        "op4_id_files": op4_id_files,
        "op5_license_scan": op5_license_scan,
        "op6_byte_bpe": op6_byte_bpe,
        "op7_jaccard_join": op7_jaccard_join,
        "op8_fingerprints": op8_fingerprints,
        "op9_exact_search": op9_exact_search,
        "op10_language_id": op10_language_id,
        "op11_toxicity": op11_toxicity,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_whitening": op13_whitening,
    }
    return {name: _shipped(query) for name, query in every.items()}


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
