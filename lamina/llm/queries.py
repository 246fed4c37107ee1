"""Queries of the training-data operators, with the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, byte_bpe, exact_topk, language_id, line_dedup, sharding, simhash, source_mix, substring_dedup, url_filter

VOCABULARY, PIECES = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(_read(spark, sf_dir, "pages"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.exact_topk(_read(spark, sf_dir, "embeddings"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    return byte_bpe.encode_digests(_read(spark, sf_dir, "documents"), vocabularies.path(VOCABULARY), vocabularies.PATTERN)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    docs = _read(spark, sf_dir, "documents")
    model = language_id.fit(docs, vocabularies.path(PIECES), where=~language_id.held_out(F.col("doc_id")))
    found = language_id.identify(docs, model)
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.passage_dedup(_read(spark, sf_dir, "documents"))
    kept = F.coalesce(F.sha2("kept_text", 256), "words_sha256")
    return found.select("doc_id", "n_words", "n_removed", kept.alias("kept_sha256"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_read(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_read(spark, sf_dir, "embeddings"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_sources(_read(spark, sf_dir, "documents")).drop("rate")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(_read(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (
        op1_url_filter,
        op2_exact_topk,
        op3_byte_bpe,
        op4_language_id,
        op5_substring_dedup,
        op6_sharding,
        op7_simhash,
        op8_ann,
        op9_source_mixing,
        op10_line_dedup,
    )
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": url_filter.oracle_sql(),
        "op2_exact_topk": exact_topk.oracle_sql(),
        "op9_source_mixing": source_mix.oracle_sql(),
        "op10_line_dedup": line_dedup.oracle_sql(),
    }
