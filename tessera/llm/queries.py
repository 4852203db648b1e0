"""The registered queries of this package, each with production parameters over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import fingerprints, kd_clusters, line_dedup, mixing, packing, pii, prefix_trie, quality, secret_scan, simhash, suffix_dedup, token_counts, token_files
from tessera.llm._common import documents, new_path


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(documents(spark, sf_dir))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", F.sha2("clean_text", 256).alias("kept_sha256"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(documents(spark, sf_dir).select("doc_id", "text"), spark.conf.get("spark.tessera.surrogate.key", "a key for tests"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_report(documents(spark, sf_dir))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "source", F.col("n_copies").cast("long").alias("n_copies"), F.col("copy").cast("long").alias("copy"), "shuffle_key")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(documents(spark, sf_dir), words=51).select(*suffix_dedup.figures(), *suffix_dedup.passage_figures(), suffix_dedup.clean_text())


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark)
    token_files.write_token_files(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_kd_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_clusters.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_packing, op3_quality_rules, op4_line_dedup, op5_pii, op6_fingerprints, op7_mixing, op8_simhash, op9_token_counts, op10_suffix_dedup, op11_prefix_trie, op12_token_files, op13_kd_clusters)}
ORACLE: dict[str, str] = {"op3_quality_rules": quality.QUALITY_ORACLE, "op4_line_dedup": line_dedup.LINE_ORACLE, "op7_mixing": mixing.MIX_ORACLE}
