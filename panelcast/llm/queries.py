"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, chunk_dedup, exact_dedup, hyperminhash, importance, license_scan, line_dedup, lm_score, mixing, ngram_join, prefix_trie, quality, token_store
from .common import new_path, read


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.score_quality(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *(f"q.{x}" for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "base_failed", "kept")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read(spark, sf_dir, "documents"))


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.select(read(spark, sf_dir, "documents")).drop("uid")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(read(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table with each source as a host."""
    return line_dedup.drop_lines(read(spark, sf_dir, "documents").select("doc_id", "source", "text"), counts=True)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(spark, f"{sf_dir}/documents.parquet")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(read(spark, sf_dir, "documents"))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-store")
    token_store.write(read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_store.documents(spark, path)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.repeats(read(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.build(read(spark, sf_dir, "conversations"), graft=(20, 4))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.join(read(spark, sf_dir, "documents"), n=3, num=85, den=100)


QUERIES = {
    f.__name__: f
    for f in (
        op1_source_mix, op2_ngram_join, op3_line_dedup, op4_exact_dedup, op5_lm_score, op6_bpe_round_trip, op7_quality_rules, op8_license_scan, op9_token_store, op10_substring_dedup,
        op11_prefix_trie, op12_importance, op13_hyperminhash,
    )
}
