"""A cleaning pipeline over documents: each stage is one operator of the llm subpackage.

Each stage works on all rows that the one before kept. Nulls and repeated rows are treated as the operators' docstrings say;
an empty table passes through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import bpe, line_dedup, mixing, ngram_join, quality
from panelcast.llm.common import new_path, read, stage
from panelcast.session import reach_workers

#: Ids of dropped copies are broadcast up to so many (8 bytes each); beyond, they are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def own(docs: DataFrame) -> list[Column]:
    """The columns of the table, whatever their names."""
    return [F.col(f"`{c}`") for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_quality(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on too large a share of their source's documents go; the documents stay, with n_chars as it is now."""
    return line_dedup.drop_lines(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*own(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word Jaccard similarity of 0.8 or more, the one with the smallest id stays."""
    found = stage(ngram_join.join(docs, n=5, num=80, den=100).select("doc_id", "component_id"), "near-copies")
    copies = found.where("component_id <> doc_id").select("doc_id").distinct()
    kept = docs.join(F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies, "doc_id", "left_anti").select(*own(docs))
    twice = found.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.isEmpty():
        return kept
    # repeated rows of one id and text are one document
    return kept.join(twice, "doc_id", "left_anti").select(*own(docs)).union(kept.join(twice, "doc_id", "left_semi").select(*own(docs)).dropDuplicates(["doc_id", "text"]))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are drawn to their target weights; a document is there once for each epoch in which it is read."""
    return mixing.mix(docs)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids and their number, and the SHA-256 of the text that the ids decode to."""
    told = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return told.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "decoded_sha256")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources to target weights", source_mix),
    ("BPE encoding and decoding", bpe_encode),
]
#: The n-gram join's components, and what rests on them, have no SQL; tests hold each stage and run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written as Parquet to the shared folder and read again."""
    reach_workers(spark)
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        path = new_path(spark, name.replace(" ", "-"))
        step(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
