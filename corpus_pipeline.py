"""Five stages from raw documents to token ids; each works on all that its predecessor kept.

quality: rows that the classifier rejects go. near-dedup: one document of each group stays. decontaminate: rows
that contain a benchmark item go. secrets: spans are replaced in the text. encode: byte-level BPE ids in place of
the text, beside the other columns and n_tokens.

Null or empty texts are judged as empty texts, are no copies of one another, hold nothing and have no token.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.llm import bpe, containment, nbsvm, near_dedup, secret_scan
from terravane.runtime import cut, discard


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nbsvm.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.kept_documents(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return containment.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redacted(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    more = [c for c in docs.columns if c not in ("doc_id", "text", "n_tokens", "ids")]
    return bpe.token_ids(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, more).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("quality", quality), ("near-dedup", near_duplicates), ("decontaminate", decontaminate), ("secrets", secrets), ("encode", encode)]

#: SQL can express neither the classifier nor the merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return docs
