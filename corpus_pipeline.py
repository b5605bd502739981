"""The corpus pipeline: rejects, near copies, secrets, mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs.  All but the last return the columns of
documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shardflow.llm import bpe, mixing, near_dedup, quality, secrets
from shardflow.llm.common import deleted, documents, shared_folder, tidy
from shardflow.llm.queries import BPE_RANKS, held_out


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are scored like any other; equal texts have equal scores; without
    labels of both kinds every document stays.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality.score(docs, quality.fit(docs, labels.where(~held_out())), keep=True)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id.

    Texts without words, and rows without doc_id, are in no group; of several rows with one
    doc_id one stays.
    """
    return near_dedup.dedup(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays, null texts as null."""
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; at a source's cut, its leading words.

    Texts without words are taken by no mix; a null source is a source of its own; equal
    rows are taken together.
    """
    return mixing.mixed(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of what they decode to; none for null and empty texts."""
    return bpe.encoded_documents(docs, BPE_RANKS, public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: SQL can express neither the classifier nor the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  A stage's folder goes when the next one has been written."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        with tidy(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            deleted(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
