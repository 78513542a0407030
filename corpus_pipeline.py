"""From raw documents to token ids: quality rules, near-duplicate groups, benchmark decontamination, masking of personal data,
SentencePiece encoding. Each stage works on all rows that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vestigia.llm import decontaminate, near_dups, personal_data, pieces, quality_rules
from vestigia.llm.common import stored, table

TOKENIZER = "piece_bpe_32k.model"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the decision list rejects."""
    return quality_rules.good_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of documents that share at least 80 percent of their shingles."""
    return near_dups.distinct_documents(docs, 80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold benchmark passages."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts."""
    return personal_data.masked(docs, personal_data.train(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the token ids and the text decoded from them."""
    return pieces.with_pieces(docs, pieces.vocabulary(TOKENIZER))


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mask_personal_data", mask_personal_data),
    ("encode", encode),
]
ORACLE_SQL = None  # the learned list and the span classifier have no SQL form; tests hold run() against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
