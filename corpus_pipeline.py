"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again for the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geneweft.llm import bpe, mixing, quality, secret_scan, trie_join
from geneweft.llm.labelled import remainder
from geneweft.llm.registry import stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality trees accept; fitted on the labels that the quality query learns from."""
    trees = quality.fit(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 3) != 1)
    return quality.accepted(docs, trees)


def join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return trie_join.one_of_each(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked."""
    return secret_scan.redacted(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought to their target weights; a document stands as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids of every document of the mix and of what they decode to."""
    return bpe.token_digests(docs, bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json")), keep=False)


STAGES = [
    ("quality", quality_stage),
    ("near_copies", join_stage),
    ("secrets", secret_stage),
    ("mix", mix_stage),
    ("tokens", token_stage),
]

#: The stages fit models, iterate and tokenize, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
