"""Corpus pipeline: quality rules, toxicity, near-duplicates, mixing, tokens. Each stage calls one operator of voltlane.llm.

Every stage gets all documents that the one before kept and hands on those it keeps, with the columns of `documents`;
the last adds nothing to a document's identity but its tokens and its position in the mix and drops its text. Stages are written as Parquet in the
shared folder and read again, so a lost executor repeats one stage at most.

Stages that hand whole texts to Python do so in small batches: the setting holds for the session from then on.

Rows with null, empty or blank text are rejected by the first stage, as they have fewer than ten words. Extra columns
are not handed on. An empty table gives an empty table at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlane.llm import bpe, minhash_dedup, mixing, quality_rules, toxicity
from voltlane.llm.common import DOCUMENT_COLUMNS, Stages, small_batches, table

#: A document is toxic from this score on.
TOXIC = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep (operator 1)."""
    return quality_rules.keep_quality(docs.select(*DOCUMENT_COLUMNS))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not score as toxic (operator 7), by the lexicon learned from the labelled documents."""
    small_batches(spark)
    scored, score = toxicity.score_toxicity(docs.select(*DOCUMENT_COLUMNS), toxicity.learned(spark, sf_dir))
    return scored.where(F.col(score) < TOXIC).select(*DOCUMENT_COLUMNS)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (operator 10), the one with the smallest id."""
    small_batches(spark)
    return minhash_dedup.keep_one(docs.select(*DOCUMENT_COLUMNS))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of training that gives every source its target share (operator 2).

    The order is that of the written files and of the rows in them.
    """
    return mixing.in_mixed_order(docs.select(*DOCUMENT_COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count, digest of the ids and digest of the decoded text of every document (operator 6), with its position in the order of training."""
    small_batches(spark)
    placed, position = mixing.with_written_position(docs)
    return bpe.digests(placed.select("doc_id", "text", "lang", "source", position))


STAGES = [
    ("quality_rules", quality),
    ("toxicity", clean),
    ("minhash_dedup", distinct),
    ("mix_sources", mixed),
    ("bpe", tokens),
]
#: Toxicity, near-duplicates and tokens have no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = Stages(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stages(stage(spark, docs, sf_dir), name)
    return docs
