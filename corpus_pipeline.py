"""From raw documents to packed training sequences, in stages that are each written and read again.

 1. quality_rules: documents that a certified rule of their language rejects go.
 2. line_dedup: later copies of runs of three lines or more go; so does a text that lost all its lines that way.
 3. jaccard_join: of documents linked by a similarity of 0.8 or more of their five-word shingles the smallest id stays.
 4. substring_dedup: words in windows of 13 words that stand in a document of smaller id go; so does a text that lost all its words that way.
 5. packing: documents become pieces of sequences of at most 2048 tokens, written with their token ids.
All but the last return the columns of documents. A null text passes as a text that is empty, and fails stage 1 for its length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlake.llm import jaccard, linededup, packing, quality, substring
from ledgerlake.llm.common import Scratch, table
from ledgerlake.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_documents(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.dedup_documents(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.dedup_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]
ORACLE_SQL = None  # exact binomial tests, packing and tokens aren't SQL; a test holds run() against plain versions of the stages


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents."""
    scratch = Scratch(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
