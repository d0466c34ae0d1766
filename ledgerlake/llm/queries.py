"""The registered queries of these operators, thin digests over their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, compaction, fingerprints, jaccard, licenses, linededup, packing, quality, substring, warc
from .common import Scratch, input_bytes, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derivatives(warc.responses(table(spark, sf_dir, "pages")), ("page_id",))
    return made.select("page_id", "record_type", "record_id", "refers_to", "target_uri", "date", "source_payload_digest", "content_type", "block_digest", "content_length")


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "stratum")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    sim = jaccard.Similarity(percent=90, words=3)
    return jaccard.join_classes(table(spark, sf_dir, "documents"), sim).select("doc_id", "n_shingles", "component_id")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(table(spark, sf_dir, "documents"))


#: Arrivals that the documents are appended in, at least, and the bytes of the table for each: an arrival stays small at every scale.
ARRIVALS = 16
ARRIVAL_BYTES = 32 << 20


def arrivals(size: int) -> int:
    return max(ARRIVALS, -(-size // ARRIVAL_BYTES))


def op7_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = compaction.ShardStore(spark, Scratch(spark, "shards").path("store"))
    docs = table(spark, sf_dir, "documents")
    arrival = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(arrivals(input_bytes(docs)))).cast("int")
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars", arrival.alias("arrival"))
    store.append(docs, arrival)
    version = store.compact()
    return store.read_placed(version).select("doc_id", "arrival", "shard", F.lit(version).alias("version"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = linededup.dedup_lines(docs)
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_runs"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("matches")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
