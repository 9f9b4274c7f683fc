"""The registered query of each corpus operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import debruijn, embeddings, linededup, lzfingerprint, packing, quality, simhash, suffixarray, unigram
from .shared import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.count_tokens(table(spark, sf_dir, "documents"))


def op2_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixarray.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = debruijn.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", -1), "")
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.array_join(words, " ").cast("binary"), 256).alias("kept_sha256"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup(docs).select("doc_id", "n_lines", "n_removed", "text")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lzfingerprint.edited_likeness(table(spark, sf_dir, "documents"))
    sha = F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256")
    return out.select("doc_id", "n_chars", sha, "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op8_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's ids and what they decode to."""
    return unigram.encode(table(spark, sf_dir, "documents"), decoded=True).withColumn("n_ids", F.size("ids"))


def op9_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


#: Registered by name.
QUERIES = {f.__name__: f for f in (op1_token_counts, op2_lexical_packing, op3_suffix_array_dedup, op4_debruijn_dedup, op5_line_dedup, op6_simhash_near_dedup, op7_lz_fingerprints, op8_sentencepiece_codec, op9_quality_cnn, op10_embedding_near_dedup)}
