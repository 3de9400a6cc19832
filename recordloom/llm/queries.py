"""The dealt operators as queries over the synthetic tables: (spark, folder) -> DataFrame, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clustering, conversations, language, minhash, oracle, pii, quality, rules
from .decontamination import contamination
from .packing import pack
from .recompression import remove_repeated_windows
from .sharding import shard_by_bytes
from .simhash import near_duplicates
from .suffix_index import remove_repeated_bytes
from .tables import read

#: Vocabulary of the packing query, by name of the public tokenizers package.
VOCABULARY = ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")


def vocabulary() -> tuple[str, str, str]:
    """Tokenizer file, rank file of the same vocabulary, and its pattern."""
    return (*(public_tokenizers.path(name) for name in VOCABULARY), public_tokenizers.PATTERN)


def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(read(spark, folder, "documents"), *vocabulary(), capacity=1024, end_id=2).drop("ids")


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeated_windows(read(spark, folder, "documents"), width=13).drop("kept")


def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(read(spark, folder, "documents"))


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination(read(spark, folder, "documents"), read(spark, folder, "benchmark"), width=10)


def op5_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(read(spark, folder, "documents"), bits=4, shingle=4, seed=42)


def op6_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeated_bytes(read(spark, folder, "documents"), width=50).drop("kept")


def _fold(parts: int, held: int):
    """Whether crc32 of the doc_id's digits leaves this remainder; null ids are not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == held, F.lit(False))


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text", "lang", _fold(4, 2).alias("held_out"))
    coder = language.train(docs.filter(~F.col("held_out")))
    return language.identify(docs.drop("lang"), coder)


def op8_histogram_sharding(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    rows = docs.select("doc_id", "text", F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"))
    placed = shard_by_bytes(rows, shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return rules.judge(read(spark, folder, "documents"), read(spark, folder, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text", _fold(5, 0).alias("held_out"))
    marks = read(spark, folder, "labels").filter(~_fold(5, 0))
    scored = quality.score(docs, quality.train(docs, marks))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op11_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    found = clustering.cluster(read(spark, folder, "embeddings").select("vec_id", "embedding"), size=64, scale=1024, k=8, rounds=10, salt="3:")
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ",").cast("binary"), 256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def op12_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, folder, "documents"), shingle=2, similarity=0.8)


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    found = conversations.repair(conversations.damaged(read(spark, folder, "conversations")))
    return found.select("conv_id", *conversations.COUNTS, "audit", F.sha2(F.col("repaired").cast("binary"), 256).alias("repaired_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_substring_dedup, op3_pii, op4_decontamination, op5_simhash_near_dedup, op6_suffix_array_dedup,
        op7_language_id, op8_histogram_sharding, op9_quality_rules, op10_quality_classifier,
        op11_centroid_clustering, op12_minhash_near_dedup, op13_conversation_repair,
    )
}

SQL: dict[str, str] = {"op2_substring_dedup": oracle.OP2, "op4_decontamination": oracle.OP4, "op6_suffix_array_dedup": oracle.OP6, "op11_centroid_clustering": oracle.OP11, "op12_minhash_near_dedup": oracle.OP12, "op13_conversation_repair": oracle.OP13}
