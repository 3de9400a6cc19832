"""A training-data pipeline of five stages: from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir), works on all rows it is given, and returns a DataFrame that is
written as Parquet and read again as the next one's input. All but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import decontamination, packing, pii, rules, simhash
from recordloom.llm.queries import vocabulary
from recordloom.llm.tables import free_name, own_columns, read


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep."""
    return rules.keep_good(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least doc_id, of each group of near-duplicates: five-word shingles, similarity 0.8."""
    return simhash.drop_near_duplicates(docs, shingle=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of ten words of a benchmark item occurs."""
    hit = free_name(docs, "hit")
    own = {c: free_name(docs, f"{c}_kept") for c in docs.columns if c in ("n_words", "n_hit", "items")}
    found = decontamination.find_benchmark(docs.withColumnsRenamed(own), read(spark, sf_dir, "benchmark"), width=10)
    clean = found.withColumn(hit, F.col("n_hit") > 0).drop("n_words", "n_hit", "items").withColumnsRenamed({v: k for k, v in own.items()})
    return clean.filter(~F.col(hit)).select(*own_columns(docs))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows the text where there is one."""
    masked = pii.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(*own_columns(docs)) if "n_chars" in docs.columns else masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents with their places in sequences of at most 1024 tokens."""
    return packing.pack(docs, *vocabulary(), capacity=1024, end_id=2).drop("ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("pii", mask_personal_data),
    ("packing", pack),
]

#: Learned rules, fingerprints and tokens have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written and read again as the next one's input."""
    from recordloom.llm.tables import checkpointed

    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
