"""A corpus made ready for training: quality rules, line dedup, near-dedup, decontamination, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the next
one.  All but the last return the columns of ``docs``; whole documents are dropped or kept, but for line dedup, which also
shortens texts (and sets ``n_chars``).  Rows with null or empty texts fail the quality rules; empty tables pass
through every stage as empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetledger.llm import benchmark_leaks, forced_boundary_bpe, line_neighbours, quality_ratio, simhash_variants
from fleetledger.llm.names import free_name
from fleetledger.session import shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and look like trusted ones."""
    model = quality_ratio.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(quality_ratio.judge(F.col("text"), model)["kept"])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand in an earlier one; those that lose some and keep no line of their own go."""
    told = free_name(docs, "_dedup")
    done = line_neighbours.with_own_lines(docs, into=told).drop(told)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: fingerprints of three-word shingles that differ in three bits at most."""
    return simhash_variants.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return benchmark_leaks.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, count and digest of the ids of every document left, and the digest of the text decoded from them."""
    done = forced_boundary_bpe.round_trip_column(F.col("text"), public_tokenizers.path("byte_bpe_50k.json"))
    return docs.select("doc_id", done.alias("_done")).select("doc_id", "_done.*")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("token_ids", token_ids),
]

#: SQL has no expression for the fitted rules, the fingerprints and the tokenizer; the tests hold the operator of each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, on the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        folder = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
