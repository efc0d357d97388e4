"""A corpus cleaned in stages, each written as parquet and read again by the next.

Quality rules, one document of each near-duplicate group, repeated strings cut out, documents with
test items removed, and the token ids of what is left. All stages but the last return the columns of
`documents`. Every stage handles nulls, empty and very long texts, repeated rows and empty tables as
its operator states.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pipekit.llm import bpe, decontaminate, quality_rules, simhash, suffix_dedup
from pipekit.llm.queries import configured
from pipekit.session import fresh_path

# The stages use suffix arrays, fingerprints and token ids, which SQL cannot express.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.keep_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group whose fingerprints link (3 words, 2 bits)."""
    return simhash.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings of 200 bytes that stand elsewhere too; n_chars follows."""
    return suffix_dedup.drop_repeats(docs, length="n_chars")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without words of a test item's window."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids, their number, and whether they decode to the text."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = docs.select(F.struct("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text")).alias("own"), "text")
    done = bpe.round_trip(rows, ranks, public_tokenizers.PATTERN, key="own")
    return done.select(
        "own.doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        (F.sha2("decoded", 256) == F.col("own.text")).alias("round_trip"),
    )


STAGES = [
    ("quality_rules", quality),
    ("simhash", near_duplicates),
    ("suffix_dedup", repeats),
    ("decontamination", decontamination),
    ("byte_bpe", tokens),
]
STAGES = [(name, configured(stage)) for name, stage in STAGES]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
