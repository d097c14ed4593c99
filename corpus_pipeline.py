"""The corpus pipeline: each stage applies one operator to what its predecessor kept.

Every stage but the last returns the columns of ``documents``; further columns pass through. Rows with nulls, empty texts and
repeated rows are treated as the operators' docstrings say, an empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lensfold.llm import byte_bpe, mixing, near_duplicates, quality, secrets
from lensfold.llm.common import own_name, small_batches, written

#: The mix: weights that repeat over the sources, words in all against words given, most repetitions, seed.
CYCLE, SHARE, MAX_EPOCHS, SEED = (3.0, 1.0, 2.0), 1.5, 2.0, 1


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    small_batches(spark)
    return quality.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8) the document with the smallest id stays."""
    small_batches(spark)
    return near_duplicates.one_of_each(docs, near_duplicates.classes(docs))


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become the names of their kinds; every document stays."""
    small_batches(spark)
    masked = docs.withColumn("text", secrets.mask("text"))
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    small_batches(spark)
    return mixing.mixed(docs, CYCLE, SHARE, MAX_EPOCHS, SEED)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, n_tokens, ids) of each row."""
    small_batches(spark)
    ids = byte_bpe.encode(F.coalesce("text", F.lit("")), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    own = own_name(docs, "ids")
    return docs.select("doc_id", "source", "lang", ids.alias(own)).select("doc_id", "source", "lang", F.size(own).cast("long").alias("n_tokens"), F.col(own).alias("ids"))


STAGES = [
    ("quality classifier", good_documents),
    ("near duplicates", without_near_copies),
    ("secret scans", secrets_masked),
    ("source mix", mixed_sources),
    ("byte-level BPE", encoded),
]
#: No SQL: a trained model, sketches and a tokenizer decide. Tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what a stage returns is written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *others, (_, last) = STAGES
    for name, stage in others:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return last(spark, docs, sf_dir)
