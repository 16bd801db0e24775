"""From raw documents to packed training sequences: five stages, each one operator.

Every stage takes ``(spark, docs, sf_dir)`` and is written as Parquet before the next one
reads it; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sceneframe.llm import exact_dedup, mixing, near_dedup, packing, quality
from sceneframe.llm.common import scratch


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects; without labels none is rejected.

    Null and empty texts are scored like any other; rows repeated stay or go alike.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, the one with the largest id; null counts as empty."""
    return exact_dedup.keep_winners(docs)


def distinct_contents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: five-word shingles, similarity 0.8 or more.

    The smallest id stays, rows without an id come last; texts without words are in no group.
    """
    return near_dedup.keep_representatives(docs, shingle_words=5, percent=80)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weights of their sources ask; a null source is one of its own."""
    return mixing.mixed_documents(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences of 4096 tokens.

    A document that the mixture repeats is packed as often; an empty text is its end token.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", distinct_texts),
    ("near dedup", distinct_contents),
    ("source mixing", mixed_sources),
    ("best-fit packing", packed_sequences),
]

#: Trained and hashed stages have no SQL form; tests/llm hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; the result of the last one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
