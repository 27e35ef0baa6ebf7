"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

Every stage reads whole texts, takes null texts for empty ones (they pass the first stage, are near copies of each other
in the second, hold nothing in the third, are never taken by the fourth) and keeps rows with a null doc_id. Repeated rows
leave one in the second stage. Columns besides those of the last stage stay as they are, whatever their names, and an
empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import mixing, packing, pii, simhash, toxicity
from corvane.llm.common import free_name, shared_folder, table
from corvane.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold of toxicity."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    column = free_name(docs, "_score")
    return toxicity.score(docs, model, column).where(f"{column} < {toxicity.THRESHOLD}").drop(column)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates."""
    return simhash.keep_one_of_each(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without personal data and the terms that disclose it."""
    return pii.sanitise(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenised documents with their places in sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_copies), ("pii", sanitise), ("mixing", mix), ("packing", pack)]

#: Learning, hashing with seeds and tokenising can't be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
