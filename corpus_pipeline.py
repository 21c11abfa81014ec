"""The corpus pipeline: documents to sharded training data, one operator a stage.

Each stage's result is written as Parquet and read again as the next one's documents, so a lost executor costs one stage's
tasks at most. The written stages stay in the shared folder, which is the caller's to clear.

Defined results of every stage: rows are told apart by their contents, never by id alone; a null text has no words (quality
rules reject it; the later stages keep it, the mix takes it zero times); a null id or source is a value like others; texts of
any length are judged whole; repeated rows are near copies of each other, of which one stays; an empty table gives an empty
table; further columns, whatever their names, are kept but by the last stage, which returns the digest of the ring.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from assetflow.llm import decontaminate, jaccard_join, mixing, quality, sharding
from assetflow.llm.common import shared_dir, table
from assetflow.llm.queries import MIX_CYCLE, MIX_EPOCHS, MIX_SHARE, SHARDS


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, on hosts that aren't rejected."""
    return quality.kept_documents(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest id, null last, and of its rows the smallest text checksum."""
    return jaccard_join.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs, MIX_CYCLE, MIX_SHARE, MIX_EPOCHS)


def ring_sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each row of the mix."""
    return sharding.assign_shards(docs, SHARDS)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("ring_sharding", ring_sharding),
]

#: The ring's positions are hashes that SQL doesn't share. Tests hold the first three stages against plain versions, the mix
#: against its bounds, and the ring against a walk of each key.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
