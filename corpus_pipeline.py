"""From raw documents to training shards: five stages, each over all its predecessor kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from autokpi.llm import decontaminate, mixing, near_dup, quality, token_shards
from autokpi.llm.frames import stored, table
from autokpi.llm.queries import MIX_WEIGHTS, shard_digests
from autokpi.session import ensure_checkpoint_dir


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go."""
    return quality.drop_low_quality(docs)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: one document of each group stays."""
    return near_dup.drop_near_duplicates(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that contain a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: documents come as often as the mix takes them, in the order of the queue."""
    return mixing.mix(docs, mixing.cycled_weights(docs, MIX_WEIGHTS))


def write_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-ID shards in training order; returns a digest row for every written sequence."""
    folder = token_shards.shared_folder(spark, "pipeline")
    return shard_digests(spark, stored(token_shards.write_shards(docs, folder)), folder)


STAGES = [("quality classifier", keep_good), ("near-dedup", keep_distinct), ("decontamination", keep_uncontaminated),
          ("source mix", mix_sources), ("token shards", write_shards)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over the documents, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-stages-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
