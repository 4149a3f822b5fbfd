"""Training documents in five stages: toxic ones go, one of each near-duplicate group stays, benchmark leaks go, domains are
mixed to their targets, and what is left is sharded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import decontam, mixing, neardup, sharding, toxicity
from foliospark.llm.common import Written, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the toxicity threshold, by a model learned from the labelled documents that are not held out."""
    return toxicity.reject_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, with the least doc_id, of each group linked by five-word shingles at 0.8 or more."""
    return neardup.one_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say."""
    return mixing.mixed(docs, table(spark, sf_dir, "labels"))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard."""
    return sharding.with_shards(docs)


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_near_duplicates), ("decontamination", drop_leaks), ("mixing", mix_domains), ("sharding", shard)]
#: Learned scores and a fit by steps are not SQL; tests/llm/test_pipeline.py compares run() with plain Python of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = Written(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written.put(docs)
    return docs
