"""Corpus pipeline: quality, near-duplicates, benchmark leaks, mixture, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
reread as the next one's docs. Between stages only the documents' columns travel.

Edge cases are those of the operators; a document repeated as a row is kept once by the
near-duplicate stage, and repeated by the mixture as its source's rate says. Null and empty texts pass
the near-duplicate and benchmark stages; very long texts are treated whole; columns beside those of the
stages travel along, but for shard and virtual_slot, which the last stage writes; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import decontaminate, mixing, near_dup, quality, sharding
from tessella.llm.common import settled


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on these documents and their labels, accepts."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least doc_id, of each group linked at 0.8 over five-word shingles."""
    return near_dup.distinct_documents(docs, words=5, least=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks for."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and virtual slot."""
    return sharding.shard_documents(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("mixing to target weights", mix_sources),
    ("sharding", shard),
]

#: The classifier and the near-duplicate stage are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (_, stage) in enumerate(STAGES):
        now = settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage-{k}")
        if before:
            before.drop()
        before, docs = now, now.df
    return docs
