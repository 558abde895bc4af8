"""Corpus pipeline: quality rules, near-duplicates, benchmark passages, source mix, shards.

Each stage takes the documents that the one before it has kept, all of them, and what it decides takes
effect; all but the last return the columns of ``documents``. Between two stages the documents are
written as Parquet to the shared folder and read again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strata.llm import decontaminate, minhash, mixing, quality_rules, sharding, simhash
from strata.session import scratch_path

#: The learned rules, the components and the shards go beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
#: Words of a shingle in the near-duplicate stage.
SHINGLE = 5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned decision list rejects; null and empty texts go."""
    return quality_rules.keep_good(docs, _table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the least id.

    Near copies have fingerprints within two bits, or five-word shingles of similarity 0.8 or more.
    """
    return simhash.keep_one(docs, minhash.near(docs, width=SHINGLE))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words inside passages of the benchmark; one with no other words goes."""
    return decontaminate.remove(docs, _table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their source takes them, some of them not at all."""
    return mixing.repeat(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the shard of their id and a slot in it."""
    return sharding.assign(docs).drop("grown_shard")


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_passages),
    ("source_mix", source_mix),
    ("shards", shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
