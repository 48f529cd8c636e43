"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; ``run`` writes
each stage's rows as Parquet to the shared folder, reads them again as the next stage's documents and
deletes them, and the stage's own tables, when that stage is written. The order of the mix is the order of its files and their rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.llm import minhash, mixing, quality, sharding, tiling
from granary.llm.common import forget, keep, outlive, scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or leave a fertility band go."""
    return quality.filtered(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group at 0.8 on five-word shingles the smallest doc_id stays; rows go by their own texts, ids or not."""
    return minhash.deduplicated(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half of a benchmark item in matches of five words or more go."""
    return tiling.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source comes near its target: documents are repeated or left out, in curriculum order."""
    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, text, size, text_crc32, law, shard, slot of every row; copies of a text are linked, slots of a shard follow the curriculum."""
    return sharding.sharded(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing_to_weights),
    ("sharding", shards),
]

#: Token measures and label propagation are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES:
        with scratch():
            docs = outlive(keep(stage(spark, docs, sf_dir)))
        if before is not None:
            forget(before)
        before = docs
    return docs
