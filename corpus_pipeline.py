"""A cleaning pipeline over the documents: each stage works on all that the one before it kept.

``STAGES`` holds (name, function) pairs; a function takes (spark, docs, sf_dir) and returns
a DataFrame, which is written as Parquet and reread as the next one's docs. All but
the last return the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, mixing, sharding, simhash, toxicity
from tessera.llm.common import drop, mark, materialise, release, table

#: No SQL can express these stages; they are tested against brute force.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores at its threshold or above go."""
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.reject(docs, machine)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts with 0.8 or more of their five-word shingles in common, the document with the least id stays."""
    return simhash.one_of_each(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with much benchmark text go; from others its passages go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights; a document is there as often as it is taken."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds shard and slot, shards of near equal bytes."""
    return sharding.sharded_documents(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", remove_benchmark),
    ("source_mixing", mix_sources),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote for itself goes when its output is written; the output goes when the next one is."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES[:-1]:
        since = mark()
        docs = materialise(stage(spark, docs, sf_dir))
        release(spark, since, docs)
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
