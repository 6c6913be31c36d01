"""The registered queries of this package: op<N>_<name> for each operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.warc import deduplicated_archive

    return deduplicated_archive(table(spark, sf_dir, "pages"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.simhash import near_duplicates

    rows = near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.substring_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)


def op5_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality import held_out_scores

    return held_out_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_tokenizer_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.fertility import judge

    return judge(table(spark, sf_dir, "documents"))


def op7_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.license_scan import scan

    return scan(table(spark, sf_dir, "documents"))


def op8_sampled_splitter_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.sharding import assign

    return assign(table(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.decontamination import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_factorization_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.toxicity import held_out_scores

    return held_out_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from tessera.llm import license_scan, mixing, warc

    return {"op1_warc_revisits": warc.ORACLE, "op3_source_mixing": mixing.oracle(), "op7_license_digests": license_scan.oracle()}
