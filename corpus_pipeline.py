"""From raw documents to packed sequences: language ID, exact, near and substring deduplication, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewheel.llm import stages

STAGES = [
    ("language_id", stages.known_language),
    ("exact_dedup", stages.one_of_equal),
    ("near_dedup", stages.one_of_near),
    ("substring_dedup", stages.without_repeats),
    ("packing", stages.packed),
]

#: language identification has no SQL form, so the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.run(spark, STAGES, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
