"""Stages of a corpus pipeline: each takes documents and returns documents, all columns kept, but the last one's pieces.

Documents are doc_id, text, lang, source, n_chars; n_chars is brought up to date where a text changes. Each stage is
judged on its own input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import exact_dedup, language_id, near_dedup, packing, substring_dedup
from .queries import tokenizer_file
from .scratch import Scratch, bounded_batches


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told, with it as their lang; those without text or letters go. Learns from all
    labelled documents; if there are none, lang stays as it is."""
    return language_id.keep_identified(docs, docs)


def one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose texts are equal but for white space; of rows that share its doc_id too, the one
    with the most code points. Texts that differ stay, whatever doc_id they share."""
    kept = exact_dedup.exact_duplicates(docs).where("kept").select("doc_id", "text_sha256")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = F.struct(F.char_length(text).alias("_n"), *[F.col(c) for c in docs.columns])
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.sha2(exact_dedup.normalised(F.col("text")), 256).alias("_sha"), row.alias("_row"))
    rows = rows.join(kept, (F.col("_id") == F.col("doc_id")) & (F.col("_sha") == F.col("text_sha256")), "left_semi")
    return rows.groupBy("_id", "_sha").agg(F.max("_row").alias("_row")).select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates: shingles of five words, similarity of 0.8 or more."""
    kept = near_dedup.near_duplicates(docs, shingle=5, percent=80).where("kept").select("doc_id")
    return docs.join(kept, "doc_id", "left_semi")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that an earlier document has; documents left empty go."""
    found = substring_dedup.remove_repeats(docs).where("n_removed > 0")
    found = found.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.max("kept_text").alias("_kept"))
    same = (F.col("doc_id").cast("long") == F.col("_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_hash"))
    out = docs.join(found, same, "left").where("_kept is null or _kept <> ''")
    changed = F.col("_kept").isNotNull()
    columns = {
        "text": F.when(changed, F.col("_kept")).otherwise(F.col("text")),
        "n_chars": F.when(changed, F.char_length("_kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")),
    }
    return out.select(*[columns[c].alias(c) if c in columns else F.col(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


def run(spark: SparkSession, stages, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The stages in order, each one's result written and read again."""
    bounded_batches(spark)
    scratch = Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(stages):
        docs = scratch.write(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{stages[k - 1][0]}")
    return docs
