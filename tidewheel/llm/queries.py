"""The registered queries of this subpackage: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ball_tree, exact_dedup, html_text, language_id, line_dedup, lm_scoring, near_dedup, packing, sentencepiece_codec, substring_dedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Where the installed vocabulary files lie; a path like any other, so callers may name another file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_fm_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=50).drop("kept_text", "text_hash")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_shared_lines(table(spark, sf_dir, "documents")).drop("kept_text", "text_hash")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), capacity=4096, end=1)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and whether decoding gives the text back."""
    docs, model = table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model")
    return sentencepiece_codec.round_trip(docs, model)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = language_id.fold("doc_id", 5) == 1
    found = lm_scoring.score(docs, ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ball_tree.quantised(table(spark, sf_dir, "embeddings"))
    return ball_tree.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = language_id.fold("doc_id", 4) == 2
    found = language_id.identify(docs, docs.where(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80, lower=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_html_extraction, op2_fm_substring_dedup, op3_exact_dedup, op4_line_dedup, op5_best_fit_packing,
        op6_sentencepiece, op7_lm_scoring, op8_exact_top_k, op9_language_id, op10_minhash_near_dedup,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_fm_substring_dedup": substring_dedup.SQL, "op3_exact_dedup": exact_dedup.SQL, "op8_exact_top_k": ball_tree.SQL, "op10_minhash_near_dedup": near_dedup.SQL,
    }
