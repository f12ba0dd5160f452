"""Exact deduplication, with DataFrame functions only.

Documents are grouped by a 128-bit hash of their normalised text *and* the text itself: the hash finds the group,
and the aggregation's key comparison compares the bytes inside it, so a collision makes two groups. Map-side
aggregation leaves one row per text and partition, so that a text that a third of all rows share shuffles a row
per task. The way back to the documents is a join on hashes and length, without texts; it stands alone in its
stage, where adaptive execution splits hot keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), _SPACE, "")


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_duplicates(docs: DataFrame, *, normalise=normalised, content_hash=content_hash) -> DataFrame:
    """Group documents (doc_id long, text string) of equal normalised text.

    Returns one row per document: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text). The
    document with the most code points in its original text stays, of equals the smallest doc_id. Empty, null and
    blank texts are all equal. Rows that share doc_id and text are counted in group_size and share their fate. Rows
    without doc_id can't be named and are left out. Other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long"), text.alias("text")).where("doc_id is not null")
    docs = docs.select("doc_id", F.char_length("text").alias("n"), normalise(F.col("text")).alias("norm"))
    # one number that is least for the most code points, then the smallest doc_id: it keeps the aggregate in hash form
    key = F.expr("cast((2147483648BD - n) * 18446744073709551616BD + (doc_id + 9223372036854775808BD) as decimal(38, 0))")
    groups = (
        docs.select(content_hash(F.col("norm")).alias("h"), "norm", key.alias("key"))
        .groupBy("h", "norm")
        .agg(F.count("*").alias("group_size"), F.min("key").alias("key"))
    )
    keep = F.expr("cast(key % 18446744073709551616BD - 9223372036854775808BD as long)")
    groups = groups.select(
        "h", F.sha2("norm", 256).alias("text_sha256"), F.char_length("norm").alias("len"), "group_size", keep.alias("keep_id")
    )
    rows = docs.select(
        "doc_id", content_hash(F.col("norm")).alias("h"), F.sha2("norm", 256).alias("text_sha256"), F.char_length("norm").alias("len")
    )
    return rows.join(groups, ["h", "text_sha256", "len"]).select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256"
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents WHERE doc_id IS NOT NULL
), g AS (
  SELECT norm, count(*) AS group_size, first(doc_id ORDER BY length(text) DESC, doc_id) AS keep_id FROM d GROUP BY norm
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.norm) AS text_sha256 FROM d JOIN g USING (norm)
"""
