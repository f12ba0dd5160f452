"""Exchanges. Results don't depend on the placement of rows; these say only how rows are dealt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import key_group, subtask

#: rows of a side that may be broadcast, when its size has been checked.
BROADCAST_ROWS = 100_000


def by_key(df: DataFrame, *keys: str, parts: int | None = None) -> DataFrame:
    """Rows of a key in one partition. A null key has no place, as in any keyed stream."""
    for key in keys:
        df = df.where(F.col(key).isNotNull())
    return df.repartition(parts, *keys) if parts else df.repartition(*keys)


def rebalanced(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows dealt evenly. Never before an operator that needs the rows of a key together."""
    return df.repartition(parts) if parts else df.hint("rebalance")


def to_all(df: DataFrame, small: DataFrame, on: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Each row with the matching rows of a side that every partition gets; a larger side is shuffled instead."""
    fits = len(small.select(F.lit(1)).limit(rows + 1).take(rows + 1)) <= rows
    return df.join(F.broadcast(small) if fits else small, on)


def placed(df: DataFrame, hashed: Column, parallelism: int) -> DataFrame:
    """The key group and subtask of each row's key."""
    return df.withColumn("key_group", key_group(hashed)).withColumn("subtask", subtask(F.col("key_group"), parallelism))
