"""Keyed state as batch queries: what a processor would hold after each row of its key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def running_totals(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """After each row: the rows of its key so far, and the sum of an integer value."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running_count", F.count("*").over(w)).withColumn("running_sum", F.sum(value).over(w))


def previous_value(df: DataFrame, key: str, order: list[str], value: str, name: str = "previous") -> DataFrame:
    """What a value state held when the row came: the value of the row before, null at first."""
    return df.withColumn(name, F.lag(value).over(Window.partitionBy(key).orderBy(*order)))


def last_values(df: DataFrame, key: str, order: list[str], value: str, keep: int, name: str = "held") -> DataFrame:
    """What a list state that keeps the last few values holds after each row, in order of arrival."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(keep - 1), 0)
    return df.withColumn(name, F.collect_list(value).over(w))
