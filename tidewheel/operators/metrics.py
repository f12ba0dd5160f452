"""Counters, histograms and source lag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def counters(df: DataFrame, task: str) -> DataFrame:
    return df.groupBy(task).agg(F.count("*").alias("records"))


def histogram(df: DataFrame, task: str, value: Column) -> DataFrame:
    """Number of values, their mean cut to a whole number, and the greatest; 0 where there is none."""
    total = df.withColumn("_v", value).groupBy(task).agg(F.count("_v").alias("n"), F.sum("_v").alias("s"), F.max("_v").alias("m"))
    mean = F.when(F.col("n") > 0, (F.col("s") / F.col("n")).cast("long")).otherwise(0)
    return total.select(task, F.col("n").alias("count"), mean.alias("mean"), F.greatest(F.coalesce("m", F.lit(0)), F.lit(0)).alias("max"))


def lag(end: Column, position: Column) -> Column:
    """Records between the next position and the end; never negative."""
    return F.greatest(F.lit(0), end - position)
