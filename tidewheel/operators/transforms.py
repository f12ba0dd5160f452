"""Stateless transforms: DataFrame in, DataFrame out, one stage of generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import is_blank
from ..functions.time import utc


def bot_filter(clicks: DataFrame, *, member: str = "memberId", millis: str = "eventTimeMillis", above_watermark: Column | None = None) -> DataFrame:
    """Drop clicks of no or blank member, of members ``bot-...``, and without a positive time (null counts as 0).

    In a stream the dropped rows still have to move the clock. A predicate that reads no event-time column would be
    pushed below the watermark, where they wouldn't be seen: name the watermarked column in ``above_watermark``.
    """
    keep = F.col(member).isNotNull() & ~is_blank(F.col(member)) & ~F.col(member).startswith("bot-") & (F.coalesce(F.col(millis), F.lit(0)) > 0)
    keep = F.coalesce(keep, F.lit(False))
    if above_watermark is not None:
        keep = F.when(above_watermark.isNotNull(), keep).otherwise(F.lit(False))
    return clicks.where(keep)


def result_clicks(clicks: DataFrame, *, event_type: str = "eventType", wanted: str = "RESULT_CLICK") -> DataFrame:
    return clicks.where(F.col(event_type) == wanted)


def tagged(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both inputs as one: side (L or R), and the row as a struct under ``left`` or ``right``."""
    rows = (
        left.select(F.lit("L").alias("side"), F.struct("*").alias("left")),
        right.select(F.lit("R").alias("side"), F.struct("*").alias("right")),
    )
    return rows[0].unionByName(rows[1], allowMissingColumns=True)


def fold(either: DataFrame, left: Callable[[Column], Column], right: Callable[[Column], Column]) -> Column:
    """One value of a tagged row, whichever side it is of."""
    return F.when(F.col("side") == "L", left(F.col("left"))).otherwise(right(F.col("right")))


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Bag union by column name: nothing is deduplicated. A stream can't be united with itself."""
    out = first
    for other in others:
        if other is first:
            raise ValueError("a stream can't be united with itself")
        out = out.unionByName(other)
    return out


def fan_out(df: DataFrame, *branches: Callable[[DataFrame], DataFrame]) -> list[DataFrame]:
    """Every branch gets every row."""
    return [branch(df) for branch in branches]


def retimed(df: DataFrame, millis: Column, name: str = "t") -> DataFrame:
    """The rows with another event time."""
    return df.withColumn(name, millis)


def session_table(sessions: DataFrame) -> DataFrame:
    """Session rows as the browse_sessions table holds them."""
    return sessions.select(
        F.col("member").cast("string").alias("member_id"),
        utc(F.col("session_start")).alias("session_start"),
        utc(F.col("last_event")).alias("last_event"),
        utc(F.col("session_end")).alias("session_end"),
        F.col("duration_ms"),
        F.col("click_count"),
        F.col("search_terms"),
    )


def conversion_table(conversions: DataFrame) -> DataFrame:
    """Conversion rows as the click_conversions table holds them."""
    return conversions.select(
        "member_id", "catalog_item_id", "search_term", "loan_id",
        utc(F.col("click_ms")).alias("click_time"), utc(F.col("borrow_ms")).alias("borrow_time"), "conversion_delay_ms",
    )
