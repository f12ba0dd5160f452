"""Session aggregation: rows of a member whose times lie no more than a gap apart are one session.

The two-phase form deals a member's rows to splits, finds segments in each, and merges segments: what is shuffled to
a member's partition in the end is segments. A split by time (a day, say) leaves one segment and a few for each
day of even the hottest member; a split by payload salt spreads a burst over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import is_blank

MINUTE = 60_000
GAP = 15 * MINUTE
DAY = 24 * 60 * MINUTE


def accumulated(term: Column | None = None) -> list[Column]:
    """The incremental aggregates of a session: times, number of rows, sorted distinct terms that aren't blank."""
    terms = F.collect_set(F.when(~is_blank(term), term)) if term is not None else F.array().cast("array<string>")
    terms = F.sort_array(terms) if term is not None else F.first(terms)
    return [F.min("t").alias("session_start"), F.max("t").alias("last_event"), F.count("*").alias("click_count"), terms.alias("search_terms")]


def _islands(df: DataFrame, keys: list[str], begin: Column, end: Column, gap: int, order: list[Column]) -> DataFrame:
    """``island``: rows whose begin is within the gap after all ends before it, in order of begin, have one number."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_new", (begin > before + gap).cast("int")).withColumn("island", F.sum(F.coalesce("_new", F.lit(0))).over(w))


def segments(df: DataFrame, keys: list[str], gap: int = GAP, term: str | None = None) -> DataFrame:
    """Sessions of each key by themselves: keys, session_start, last_event, click_count, search_terms."""
    found = _islands(df, keys, F.col("t"), F.col("t"), gap, [F.col("t")])
    return found.groupBy(*keys, "island").agg(*accumulated(F.col(term) if term else None)).drop("island")


def merged(parts: DataFrame, member: str = "member", gap: int = GAP) -> DataFrame:
    """Sessions from segments of a member: segments within the gap of each other are one."""
    found = _islands(parts, [member], F.col("session_start"), F.col("last_event"), gap, [F.col("session_start"), F.col("last_event")])
    found = found.groupBy(member, "island").agg(
        F.min("session_start").alias("session_start"),
        F.max("last_event").alias("last_event"),
        F.sum("click_count").alias("click_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("search_terms")))).alias("search_terms"),
    )
    return rows(found, member, gap)


def rows(found: DataFrame, member: str = "member", gap: int = GAP) -> DataFrame:
    """Session rows: the end is a gap after the last event, the duration doesn't count the gap."""
    return found.select(
        F.col(member).alias("member"),
        "session_start",
        "last_event",
        (F.col("last_event") + gap).alias("session_end"),
        (F.col("last_event") - F.col("session_start")).alias("duration_ms"),
        "click_count",
        "search_terms",
    )


def sessions(df: DataFrame, *, member: str = "member", gap: int = GAP, term: str | None = None, split: Column | None = None) -> DataFrame:
    """Sessions of rows (member, t in milliseconds[, term]): a row at exactly the gap still belongs.

    ``split`` deals a member's rows for the first phase; by default, by day.
    """
    split = F.floor(F.col("t") / DAY) if split is None else split
    parts = segments(df.where(F.col(member).isNotNull()).withColumn("_split", split), [member, "_split"], gap, term)
    return merged(parts, member, gap)


def sessions_single_phase(df: DataFrame, *, member: str = "member", gap: int = GAP, term: str | None = None) -> DataFrame:
    """The same result in one phase, for keys that are known to be even: one shuffle less."""
    return rows(segments(df.where(F.col(member).isNotNull()), [member], gap, term), member, gap)


def sessions_built_in(df: DataFrame, *, member: str = "member", gap: int = GAP, term: str | None = None) -> DataFrame:
    """The same by the built-in session window, over whole milliseconds."""
    keyed = df.where(F.col(member).isNotNull()).withColumn("_ts", F.timestamp_millis("t"))
    window = F.session_window("_ts", f"{gap} milliseconds")
    return rows(keyed.groupBy(member, window).agg(*accumulated(F.col(term) if term else None)), member, gap)
