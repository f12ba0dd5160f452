"""Watermarks, lateness and timers as batch queries over rows in a known order of arrival.

Running extremes over all rows are found in levels, so that no window gathers the table in one partition: inside blocks
of the order, over the blocks of each larger block, and so on. No window's partition has over ``BLOCK`` rows (twice as many around
0), however the order's values lie; that goes for the last one too, which is over all blocks of 2**48 values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = 1 << 16


def _carried(tops: DataFrame, span: int, block: int, least: bool) -> DataFrame:
    """(_block, _carried): the best of all blocks before each. ``span``: how many values of the order a block has."""
    best, sign, both = (F.min, F.desc, F.least) if least else (F.max, F.asc, F.greatest)
    last = span > (1 << 63) // block  # so few blocks are possible that one partition takes them
    tops = tops.withColumn("_up", F.lit(0).cast("long") if last else F.expr(f"_block div {block}"))
    inside = Window.partitionBy("_up").orderBy(sign("_block")).rowsBetween(Window.unboundedPreceding, -1)
    own = tops.select("_up", "_block", best("_top").over(inside).alias("_carried"))
    if last:
        return own.drop("_up")
    above = _carried(tops.groupBy(F.col("_up").alias("_block")).agg(best("_top").alias("_top")), span * block, block, least)
    above = above.select(F.col("_block").alias("_up"), F.col("_carried").alias("_above"))
    return own.join(above, "_up").select("_block", both("_carried", "_above").alias("_carried"))


def running(df: DataFrame, order: str, value: Column, name: str, *, before: bool = False, least: bool = False, block: int = BLOCK) -> DataFrame:
    """``name``: the greatest (or least) value up to each row in order of ``order``, a long; ``before`` leaves the row out.

    Order must tell rows apart. With ``least``, rows are taken from the last back.
    """
    best, sign, both = (F.min, F.desc, F.least) if least else (F.max, F.asc, F.greatest)
    cut = df.withColumn("_value", value).withColumn("_block", F.expr(f"cast(`{order}` as long) div {block}"))
    inside = Window.partitionBy("_block").orderBy(sign(order)).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    blocks = _carried(cut.groupBy("_block").agg(best("_value").alias("_top")), block, max(block, BLOCK), least)
    out = cut.withColumn("_own", best("_value").over(inside)).join(blocks, "_block")
    return out.withColumn(name, both("_own", "_carried")).drop("_value", "_block", "_own", "_carried")


def watermarked(df: DataFrame, order: str, time: str, disorder: int, name: str = "watermark", *, before: bool = False) -> DataFrame:
    """The watermark after (or before) each row: the greatest time seen less the disorder; null before the first."""
    return running(df, order, F.col(time), "_seen", before=before).withColumn(name, F.col("_seen") - disorder).drop("_seen")


def least_watermark(df: DataFrame, order: str, time: str, channel: str, channels: list, disorder: int, name: str = "watermark") -> DataFrame:
    """The clock of a task with several inputs: the least of their watermarks, null until each has one."""
    for k, value in enumerate(channels):
        df = running(df, order, F.when(F.col(channel) == value, F.col(time)), f"_w{k}")
    parts = [F.col(f"_w{k}") for k in range(len(channels))]
    known = F.lit(True)
    for p in parts:
        known = known & p.isNotNull()
    clock = F.when(known, (F.least(*parts) if len(parts) > 1 else parts[0]) - disorder)
    return df.withColumn(name, clock).drop(*[f"_w{k}" for k in range(len(channels))])


def active_watermark(df: DataFrame, order: str, time: str, channel: str, channels: list, disorder: int, idle: int, clock: str, name: str = "watermark") -> DataFrame:
    """The least watermark over inputs that aren't idle: one whose last row is longer ago than ``idle`` holds none back.

    ``clock`` is each row's time of arrival. If all are idle, there is no progress: the row itself makes its input
    active, so that never holds at a row.
    """
    parts = []
    for k, value in enumerate(channels):
        own = F.col(channel) == value
        df = running(df, order, F.when(own, F.col(time)), f"_w{k}")
        df = running(df, order, F.when(own, F.col(clock)), f"_a{k}")
        active = F.col(clock) - F.col(f"_a{k}") <= idle
        parts.append(F.when(active, F.col(f"_w{k}")))
    lowest = F.least(*parts) if len(parts) > 1 else parts[0]
    return df.withColumn(name, lowest - disorder).drop(*[f"_{x}{k}" for x in "wa" for k in range(len(channels))])


def lateness(time: Column, watermark: Column, allowed: int) -> Column:
    """on_time; accepted_late, if behind the watermark by no more than allowed; else dropped. At the watermark is on time."""
    late = F.coalesce(time < watermark, F.lit(False))
    return F.when(~late, "on_time").when(time >= watermark - allowed, "accepted_late").otherwise("dropped")


def fired(timers: DataFrame, advances: DataFrame, at: str = "timer", watermark: str = "watermark", name: str = "fired_at") -> DataFrame:
    """The first watermark at or after each timer (null if none comes yet). Watermarks must not fall.

    Timers and watermarks are put in one order of time; the next watermark is the least from there on.
    """
    columns = timers.columns
    rows = timers.withColumn("_x", F.col(at) * 2).unionByName(
        advances.select((F.col(watermark) * 2 + 1).alias("_x"), F.col(watermark).alias("_w")).where("_w is not null").distinct(), allowMissingColumns=True
    )
    # many timers may share a time: they share the next watermark as well
    next_one = running(rows.groupBy("_x").agg(F.min("_w").alias("_w")), "_x", F.col("_w"), name, least=True, block=BLOCK * 1000)
    asked = timers.withColumn("_x", F.col(at) * 2).join(next_one.select("_x", name), "_x", "left")
    return asked.select(*columns, name)
