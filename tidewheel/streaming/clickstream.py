"""The clickstream job: clicks and borrows in, browse sessions and click-to-borrow conversions out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import transforms
from ..schemas import BROWSE_SESSIONS, CLICK_CONVERSIONS
from ..session import configured
from . import joins, sessions
from .sinks import Table

GAP, CONVERSION = 15 * 60_000, 30 * 60_000


@dataclass
class Clickstream:
    """Both outputs of one job. Each query has its own checkpoint under ``root``.

    ``seq`` of the inputs is the order of arrival; where it is absent, the time is taken.
    """

    spark: SparkSession
    clicks: DataFrame
    borrows: DataFrame
    root: str
    disorder: str = "5 seconds"
    allowed: int = 0

    def __post_init__(self) -> None:
        configured(self.spark)
        self.sessions = Table(self.spark, f"{self.root}/browse_sessions", BROWSE_SESSIONS, files=1)
        self.conversions = Table(self.spark, f"{self.root}/click_conversions", CLICK_CONVERSIONS, files=1)

    def _timed(self, df: DataFrame) -> DataFrame:
        seq = F.col("seq") if "seq" in df.columns else F.col("eventTimeMillis")
        rows = df.withColumn("t", F.coalesce("eventTimeMillis", F.lit(0))).withColumn("seq", seq)
        return sessions.event_timed(rows, "t", self.disorder)

    def human_clicks(self) -> DataFrame:
        """Clicks without bots; those dropped have moved the clock."""
        return transforms.bot_filter(self._timed(self.clicks), above_watermark=F.col("ts"))

    def session_stream(self) -> DataFrame:
        rows = self.human_clicks().select("ts", F.col("memberId").alias("member"), "t", "seq", F.col("searchTerm").alias("term"))
        return sessions.exact(rows, GAP, self.allowed)

    def conversion_stream(self) -> DataFrame:
        clicks = transforms.result_clicks(self.human_clicks()).select(
            F.col("ts").alias("left_ts"), "memberId", "catalogItemId", "searchTerm", F.col("t").alias("click_ms")
        )
        borrows = self._timed(self.borrows).select(F.col("ts").alias("right_ts"), "memberId", "catalogItemId", "loanId", F.col("t").alias("borrow_ms"))
        pairs = joins.built_in(clicks, borrows, ["memberId", "catalogItemId"], 0, CONVERSION)
        return pairs.select(
            F.col("memberId").alias("member_id"), F.col("catalogItemId").alias("catalog_item_id"), F.col("searchTerm").alias("search_term"),
            F.col("loanId").alias("loan_id"), "click_ms", "borrow_ms", (F.col("borrow_ms") - F.col("click_ms")).alias("conversion_delay_ms"),
        )

    def _start(self, stream: DataFrame, name: str, write, trigger: dict) -> StreamingQuery:
        writer = stream.writeStream.outputMode("append").option("checkpointLocation", f"{self.root}/_checkpoints/{name}")
        return writer.trigger(**trigger).foreachBatch(write).start()

    def start_sessions(self, **trigger) -> StreamingQuery:
        def write(df: DataFrame, batch: int) -> None:
            self.sessions.append(transforms.session_table(df.where("kind = 'session'")), batch)

        return self._start(self.session_stream(), "sessions", write, trigger or {"availableNow": True})

    def start_conversions(self, **trigger) -> StreamingQuery:
        def write(df: DataFrame, batch: int) -> None:
            self.conversions.append(transforms.conversion_table(df), batch)

        return self._start(self.conversion_stream(), "conversions", write, trigger or {"availableNow": True})
