"""The registered batch queries over the driver's tables, each with the SQL that it is held against.

``events`` plays the clickstream: user is the member, ``click`` a result click, ``purchase`` a borrow, ``error`` noise.
Times are epoch milliseconds, ties are broken by event_id, and lists are returned as text joined by commas.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.hashing import key_group, long_hash, payload_salt, string_hash, subtask
from ..functions.time import millis
from ..operators import event_time, exchange, interval_join, keyed, metrics, sessions, transforms
from ..sources import jsonl

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

MINUTE = 60_000
#: An order of arrival that is not the order of time: event_id times a factor, modulo a prime; and its inverse rank.
SHUFFLE, PRIME = 7919, 1_000_003

_E = "(SELECT event_id, user_id, event_type, value, props, epoch_us(ts) // 1000 AS t FROM events)"
_CLICKS = f"(SELECT event_id AS click_id, user_id, t AS left_ms FROM {_E} WHERE event_type = 'click')"
_BUYS = f"(SELECT event_id AS purchase_id, user_id, t AS right_ms FROM {_E} WHERE event_type = 'purchase')"


def query(sql: str, name: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[name or f.__name__] = f
        _SQL[name or f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    return raw.select("event_id", "user_id", "event_type", "value", "props", millis(F.col("ts")).alias("t"))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = events(spark, sf_dir)
    clicks = e.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), "user_id", F.col("t").alias("left_ms"))
    buys = e.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), "user_id", F.col("t").alias("right_ms"))
    return clicks, buys


# -- scans and stateless transforms ---------------------------------------------------------------------------


@query(f"SELECT event_id, user_id, event_type, value FROM {_E}")
def scan_events(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", "user_id", "event_type", "value")


@query(f"SELECT event_id, value FROM {_E} WHERE value > 50")
def filter_predicate(spark, sf_dir):
    return events(spark, sf_dir).where("value > 50").select("event_id", "value")


#: bot rows come from the table itself: every fifth user is a bot, every seventh row blank, every eleventh without time.
_BOTTED = f"""(SELECT event_id, CASE WHEN user_id % 5 = 0 THEN 'bot-' || user_id WHEN event_id % 7 = 0 THEN ' ' WHEN event_id % 13 = 0 THEN NULL
  WHEN user_id % 5 = 1 THEN 'robot-' || user_id ELSE 'm-' || user_id END AS member, CASE WHEN event_id % 11 = 0 THEN 0 ELSE t END AS t FROM {_E})"""


@query(rf"SELECT event_id, member, t FROM {_BOTTED} WHERE member IS NOT NULL AND NOT regexp_full_match(member, '\s*') AND NOT starts_with(member, 'bot-') AND t > 0")
def bot_filter(spark, sf_dir):
    user = F.col("user_id").cast("string")
    member = (
        F.when(F.col("user_id") % 5 == 0, F.concat(F.lit("bot-"), user))
        .when(F.col("event_id") % 7 == 0, F.lit(" "))
        .when(F.col("event_id") % 13 == 0, F.lit(None))
        .when(F.col("user_id") % 5 == 1, F.concat(F.lit("robot-"), user))
        .otherwise(F.concat(F.lit("m-"), user))
    )
    t = F.when(F.col("event_id") % 11 == 0, F.lit(0)).otherwise(F.col("t"))
    rows = events(spark, sf_dir).select("event_id", member.alias("member"), t.cast("long").alias("t"))
    return transforms.bot_filter(rows, member="member", millis="t")


@query(f"SELECT event_id, user_id, t FROM {_E} WHERE event_type = 'click'")
def result_clicks(spark, sf_dir):
    return transforms.result_clicks(events(spark, sf_dir), event_type="event_type", wanted="click").select("event_id", "user_id", "t")


@query(f"SELECT event_id, upper(event_type) AS kind, CAST(round(value * 100) AS BIGINT) AS cents, t // 1000 AS seconds FROM {_E}")
def process_map(spark, sf_dir):
    cents = F.round(F.col("value") * 100).cast("long")
    return events(spark, sf_dir).select("event_id", F.upper("event_type").alias("kind"), cents.alias("cents"), F.floor(F.col("t") / 1000).alias("seconds"))


@query(f"SELECT event_id, unnest(range(event_id % 4)) AS copy FROM {_E}")
def process_flatmap(spark, sf_dir):
    n = F.col("event_id") % 4
    copies = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<bigint>"))
    return events(spark, sf_dir).select("event_id", F.explode(copies.cast("array<bigint>")).alias("copy"))


@query(f"SELECT event_id, (t // 60000) * 60000 AS t FROM {_E}")
def process_retimestamp(spark, sf_dir):
    return transforms.retimed(events(spark, sf_dir), F.floor(F.col("t") / MINUTE) * MINUTE).select("event_id", "t")


@query(
    f"SELECT 'L' AS side, event_id AS id, user_id FROM {_E} WHERE event_type = 'click' UNION ALL SELECT 'R', event_id, user_id FROM {_E} WHERE event_type = 'purchase'"
)
def tag_union(spark, sf_dir):
    clicks, buys = _sides(spark, sf_dir)
    both = transforms.tagged(clicks, buys)
    fold = transforms.fold
    return both.select(
        "side",
        fold(both, lambda x: x["click_id"], lambda x: x["purchase_id"]).alias("id"),
        fold(both, lambda x: x["user_id"], lambda x: x["user_id"]).alias("user_id"),
    )


@query(f"SELECT event_id, user_id FROM {_E} WHERE event_type = 'click' UNION ALL SELECT event_id, user_id FROM {_E} WHERE value > 50")
def union_all(spark, sf_dir):
    e = events(spark, sf_dir)
    return transforms.union_all(e.where("event_type = 'click'"), e.where("value > 50")).select("event_id", "user_id")


@query(
    f"SELECT user_id, sum(CASE WHEN event_type = 'click' THEN event_id ELSE -event_id END)::BIGINT AS total FROM {_E} WHERE event_type IN ('click', 'purchase') GROUP BY user_id"
)
def either_fold(spark, sf_dir):
    clicks, buys = _sides(spark, sf_dir)
    both = transforms.tagged(clicks, buys)
    value = transforms.fold(both, lambda x: x["click_id"], lambda x: -x["purchase_id"])
    user = transforms.fold(both, lambda x: x["user_id"], lambda x: x["user_id"])
    return both.groupBy(user.alias("user_id")).agg(F.sum(value).alias("total"))


@query(
    f"SELECT 'clicks' AS branch, count(*) AS n, sum(event_id)::BIGINT AS total FROM {_E} WHERE event_type = 'click'"
    f" UNION ALL SELECT 'all', count(*), sum(event_id)::BIGINT FROM {_E}"
)
def fan_out(spark, sf_dir):
    aggregates = (F.count("*").alias("n"), F.sum("event_id").alias("total"))
    branches = transforms.fan_out(
        events(spark, sf_dir),
        lambda df: df.where("event_type = 'click'").agg(*aggregates).select(F.lit("clicks").alias("branch"), "n", "total"),
        lambda df: df.agg(*aggregates).select(F.lit("all").alias("branch"), "n", "total"),
    )
    return transforms.union_all(*branches)


# -- exchanges ----------------------------------------------------------------------------------------------


_PER_USER = f"SELECT user_id, count(*) AS n, max(t) AS last FROM {_E} GROUP BY user_id"


@query(_PER_USER)
def exchange_hash(spark, sf_dir):
    return exchange.by_key(events(spark, sf_dir), "user_id").groupBy("user_id").agg(F.count("*").alias("n"), F.max("t").alias("last"))


@query(_PER_USER)
def exchange_rebalance(spark, sf_dir):
    return exchange.rebalanced(events(spark, sf_dir)).groupBy("user_id").agg(F.count("*").alias("n"), F.max("t").alias("last"))


@query(
    f"SELECT event_type, n_name, count(*) AS n FROM {_E} JOIN (SELECT n_nationkey AS k, n_name FROM nation) ON user_id % 25 = k GROUP BY event_type, n_name"
)
def exchange_broadcast(spark, sf_dir):
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("k"), "n_name")
    rows = events(spark, sf_dir).withColumn("k", F.col("user_id") % 25)
    return exchange.to_all(rows, nations, "k").groupBy("event_type", "n_name").agg(F.count("*").alias("n"))


def _times(a: str, factor: int) -> str:
    return f"((({a}) * {factor & 0xFFFF} + ((({a}) * {factor >> 16}) & 65535) * 65536) & 4294967295)"


#: the finaliser in integer SQL, one step to a nested query.
_GROUPED = f"""(SELECT user_id, (CASE WHEN x > 2147483647 THEN 4294967296 - x ELSE x END % 128)::INTEGER AS key_group FROM (
 SELECT user_id, xor(x, x >> 16) AS x FROM (SELECT user_id, {_times("x", 0xC2B2AE35)} AS x FROM (
 SELECT user_id, xor(x, x >> 13) AS x FROM (SELECT user_id, {_times("x", 0x85EBCA6B)} AS x FROM (
 SELECT user_id, xor(x, x >> 16) AS x FROM (SELECT user_id, {_times("x", 0x1B873593)} AS x FROM (
 SELECT user_id, ((x << 15) & 4294967295) | (x >> 17) AS x FROM (SELECT user_id, {_times("x", 0xCC9E2D51)} AS x FROM (
 SELECT user_id, xor(user_id, user_id >> 32) & 4294967295 AS x FROM events))))))))))"""


@query(f"SELECT DISTINCT user_id, key_group, (key_group * 4) // 128 AS subtask FROM {_GROUPED}", name="key_group")
def key_group_of_user(spark, sf_dir):
    users = events(spark, sf_dir).select("user_id").distinct()
    return exchange.placed(users, long_hash(F.col("user_id")), 4)


@query(f"SELECT (key_group * 4) // 128 AS subtask, count(*) AS n, count(DISTINCT user_id) AS users FROM {_GROUPED} GROUP BY 1")
def key_group_skew(spark, sf_dir):
    at = subtask(key_group(long_hash(F.col("user_id"))), 4)
    return events(spark, sf_dir).groupBy(at.alias("subtask")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


def _sql_string_hash(text: str) -> str:
    return f"list_reduce(list_transform(string_split({text}, ''), lambda c: unicode(c)::BIGINT), lambda a, c: (a * 31 + c) & 4294967295, 0::BIGINT)"


_MOD64 = "18446744073709551616::UHUGEINT"


def _sql_salt() -> str:
    """The 64-bit mix in 128-bit SQL: a query for each half step."""
    sign = "(CASE WHEN {0} > 2147483647 THEN {0}::UHUGEINT + 18446744069414584320::UHUGEINT ELSE {0}::UHUGEINT END)"
    inner = f"SELECT event_id, t, {_sql_string_hash(chr(39) + 'u' + chr(39) + ' || user_id')} AS h1, {_sql_string_hash('props')} AS h3, {_sql_string_hash('event_type')} AS h4, {0x9E3779B97F4A7C15}::UHUGEINT AS x FROM {_E}"
    for value in (sign.format("h1"), "0::UHUGEINT", sign.format("h3"), sign.format("h4"), "t::UHUGEINT"):
        inner = f"SELECT * REPLACE (xor(x, {value}) AS x) FROM ({inner})"
        inner = f"SELECT * REPLACE (xor(x, x >> 30) * {0xBF58476D1CE4E5B9}::UHUGEINT % {_MOD64} AS x) FROM ({inner})"
        inner = f"SELECT * REPLACE (xor(x, x >> 27) * {0x94D049BB133111EB}::UHUGEINT % {_MOD64} AS x) FROM ({inner})"
        inner = f"SELECT * REPLACE (xor(x, x >> 31) AS x) FROM ({inner})"
    return f"SELECT (xor(x, x >> 32) % 16)::INTEGER AS salt, count(*) AS n FROM ({inner}) GROUP BY 1"


@query(_sql_salt())
def salt_distribution(spark, sf_dir):
    member = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    salt = payload_salt(member, F.lit(None).cast("string"), F.col("props"), F.col("event_type"), F.col("t"))
    return events(spark, sf_dir).select(salt.alias("salt")).groupBy("salt").agg(F.count("*").alias("n"))


@query(f"SELECT DISTINCT event_type, {_sql_string_hash('event_type')} AS hashed FROM {_E}")
def string_hashes(spark, sf_dir):
    return events(spark, sf_dir).select("event_type").distinct().withColumn("hashed", string_hash(F.col("event_type")))


# -- keyed state ----------------------------------------------------------------------------------------------


@query(
    f"""SELECT event_id, user_id, count(*) OVER w AS running_count, (sum(cents) OVER w)::BIGINT AS running_sum
 FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents FROM {_E}) WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)"""
)
def keyed_running(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return keyed.running_totals(rows, "user_id", ["event_id"], "cents").select("event_id", "user_id", "running_count", "running_sum")


@query(f"SELECT event_id, user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM {_E}")
def state_value(spark, sf_dir):
    return keyed.previous_value(events(spark, sf_dir), "user_id", ["event_id"], "event_type").select("event_id", "user_id", "previous")


@query(
    f"""SELECT event_id, user_id, array_to_string(list(event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), ',') AS held
 FROM {_E}"""
)
def state_list(spark, sf_dir):
    held = keyed.last_values(events(spark, sf_dir), "user_id", ["event_id"], "event_type", 5)
    return held.select("event_id", "user_id", F.array_join("held", ",").alias("held"))


# -- sessions ---------------------------------------------------------------------------------------------------


def _sql_sessions(gap: int, keys: str = "user_id", source: str = f"(SELECT *, event_type AS term FROM {_E} WHERE event_type <> 'error')") -> str:
    return f"""SELECT {keys}, min(t) AS session_start, max(t) AS last_event, max(t) + {gap} AS session_end, max(t) - min(t) AS duration_ms, count(*) AS click_count,
  array_to_string(list_sort(list(DISTINCT term) FILTER (term <> '')), ',') AS search_terms
 FROM (SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS island FROM (
  SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY {keys} ORDER BY t, event_id) > {gap} THEN 1 ELSE 0 END AS fresh FROM {source}))
 GROUP BY {keys}, island"""


def _members(spark, sf_dir) -> DataFrame:
    rows = events(spark, sf_dir).where("event_type <> 'error'")
    return rows.select(F.col("user_id").alias("member"), "t", F.col("event_type").alias("term"), "event_id")


def _session_rows(found: DataFrame) -> DataFrame:
    return found.withColumnRenamed("member", "user_id").withColumn("search_terms", F.array_join("search_terms", ","))


@query(
    f"""SELECT user_id, min(t) AS session_start, max(t) AS last_event, count(*) AS click_count, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS search_terms
 FROM {_E} WHERE event_type <> 'error' GROUP BY user_id"""
)
def session_accumulate(spark, sf_dir):
    found = _members(spark, sf_dir).groupBy("member").agg(*sessions.accumulated(F.col("term")))
    return _session_rows(found)


@query(_sql_sessions(15 * MINUTE))
def sessions_15m(spark, sf_dir):
    return _session_rows(sessions.sessions(_members(spark, sf_dir), gap=15 * MINUTE, term="term"))


@query(_sql_sessions(120 * MINUTE))
def sessions_2h(spark, sf_dir):
    return _session_rows(sessions.sessions(_members(spark, sf_dir), gap=120 * MINUTE, term="term"))


@query(_sql_sessions(360 * MINUTE))
def sessions_6h(spark, sf_dir):
    return _session_rows(sessions.sessions(_members(spark, sf_dir), gap=360 * MINUTE, term="term"))


@query(_sql_sessions(120 * MINUTE))
def sessions_single_phase(spark, sf_dir):
    return _session_rows(sessions.sessions_single_phase(_members(spark, sf_dir), gap=120 * MINUTE, term="term"))


@query(_sql_sessions(120 * MINUTE))
def sessions_session_window(spark, sf_dir):
    return _session_rows(sessions.sessions_built_in(_members(spark, sf_dir), gap=120 * MINUTE, term="term"))


@query(_sql_sessions(120 * MINUTE))
def sessions_salted(spark, sf_dir):
    rows = _members(spark, sf_dir)
    return _session_rows(sessions.sessions(rows, gap=120 * MINUTE, term="term", split=F.col("event_id") % 16))


@query(
    "SELECT user_id, salt, session_start, last_event, click_count, search_terms FROM ("
    + _sql_sessions(120 * MINUTE, "user_id, salt", f"(SELECT *, event_type AS term, event_id % 16 AS salt FROM {_E} WHERE event_type <> 'error')")
    + ")"
)
def sessions_salted_local(spark, sf_dir):
    rows = _members(spark, sf_dir).withColumn("salt", F.col("event_id") % 16)
    return _session_rows(sessions.segments(rows, ["member", "salt"], 120 * MINUTE, "term"))


@query(
    "SELECT user_id::VARCHAR AS member_id, make_timestamp(session_start * 1000) AS session_start, make_timestamp(last_event * 1000) AS last_event,"
    " make_timestamp(session_end * 1000) AS session_end, duration_ms, click_count, search_terms FROM (" + _sql_sessions(120 * MINUTE) + ")"
)
def session_table_projection(spark, sf_dir):
    found = sessions.sessions(_members(spark, sf_dir), gap=120 * MINUTE, term="term")
    return transforms.session_table(found).withColumn("search_terms", F.array_join("search_terms", ","))


# -- interval joins ----------------------------------------------------------------------------------------------


def _sql_interval(lower: int, upper: int) -> str:
    return f"""SELECT user_id, click_id, purchase_id, right_ms - left_ms AS delay_ms FROM {_CLICKS} JOIN {_BUYS} USING (user_id)
 WHERE right_ms - left_ms BETWEEN {lower} AND {upper}"""


def _interval(spark, sf_dir, lower: int, upper: int) -> DataFrame:
    clicks, buys = _sides(spark, sf_dir)
    pairs = interval_join.interval_join(clicks, buys, ["user_id"], lower, upper)
    return pairs.select("user_id", "click_id", "purchase_id", (F.col("right_ms") - F.col("left_ms")).alias("delay_ms"))


@query(_sql_interval(0, 30 * MINUTE), name="interval_join")
def interval_join_half_hour(spark, sf_dir):
    return _interval(spark, sf_dir, 0, 30 * MINUTE)


@query(_sql_interval(10 * MINUTE, 720 * MINUTE))
def interval_join_bounds(spark, sf_dir):
    return _interval(spark, sf_dir, 10 * MINUTE, 720 * MINUTE)


@query(_sql_interval(-120 * MINUTE, 10 * MINUTE))
def interval_join_negative(spark, sf_dir):
    return _interval(spark, sf_dir, -120 * MINUTE, 10 * MINUTE)


@query(
    f"""WITH wm AS (SELECT max(t) - 86400000 AS wm FROM {_E})
 SELECT side, count(*) AS n FROM (
  SELECT 'L' AS side, left_ms + 1800000 AS until FROM {_CLICKS} UNION ALL SELECT 'R', right_ms + 1800000 FROM {_BUYS}), wm WHERE until >= wm GROUP BY side"""
)
def interval_join_state(spark, sf_dir):
    clicks, buys = _sides(spark, sf_dir)
    rows = clicks.select(F.lit("L").alias("side"), F.col("left_ms").alias("t")).union(buys.select(F.lit("R"), "right_ms"))
    watermark = (events(spark, sf_dir).agg(F.max("t")).first()[0] or 0) - 86_400_000
    return interval_join.retained(rows, watermark, 0, 30 * MINUTE).groupBy("side").agg(F.count("*").alias("n"))


@query(
    f"""SELECT user_id::VARCHAR AS member_id, 'item-' || item AS catalog_item_id, props AS search_term, 'loan-' || purchase_id AS loan_id, left_ms AS click_ms,
  right_ms AS borrow_ms, right_ms - left_ms AS conversion_delay_ms
 FROM (SELECT *, event_id % 3 AS item, t AS left_ms FROM {_E} WHERE event_type = 'click')
 JOIN (SELECT user_id, event_id % 3 AS item, event_id AS purchase_id, t AS right_ms FROM {_E} WHERE event_type = 'purchase') USING (user_id, item)
 WHERE right_ms - left_ms BETWEEN 0 AND 21600000"""
)
def conversions(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("item", F.col("event_id") % 3)
    clicks = e.where("event_type = 'click'").select("user_id", "item", "props", F.col("t").alias("left_ms"))
    borrows = e.where("event_type = 'purchase'").select("user_id", "item", F.col("event_id").alias("loan"), F.col("t").alias("right_ms"))
    pairs = interval_join.interval_join(clicks, borrows, ["user_id", "item"], 0, 360 * MINUTE)
    return pairs.select(
        F.col("user_id").cast("string").alias("member_id"),
        F.concat(F.lit("item-"), F.col("item").cast("string")).alias("catalog_item_id"),
        F.col("props").alias("search_term"),
        F.concat(F.lit("loan-"), F.col("loan").cast("string")).alias("loan_id"),
        F.col("left_ms").alias("click_ms"),
        F.col("right_ms").alias("borrow_ms"),
        (F.col("right_ms") - F.col("left_ms")).alias("conversion_delay_ms"),
    )


# -- event time ---------------------------------------------------------------------------------------------------


@query(f"SELECT event_id, t, max(t) OVER (ORDER BY event_id) - 5000 AS watermark FROM {_E}")
def watermark_bounded(spark, sf_dir):
    return event_time.watermarked(events(spark, sf_dir), "event_id", "t", 5000).select("event_id", "t", "watermark")


_CHANNELS = ", ".join(f"max(CASE WHEN event_id % 3 = {k} THEN t END) OVER (ORDER BY event_id) AS w{k}" for k in range(3))


@query(
    f"SELECT event_id, CASE WHEN w0 IS NOT NULL AND w1 IS NOT NULL AND w2 IS NOT NULL THEN least(w0, w1, w2) - 5000 END AS watermark FROM (SELECT event_id, {_CHANNELS} FROM {_E})"
)
def watermark_min(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("channel", F.col("event_id") % 3)
    return event_time.least_watermark(rows, "event_id", "t", "channel", [0, 1, 2], 5000).select("event_id", "watermark")


_IDLE = ", ".join(f"max(CASE WHEN user_id % 2 = {k} THEN t END) OVER (ORDER BY event_id) AS w{k}" for k in range(2))


@query(
    f"SELECT event_id, least(CASE WHEN t - w0 <= 600000 THEN w0 END, CASE WHEN t - w1 <= 600000 THEN w1 END) - 5000 AS watermark FROM (SELECT event_id, t, {_IDLE} FROM {_E})"
)
def watermark_idle(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("channel", F.col("user_id") % 2)
    found = event_time.active_watermark(rows, "event_id", "t", "channel", [0, 1], 5000, 10 * MINUTE, "t")
    return found.select("event_id", "watermark")


_ARRIVED = f"(SELECT *, event_id + (event_id * {SHUFFLE} % {PRIME}) % 50 AS arrival FROM {_E})"
_SHUFFLED = f"(SELECT *, max(t) OVER (ORDER BY arrival * 1000000000 + event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 5000 AS wm FROM {_ARRIVED})"


def _arrived(spark, sf_dir) -> DataFrame:
    """Rows that come up to fifty places late; ``seq`` orders them."""
    late = (F.col("event_id") * SHUFFLE % PRIME) % 50
    return events(spark, sf_dir).withColumn("seq", (F.col("event_id") + late) * 1_000_000_000 + F.col("event_id"))


@query(
    f"SELECT event_id, CASE WHEN wm IS NULL OR t >= wm THEN 'on_time' WHEN t >= wm - 7200000 THEN 'accepted_late' ELSE 'dropped' END AS lateness FROM {_SHUFFLED}"
)
def late_classify(spark, sf_dir):
    rows = event_time.running(_arrived(spark, sf_dir), "seq", F.col("t"), "seen", before=True, block=10**13)
    label = event_time.lateness(F.col("t"), F.col("seen") - 5000, 120 * MINUTE)
    return rows.select("event_id", label.alias("lateness"))


@query(
    f"""WITH a AS (SELECT DISTINCT max(t) OVER (ORDER BY event_id) - 5000 AS wm FROM {_E}), k AS (SELECT event_id, user_id, t + 900000 AS timer FROM {_E})
 SELECT event_id, user_id, timer, wm AS fired_at FROM k ASOF LEFT JOIN a ON timer <= wm"""
)
def timers_fire(spark, sf_dir):
    e = events(spark, sf_dir)
    timers = e.select("event_id", "user_id", (F.col("t") + 15 * MINUTE).alias("timer"))
    return event_time.fired(timers, event_time.watermarked(e, "event_id", "t", 5000))


@query("SELECT count(*) AS sessions, sum(click_count)::BIGINT AS clicks FROM (" + _sql_sessions(15 * MINUTE) + ")")
def bounded_close_all(spark, sf_dir):
    """At the end of bounded input every session is closed: none of the rows is left out."""
    return sessions.sessions(_members(spark, sf_dir), term="term").agg(F.count("*").alias("sessions"), F.sum("click_count").alias("clicks"))


# -- metrics and sources ------------------------------------------------------------------------------------------


@query(f"SELECT event_type, count(*) AS records FROM {_E} GROUP BY event_type")
def metric_counter(spark, sf_dir):
    return metrics.counters(events(spark, sf_dir), "event_type")


@query(f"SELECT event_type, count(c) AS count, trunc(sum(c) / count(c))::BIGINT AS mean, max(c) AS max FROM (SELECT event_type, CAST(round(value * 100) AS BIGINT) AS c FROM {_E}) GROUP BY 1")
def metric_histogram(spark, sf_dir):
    return metrics.histogram(events(spark, sf_dir), "event_type", F.round(F.col("value") * 100).cast("long"))


@query(f"SELECT event_id % 4 AS source_partition, greatest(0, max(event_id) + 1 - 5000) AS lag FROM {_E} GROUP BY 1")
def source_lag(spark, sf_dir):
    ends = events(spark, sf_dir).groupBy((F.col("event_id") % 4).alias("source_partition")).agg((F.max("event_id") + 1).alias("end"))
    return ends.select("source_partition", metrics.lag(F.col("end"), F.lit(5000)).alias("lag"))


@query(f"SELECT event_id, (props->>'k')::BIGINT AS k FROM {_E} WHERE event_id % 7 <> 0")
def json_drop_malformed(spark, sf_dir):
    """Every seventh payload is cut short; such rows are counted and dropped, the others decoded."""
    raw = F.when(F.col("event_id") % 7 == 0, F.expr("substr(props, 1, length(props) - 1)")).otherwise(F.col("props"))
    rows = events(spark, sf_dir).select("event_id", raw.alias("value"))
    return jsonl.decoded(rows, "k long", keep=["event_id"])


@query(f"SELECT event_id, user_id, event_type, t FROM {_E}")
def file_replay(spark, sf_dir):
    """Rows written as JSON Lines to the shared folder and replayed from there; a malformed line would fail the query."""
    rows = events(spark, sf_dir).select("event_id", "user_id", "event_type", "t")
    path = jsonl.written(rows, "file-replay")
    return jsonl.replayed(spark, path, "event_id long, user_id long, event_type string, t long")


@query(f"SELECT event_id, user_id, event_type, t FROM {_E}")
def file_replay_slices(spark, sf_dir):
    """The same replay by four subtasks, each with the lines whose hash is its own: together they are all rows, once."""
    rows = events(spark, sf_dir).select("event_id", "user_id", "event_type", "t")
    path = jsonl.written(rows, "file-replay-slices")
    parts = [jsonl.replayed_slice(spark, path, "event_id long, user_id long, event_type string, t long", n, 4) for n in range(4)]
    return reduce(DataFrame.unionAll, parts)


# imported for what they register
from . import streams  # noqa: E402, F401
