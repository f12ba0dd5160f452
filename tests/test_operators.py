import random

import pytest
from pyspark.sql import functions as F

from tidewheel.operators import event_time, exchange, interval_join, metrics, sessions, transforms

GAP = sessions.GAP


def _events(spark, rows):
    return spark.createDataFrame(rows, "member string, t long, term string")


def _tuples(df):
    return sorted((r.member, r.session_start, r.last_event, r.session_end, r.duration_ms, r.click_count, tuple(r.search_terms)) for r in df.collect())


def test_a_row_at_exactly_the_gap_belongs(spark):
    df = _events(spark, [("a", 1000, "x"), ("a", 1000 + GAP, " "), ("b", 5, "y"), ("b", 6 + GAP, None), (None, 1, "z")])
    want = [("a", 1000, 1000 + GAP, 1000 + 2 * GAP, GAP, 2, ("x",)), ("b", 5, 5, 5 + GAP, 0, 1, ("y",)), ("b", 6 + GAP, 6 + GAP, 6 + 2 * GAP, 0, 1, ())]
    for form in (sessions.sessions, sessions.sessions_single_phase, sessions.sessions_built_in):
        assert _tuples(form(df, term="term")) == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_any_split_gives_the_same_sessions(spark, seed):
    random.seed(seed)
    rows = [(random.choice("abc"), random.randint(0, 3 * sessions.DAY), random.choice(["", "p", "q", None])) for _ in range(400)]
    df = _events(spark, rows)
    want = _tuples(sessions.sessions_single_phase(df, term="term"))
    assert sum(x[5] for x in want) == len(rows)
    for split in (None, F.pmod(F.xxhash64("t"), F.lit(16)), F.lit(0)):
        assert _tuples(sessions.sessions(df, term="term", split=split)) == want


def _pairs(spark, left, right, lower, upper):
    a = spark.createDataFrame([("k", t) for t in left] + [(None, 0)], "k string, left_ms long")
    b = spark.createDataFrame([("k", t) for t in right] + [(None, 0)], "k string, right_ms long")
    return sorted((r.left_ms, r.right_ms) for r in interval_join.interval_join(a, b, ["k"], lower, upper).collect())


@pytest.mark.parametrize(
    ("left", "right", "lower", "upper", "want"),
    [
        ([100], [130], 0, 30, [(100, 130)]),
        ([100], [109, 110, 130, 131], 10, 30, [(100, 110), (100, 130)]),
        ([115], [100], -20, 10, [(115, 100)]),
        ([0], [0, 1, -1], 0, 0, [(0, 0)]),
        ([], [5], 0, 10, []),
    ],
)
def test_interval_bounds_are_inclusive(spark, left, right, lower, upper, want):
    assert _pairs(spark, left, right, lower, upper) == want


def test_interval_join_equals_brute_force(spark):
    random.seed(4)
    left, right = [random.randint(-500, 500) for _ in range(80)], [random.randint(-500, 500) for _ in range(80)]
    assert _pairs(spark, left, right, -37, 61) == sorted((a, b) for a in left for b in right if -37 <= b - a <= 61)


def test_times_at_the_ends_of_long(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    times = [low, low + 3, low + 5000, -1, 0, 7, high - 5000, high - 3, high]
    left = spark.createDataFrame([("k", t) for t in times], "k string, left_ms long")
    right = spark.createDataFrame([("k", t) for t in times], "k string, right_ms long")
    for lower, upper in ((0, 10), (-5, 5), (-4990, -1), (0, 0), (2, 6000)):
        got = {(r.left_ms, r.right_ms) for r in interval_join.interval_join(left, right, ["k"], lower, upper).collect()}
        assert got == {(a, b) for a in times for b in times if lower <= b - a <= upper}
    kept = interval_join.retained(spark.createDataFrame([("L", high), ("R", low), ("R", 3)], "side string, t long"), 5, -4, 9)
    assert {(r.side, r.t) for r in kept.collect()} == {("L", high), ("R", 3)}


def test_bounds_are_checked():
    with pytest.raises(ValueError, match="above"):
        interval_join.check_bounds(31, 30)
    with pytest.raises(ValueError, match="least"):
        interval_join.check_bounds(-(1 << 63), 0)


def test_state_is_kept_to_the_bound(spark):
    rows = spark.createDataFrame([("L", 100), ("R", 100)], "side string, t long")
    held = {wm: sorted(r.side for r in interval_join.retained(rows, wm, 0, 30).collect()) for wm in (130, 131)}
    assert held == {130: ["L", "R"], 131: []}
    assert [r.side for r in interval_join.retained(rows, 111, -20, 10).collect()] == ["R"]


def test_running_extremes_need_no_single_partition(spark):
    random.seed(5)
    rows = [(k, random.choice([None, random.randint(0, 1000)])) for k in range(300)]
    df = spark.createDataFrame(rows, "o long, v long")
    for before in (False, True):
        for least in (False, True):
            got = {r.o: r.x for r in event_time.running(df, "o", F.col("v"), "x", before=before, least=least, block=7).collect()}
            for k, _ in rows:
                seen = [v for o, v in rows if v is not None and ((o >= k + before) if least else (o <= k - before))]
                assert got[k] == ((min if least else max)(seen) if seen else None)


def test_lateness_at_and_behind_the_watermark(spark):
    df = spark.createDataFrame([(100, 100), (99, 100), (90, 100), (89, 100), (5, None)], "t long, wm long")
    got = [r[0] for r in df.orderBy(F.desc("t")).select(event_time.lateness(F.col("t"), F.col("wm"), 10)).collect()]
    assert got == ["on_time", "accepted_late", "accepted_late", "dropped", "on_time"]


def test_timers_fire_at_the_first_watermark_that_reaches_them(spark):
    timers = spark.createDataFrame([(1, 10), (2, 10), (3, 11), (4, 99)], "id long, timer long")
    marks = spark.createDataFrame([(5,), (10,), (10,), (40,), (None,)], "watermark long")
    assert {r.id: r.fired_at for r in event_time.fired(timers, marks).collect()} == {1: 10, 2: 10, 3: 40, 4: None}


def test_bot_filter_truth_table(spark):
    rows = [("m-1", 5), ("robot-fan", 5), ("bot-crawler", 5), ("", 5), ("  \t", 5), (None, 5), ("m-2", 0), ("m-3", -1), ("m-4", None)]
    df = spark.createDataFrame(rows, "memberId string, eventTimeMillis long")
    assert sorted(r.memberId for r in transforms.bot_filter(df).collect()) == ["m-1", "robot-fan"]
    assert sorted(r.memberId for r in transforms.bot_filter(df.withColumn("ts", F.lit(1)), above_watermark=F.col("ts")).collect()) == ["m-1", "robot-fan"]


def test_union_keeps_copies_and_refuses_itself(spark):
    df = spark.createDataFrame([(1,), (1,)], "x int")
    assert transforms.union_all(df, df.select("x")).count() == 4
    with pytest.raises(ValueError, match="itself"):
        transforms.union_all(df, df)


def test_exchanges(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    assert exchange.by_key(df, "k", parts=3).count() == 2
    assert exchange.rebalanced(df, 3).count() == 3
    small = spark.createDataFrame([("a", 10)], "k string, w int")
    for rows in (0, 10):
        assert [tuple(r) for r in exchange.to_all(df, small, "k", rows).collect()] == [("a", 1, 10)]


def test_histogram_and_lag(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", None)], "task string, v long")
    got = {r.task: (r["count"], r["mean"], r["max"]) for r in metrics.histogram(df, "task", F.col("v")).collect()}
    assert got == {"a": (2, 1, 2), "b": (0, 0, 0)}
    assert spark.range(1).select(metrics.lag(F.lit(3), F.lit(5)), metrics.lag(F.lit(8), F.lit(5))).first()[:] == (0, 3)


def test_running_extremes_over_sparse_orders(spark):
    r = random.Random(2)
    order = sorted({r.randint(-(2**62), 2**62) for _ in range(150)} | set(range(40)) | {2**63 - 1, -(2**63)})
    rows = [(o, r.randint(0, 1000)) for o in order]
    df = spark.createDataFrame(rows, "o long, v long").repartition(3)
    for least in (False, True):
        for before in (False, True):
            got = {x.o: x.m for x in event_time.running(df, "o", F.col("v"), "m", before=before, least=least, block=7).collect()}
            seen, want = None, {}
            for o, v in reversed(rows) if least else rows:
                if before:
                    want[o] = seen
                seen = v if seen is None else (min if least else max)(seen, v)
                want.setdefault(o, seen)
            assert got == want
