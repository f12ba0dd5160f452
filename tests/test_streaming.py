"""Streams over small inputs, one row a micro-batch where the clock has to move row by row."""

from __future__ import annotations

import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tidewheel.operators import sessions as batch_sessions, transforms
from tidewheel.sources import replay
from tidewheel.streaming import joins, keyed, sessions
from tidewheel.streaming.clickstream import Clickstream

GAP = 900_000


class Feed:
    """A file of JSON lines read one line a batch; ``restart`` goes on from the checkpoint."""

    def __init__(self, spark, tmp_path, build, schema, step=1):
        self.spark, self.path, self.checkpoint, self.rows = spark, tmp_path / f"{uuid.uuid4().hex}.jsonl", tmp_path / uuid.uuid4().hex, []
        self.path.write_text("")
        self.build, self.schema, self.step = build, schema, step

    def run(self, *lines) -> list:
        with self.path.open("a") as f:
            f.writelines(json.dumps(x) + "\n" for x in lines)
        raw = replay.lines(self.spark, str(self.path), self.step)
        data = raw.select(F.col("line").alias("seq"), F.from_json("value", self.schema).alias("d")).select("seq", "d.*")
        stream = self.build(data)
        query = stream.writeStream.option("checkpointLocation", str(self.checkpoint)).foreachBatch(lambda df, n: self.rows.extend(df.collect())).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return self.rows


def _sessions(allowed=0, disorder="5 seconds"):
    def build(df):
        return sessions.exact(sessions.event_timed(df, "t", disorder).select("ts", "member", "t", "seq", "term"), GAP, allowed)

    return build


SCHEMA = "member string, t long, term string"


def click(member, t, term="x"):
    return {"member": member, "t": t, "term": term}


def closed(rows):
    return sorted((r.member, r.session_start, r.last_event, r.session_end, r.duration_ms, r.click_count, ",".join(r.search_terms)) for r in rows if r.kind == "session")


OUT_OF_ORDER = [click("alpha", 20000, "later"), click("alpha", 18000, "earlier"), click("beta", 1_000_000, "concurrency"), click("alpha", 2_000_000, "new session")]
WANT = [
    ("alpha", 18000, 20000, 920000, 2000, 2, "earlier,later"),
    ("alpha", 2_000_000, 2_000_000, 2_900_000, 0, 1, "new session"),
    ("beta", 1_000_000, 1_000_000, 1_900_000, 0, 1, "concurrency"),
]


def test_out_of_order_rows_within_the_disorder(spark, tmp_path):
    feed = Feed(spark, tmp_path, _sessions(), SCHEMA)
    rows = feed.run(*OUT_OF_ORDER, click("clock", 4_000_000), click("clock", 4_000_001))
    assert closed(rows) == WANT  # the clock's own session stays open


def test_bounded_input_gives_the_same_rows_in_batch(spark):
    df = spark.createDataFrame([(c["member"], c["t"], c["term"]) for c in OUT_OF_ORDER], "member string, t long, term string")
    for form in (batch_sessions.sessions, batch_sessions.sessions_single_phase):
        got = sorted((r.member, r.session_start, r.last_event, r.session_end, r.duration_ms, r.click_count, ",".join(r.search_terms)) for r in form(df, term="term").collect())
        assert got == WANT


def test_recovery_in_the_middle_of_a_session_equals_a_clean_run(spark, tmp_path):
    first, rest = [click("alpha", 18000, "first"), click("alpha", 20000, "second")], [click("beta", 2_000_000, "final"), click("clock", 4_000_000), click("clock", 4_000_001)]
    clean = Feed(spark, tmp_path, _sessions(), SCHEMA)
    clean.run(*first, *rest)
    broken = Feed(spark, tmp_path, _sessions(), SCHEMA)
    broken.run(*first)
    assert closed(broken.rows) == []
    broken.run(*rest)
    want = [("alpha", 18000, 20000, 920000, 2000, 2, "first,second"), ("beta", 2_000_000, 2_000_000, 2_900_000, 0, 1, "final")]
    assert closed(broken.rows) == closed(clean.rows) == want


@pytest.mark.parametrize(
    ("allowed", "want", "kinds"),
    [
        (0, ("late", 900000, 900000, 1800000, 0, 1, "current"), {"late": 1}),
        (900000, ("late", 0, 900000, 1800000, 900000, 2, "current,late"), {"accepted_late": 1}),
    ],
)
def test_late_rows_are_dropped_or_revise_an_open_session(spark, tmp_path, allowed, want, kinds):
    feed = Feed(spark, tmp_path, _sessions(allowed), SCHEMA)
    rows = feed.run(click("late", 900000, "current"), click("other", 900000), click("late", 0, "late"), click("clock", 5_000_000), click("clock", 5_000_001))
    assert [x for x in closed(rows) if x[0] == "late"] == [want]
    found = {}
    for r in rows:
        if r.kind != "session":
            found[r.kind] = found.get(r.kind, 0) + 1
    assert found == kinds


def test_negative_lateness_is_refused():
    with pytest.raises(ValueError, match="negative"):
        sessions.SessionProcessor(GAP, -1)


def test_a_row_past_the_end_closes_at_once_and_an_old_one_is_dropped(spark, tmp_path):
    feed = Feed(spark, tmp_path, _sessions(disorder="1 day"), SCHEMA)  # the clock doesn't move: only rows decide
    rows = feed.run(click("a", 1000), click("a", 1000 + GAP + 1), click("b", GAP + 1000), click("b", 999), click("c", 20000), click("c", 10000))
    assert closed(rows) == [("a", 1000, 1000, 1000 + GAP, 0, 1, "x")]
    assert [(r.kind, r.member) for r in rows if r.kind != "session"] == [("late", "b")]


def test_built_in_windows_agree_on_ordered_input(spark, tmp_path):
    feed = Feed(spark, tmp_path, lambda df: sessions.windowed(sessions.event_timed(df, "t"), GAP), SCHEMA)
    rows = feed.run(click("a", 1000), click("a", 1000 + GAP), click("a", 2001 + 2 * GAP), click("clock", 9 * GAP), click("clock", 9 * GAP + 1))
    assert closed(rows)[:2] == [("a", 1000, 1000 + GAP, 1000 + 2 * GAP, GAP, 2, "x"), ("a", 2001 + 2 * GAP, 2001 + 2 * GAP, 2001 + 3 * GAP, 0, 1, "x")]


def _row(side, key, own, t):
    return {"side": side, "key": key, "id": own, "t": t}


def test_the_exact_join_never_drops_late_input(spark, tmp_path):
    def build(df):
        return joins.exact(sessions.event_timed(df, "t", "0 seconds").select("ts", "key", "side", "id", "t"), 0, 30)

    feed = Feed(spark, tmp_path, build, "side string, key string, id string, t long")
    # the left row comes when the clock is far beyond it, but its partner is still held
    rows = feed.run(_row("R", "a", "r1", 130), _row("R", "x", "clock", 131), _row("L", "a", "l1", 100), _row("L", "b", "l2", 290), _row("R", "b", "r2", 300), _row("L", "c", "l3", 100), _row("R", "c", "r3", 500))
    assert sorted((r.left_id, r.right_id) for r in rows) == [("l1", "r1"), ("l2", "r2")]
    rows = feed.run(_row("R", "x", "clock2", 10_000), _row("R", "x", "clock3", 10_001), _row("L", "b", "l4", 290))
    assert len(rows) == 2  # evicted partners match no more


@pytest.mark.parametrize(("lower", "upper"), [(0, 30_000), (-40_000, 10_000), (5, 5)])
def test_the_exact_join_over_buckets_equals_all_pairs(spark, tmp_path, lower, upper):
    def build(df):
        return joins.exact(sessions.event_timed(df, "t", "1 day").select("ts", "key", "side", "id", "t"), lower, upper)

    r = random.Random(lower)
    rows = [_row(r.choice("LR"), r.choice("aab"), f"x{n}", r.randrange(0, 200_000, 5)) for n in range(240)]
    rows += [_row("L", "a", "twin", 50_000), _row("L", "a", "twin", 50_000), _row("R", "a", "edge", 50_000 + upper), _row("R", "a", "edge", 50_000 + lower)]
    rows += [_row("R", "a", "beyond", 50_001 + upper), _row("L", "b", None, 60_000), _row("R", "b", None, 60_000 + upper)]
    r.shuffle(rows)
    found = Feed(spark, tmp_path, build, "side string, key string, id string, t long", step=90).run(*rows)
    left, right = ([x for x in rows if x["side"] == s] for s in "LR")
    want = [(a["key"], a["id"], b["id"], a["t"], b["t"]) for a in left for b in right if a["key"] == b["key"] and lower <= b["t"] - a["t"] <= upper]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))


def test_an_operator_with_state_timers_and_the_watermark(spark, tmp_path):
    class Watcher(keyed.Operator):
        def open(self, context):
            self.last, self.seen = context.value("last", "long"), context.values("seen", "long")
            assert context.value("last", "LONG") is self.last
            for other in (lambda: context.values("last", "long"), lambda: context.value("last", "string"), lambda: context.value("_due", "long")):
                try:
                    other()
                except keyed.StateError:
                    continue
                raise AssertionError("taken")

        def on_row(self, key, row, context, out):
            if row.term == "clear":
                self.last.clear()
                self.seen.clear()
            else:
                self.last.update(int(row.t))
                self.seen.add(int(row.t))
                context.at(int(row.t) + 100)
            out.append(("row", key, self.last.get() or -1, str(self.seen.get())))

        def on_timer(self, time, key, context, out):
            self.seen.update([t for t in self.seen.get() if t + 100 > time])
            out.append(("timer", key, time, str(self.seen.get())))

        def on_watermark(self, clock, key, context, out):
            out.append(("clock", key, clock, ""))
            return clock < 1000

    def build(df):
        timed = sessions.event_timed(df, "t", "0 seconds")
        return keyed.processed(timed, "member", ["t", "term"], Watcher(), "kind string, member string, t long, seen string")

    feed = Feed(spark, tmp_path, build, SCHEMA)
    rows = feed.run(click("a", 10), click("a", 50), click("z", 120), click("b", 130, "clear"), click("z", 2000))
    mine = [(r.kind, r.t, r.seen) for r in rows if r.member == "a"]
    assert [x for x in mine if x[0] == "row"] == [("row", 10, "[10]"), ("row", 50, "[10, 50]")]
    assert [x for x in mine if x[0] == "timer"] == [("timer", 110, "[50]"), ("timer", 150, "[]")]
    clocks = [x[1] for x in mine if x[0] == "clock"]
    assert clocks == sorted(set(clocks)) and clocks[-1] >= 1000 and len([c for c in clocks if c >= 1000]) == 1
    assert [(r.t, r.seen) for r in rows if r.member == "b" and r.kind == "row"] == [(-1, "[]")]


def test_the_clickstream_job_fills_both_tables_and_replays_nothing_twice(spark, tmp_path):
    base = 1_757_836_800_000
    clicks = [
        ("m-1", "", "systems", "SEARCH", 0), ("m-1", "cat-1", "systems", "RESULT_CLICK", 12_000), ("bot-9", "cat-1", "*", "RESULT_CLICK", 13_000),
        ("", "cat-9", "broken", "RESULT_CLICK", 14_000), ("m-2", "cat-2", "streams", "RESULT_CLICK", 44_000), ("m-3", "cat-3", "late", "RESULT_CLICK", 45_000),
    ]
    borrows = [("m-1", "cat-1", "loan-1", 71_000), ("m-2", "cat-2", "loan-2", 110_000), ("m-3", "cat-3", "loan-3", 45_000 + 1_800_001)]
    for name in ("clicks", "borrows"):
        (tmp_path / name).mkdir()
    names = ("memberId", "catalogItemId", "searchTerm", "eventType", "eventTimeMillis")
    (tmp_path / "clicks/1.json").write_text("\n".join(json.dumps(dict(zip(names, (*c[:4], base + c[4])))) for c in clicks))
    names = ("memberId", "catalogItemId", "loanId", "eventTimeMillis")
    (tmp_path / "borrows/1.json").write_text("\n".join(json.dumps(dict(zip(names, (*b[:3], base + b[3])))) for b in borrows))
    for side, extra in (("clicks", {"catalogItemId": "", "searchTerm": "clock", "eventType": "SEARCH"}), ("borrows", {"catalogItemId": "none", "loanId": "none"})):
        (tmp_path / side / "2.json").write_text(json.dumps({"memberId": "fixture-clock", "eventTimeMillis": base + 3_600_000} | extra))

    from tidewheel.schemas import BORROW, CLICK
    from tidewheel.sources.jsonl import replay_stream

    def run():
        def stream(name, schema):
            return replay_stream(spark, str(tmp_path / name), schema)

        job = Clickstream(spark, stream("clicks", CLICK), stream("borrows", BORROW), f"file://{tmp_path}/out")
        job.start_sessions().awaitTermination()
        job.start_conversions().awaitTermination()
        return job

    for _ in range(2):
        job = run()
        found = sorted((r.member_id, r.duration_ms, r.click_count, ",".join(r.search_terms)) for r in job.sessions.read().collect())
        assert found == [("m-1", 12_000, 2, "systems"), ("m-2", 0, 1, "streams"), ("m-3", 0, 1, "late")]
        pairs = sorted((r.member_id, r.loan_id, r.conversion_delay_ms) for r in job.conversions.read().collect())
        assert pairs == [("m-1", "loan-1", 59_000), ("m-2", "loan-2", 66_000)]


def test_dropped_rows_still_move_the_clock(spark, tmp_path):
    def build(df):
        rows = transforms.bot_filter(sessions.event_timed(df, "t"), member="member", millis="t", above_watermark=F.col("ts"))
        return sessions.exact(rows.select("ts", "member", "t", "seq", "term"), GAP)

    feed = Feed(spark, tmp_path, build, SCHEMA)
    rows = feed.run(click("beta", 18000, "first"), click("bot-x", 4_000_000, "clock"), click("bot-x", 4_000_001, "clock"))
    assert closed(rows) == [("beta", 18000, 18000, 918000, 0, 1, "first")]


def test_salted_sessions_over_batches_and_late_rows(spark, tmp_path):
    from tidewheel.streaming import sessions as streaming_sessions

    minute, gap = 60_000, 15 * 60_000
    r = random.Random(3)
    hot = sorted(r.sample(range(0, 3000 * minute, 1000), 400))
    batches = [[("hot", t, f"term {t % 3}") for t in hot if (3000 * minute) * k // 4 <= t < (3000 * minute) * (k + 1) // 4] for k in range(4)]
    batches[1] += [("other", 1000 * minute, None), ("other", 1010 * minute, " "), (None, 1011 * minute, "x")]
    batches[3] += [("hot", 5, "too late")]
    batches.append([("clock", 9000 * minute, "x")])
    folder = tmp_path / "in"
    found = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "member string, t long, term string").coalesce(1).write.mode("append").parquet(str(folder))
        raw = spark.readStream.schema("member string, t long, term string").parquet(str(folder))
        stream = streaming_sessions.event_timed(raw, "t", "5 seconds").where(F.when(F.col("ts").isNotNull(), F.col("member").isNotNull()).otherwise(False))
        stream = streaming_sessions.salted(stream, gap, F.pmod(F.xxhash64("t"), F.lit(8)))
        writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "check"))
        writer.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        found = spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()
    want: list[list] = []
    for member in ("hot", "other"):
        held: list[list] = []
        for _, t, term in sorted((x for b in batches for x in b if x[0] == member and x[1] != 5), key=lambda x: x[1]):
            if held and t <= held[-1][2] + gap:
                held[-1][2], held[-1][3] = t, held[-1][3] + 1
                held[-1][4] |= {term} if term and term.strip() else set()
            else:
                held.append([member, t, t, 1, {term} if term and term.strip() else set()])
        want += held
    got = sorted((x.member, x.session_start, x.last_event, x.click_count, tuple(x.search_terms)) for x in found if x.kind == "session")
    assert got == sorted((m, a, b, n, tuple(sorted(s))) for m, a, b, n, s in want)
    assert [(x.member, x.session_start) for x in found if x.kind == "late"] == [("hot", 5)]
