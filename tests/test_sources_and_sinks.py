import json
import pickle
import threading
import time
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.schemas import BROWSE_SESSIONS, CLICK
from tidewheel.sources import jsonl, kafka, replay
from tidewheel.streaming import catalog, sinks, supervisor

TWO = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("note", T.StringType(), True)])


def test_malformed_messages_are_dropped_and_counted(spark):
    values = ['{"id": 1, "other": 2}', '{"id": ', "null", None, "[]", '{"id": 3}', "{}"]
    df = spark.createDataFrame([(v,) for v in values], "value string")
    assert sorted(str(r.id) for r in jsonl.decoded(df, "id long").collect()) == ["1", "3", "None"]
    assert jsonl.malformed_count(df, "id long").first()[0] == 4


def test_a_malformed_line_fails_a_replay(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n\n{"id": 2}\n')
    assert sorted(r.id for r in jsonl.replayed(spark, str(tmp_path), "id long").collect()) == [1, 2]
    (tmp_path / "b.jsonl").write_text("{oops\n")
    with pytest.raises(Exception, match="[Mm]alformed"):
        jsonl.replayed(spark, str(tmp_path), "id long").collect()


def test_missing_time_is_dropped_as_zero(spark):
    df = spark.createDataFrame([('{"memberId": "m"}',), ('{"memberId": "n", "eventTimeMillis": 5}',)], "value string")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CLICK)
    from tidewheel.operators.transforms import bot_filter

    assert [r.memberId for r in bot_filter(jsonl.decoded(df, schema)).collect()] == ["n"]


def test_the_line_cursor_survives_a_restart(spark, tmp_path):
    path, seen = tmp_path / "lines.txt", []
    path.write_text("a\nb\n\nc\n")

    def start():
        stream = replay.lines(spark, str(path), step=2)
        return stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, n: seen.extend((r.line, r.value) for r in df.collect())).start()

    query = start()
    query.processAllAvailable()
    query.stop()
    with path.open("a") as f:
        f.write("d\n")
    query = start()
    query.processAllAvailable()
    query.stop()
    assert seen == [(0, "a"), (1, "b"), (3, "c"), (4, "d")]
    with pytest.raises(ValueError, match="cursor"):
        replay.LineReader(str(path), 1).read({"line": 99})
    with pytest.raises(ValueError, match="negative"):
        replay.LineReader(str(path), 1).read({"line": -1})
    with pytest.raises(ValueError, match="ends before"):
        replay.LineReader(str(path), 1).read({"line": 1, "byte": 999})


def _string_hash(line):
    h = 0
    for unit in memoryview(line.encode("utf-16-le")).cast("H"):
        h = (h * 31 + unit) % 2**32
    return h - 2**32 if h >= 2**31 else h


LINES = ["a", "", "{}", "schöne Wörter", "🎣 fish", "x" * 3000, "  ", "Spark splits", "\u2028", "polygenelubricants"] + [f"line {n}" for n in range(40)]


def test_slices_are_by_the_hash_of_the_line(spark, tmp_path):
    path = tmp_path / "lines.txt"
    path.write_bytes("\r\n".join(LINES).encode())
    whole = [(n, x) for n, x in enumerate(LINES) if x.strip()]
    for subtask in range(3):
        reader, cursor, seen = replay.LineReader(str(path), 4, subtask, 3), None, []
        while cursor is None or cursor["line"] < len(LINES):
            start = cursor or reader.initialOffset()
            rows, cursor = reader.read(start)
            rows = list(rows)
            assert rows == list(reader.readBetweenOffsets(start, cursor))
            seen += rows
        assert seen == [(n, x) for n, x in whole if _string_hash(x) % 3 == subtask]
    with pytest.raises(ValueError, match="belongs to"):
        replay.LineReader(str(path), 4, 1, 3).read(replay.LineReader(str(path), 4, 2, 3).initialOffset())
    with pytest.raises(ValueError, match="subtask"):
        replay.LineReader(str(path), 4, 3, 3)


def test_slices_of_a_batch_replay_are_the_same(spark, tmp_path):
    values = [json.dumps({"id": n, "word": "🎣" * (n % 4)}, ensure_ascii=False) for n in range(60)]
    (tmp_path / "a.jsonl").write_text("\n\n".join(values))
    for subtask in range(3):
        found = jsonl.replayed_slice(spark, str(tmp_path), "id long, word string", subtask, 3).collect()
        assert sorted(r.id for r in found) == [n for n, x in enumerate(values) if _string_hash(x) % 3 == subtask]
    (tmp_path / "b.jsonl").write_text("{oops\n")
    with pytest.raises(Exception, match="[Mm]alformed"):
        [jsonl.replayed_slice(spark, str(tmp_path), "id long", n, 3).collect() for n in range(3)]


def test_a_malformed_line_of_a_replayed_stream_is_named(spark, tmp_path):
    path, seen = tmp_path / "lines.jsonl", []
    path.write_text('{"id": 1, "more": 2}\n\n{oops\n')

    def start():
        rows = replay.records(replay.lines(spark, str(path), step=2), "id long")
        return rows.writeStream.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, n: seen.extend(map(tuple, df.collect()))).start()

    query = start()
    with pytest.raises(Exception, match="line 3"):
        query.processAllAvailable()
    query.stop()
    assert seen == [(0, 1)]


def test_positions_of_a_topic_are_checked():
    assert kafka.offsets('{"clicks": {"1": 5, "0": 0}}', "clicks") == {0: 0, 1: 5}
    for bad in ('{"other": {"0": 1}}', '{"clicks": {"0": -1}}', '{"clicks": {"-1": 1}}', '{"clicks": {"x": 1}}', '{"clicks": {"0": "1"}}', '{"clicks": 3}', "[]", "{", "{}"):
        with pytest.raises(kafka.OffsetError):
            kafka.offsets(bad, "clicks")
    assert kafka.checked_restart({0: 1, 1: 2, 2: 3}, [2, 0]) == {0: 1, 2: 3}
    with pytest.raises(kafka.OffsetError, match="3"):
        kafka.checked_restart({0: 1}, [0, 3])
    assert [kafka.owned([4, 0, 3, 1, 2], n, 2) for n in (0, 1)] == [[0, 2, 4], [1, 3]]
    with pytest.raises(ValueError, match="subtask"):
        kafka.owned([0], 2, 2)
    assert kafka.lag({0: 10, 1: 3}, {0: 4, 1: 5, 2: 0}) == {0: 6, 1: 0, 2: 0}


def test_rows_are_seen_once_committed(spark, tmp_path):
    table = sinks.Table(spark, f"file://{tmp_path}/t", TWO, files=1)
    df = spark.createDataFrame([(1, "one"), (2, "two")], "id long, note string")
    assert table.read().count() == 0 and table.orphans() == []
    place, n = table.stage(df)
    assert n == 2 and table.read().count() == 0 and len(table.orphans()) == 1
    assert table.commit(0, place, n) and not table.commit(0, place, n)
    assert table.read().count() == 2 and table.orphans() == []
    assert not table.append(df, 0) and table.append(df.where("id = 1"), 1)
    assert table.read().count() == 3 and len(table.committed()) == 2
    assert not table.append(df.where("id > 5"), 2) and 2 not in table.committed()


def test_an_aborted_interval_is_replayed_once(spark, tmp_path):
    table = sinks.Table(spark, f"file://{tmp_path}/t", TWO)
    df = spark.createDataFrame([(1, "one")], "id long, note string")
    table.stage(df)  # closed, but not committed
    table.append(df, 0)
    assert table.read().count() == 1 and len(table.orphans()) == 1


def test_the_contract_names_the_column(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "id long, extra string")
    with pytest.raises(sinks.ContractError, match="extra"):
        sinks.conformed(df, TWO)
    with pytest.raises(sinks.ContractError, match="id"):
        sinks.conformed(df.select(F.col("extra").alias("note")), TWO)
    assert sinks.conformed(df.select("id"), TWO).first().note is None
    with pytest.raises(Exception, match="required column id is null"):
        sinks.conformed(spark.sql("select cast(null as bigint) id"), TWO).collect()
    with pytest.raises(sinks.ContractError, match="member_id"):
        sinks.conformed(spark.range(1).drop("id"), BROWSE_SESSIONS)


def test_a_table_of_a_catalog(spark, tmp_path):
    name = f"t{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} (id BIGINT, note STRING) USING parquet LOCATION 'file://{tmp_path}/{name}'")
    try:
        table = catalog.CatalogTable("spark_catalog", "", f"default.{name}")
        df = spark.createDataFrame([(1, "one"), (2, "two")], "n long, word string")
        fields = {"note": F.upper("word"), "id": "n"}
        assert table.append(df, 0, fields) and not table.append(df, 0, fields) and not table.append(df.where("n > 5"), 1, fields)
        assert table.append(df.where("n = 2"), 2, fields) and not table.append(df, 1, fields)
        assert sorted(map(tuple, table.load(spark).collect())) == [(1, "ONE"), (2, "TWO"), (2, "TWO")]
        with pytest.raises(sinks.ContractError, match="unknown column n"):
            table.append(df, 3)
    finally:
        spark.sql(f"DROP TABLE {name}")


def test_a_catalog_is_named_by_strings():
    table = catalog.CatalogTable("lake", "http://host:8181", "library.sessions", {"warehouse": "w"})
    assert pickle.loads(pickle.dumps(table)) == table
    assert {k.removeprefix("spark.sql.catalog.lake"): v for k, v in table.settings().items()}.items() >= {".type": "rest", ".uri": "http://host:8181", ".warehouse": "w"}.items()
    for blank in (("", "u", "t"), ("c", " ", "t"), ("c", "u", "")):
        with pytest.raises(ValueError, match="blank"):
            catalog.CatalogTable(*blank)


def test_the_console_prints_each_row(spark):
    out = []
    sinks.console("> ", out.append)(spark.range(2), 0)
    assert out == ["> Row(id=0)", "> Row(id=1)"]


def test_a_job_is_restarted_so_often_and_no_more(spark, tmp_path):
    source, calls = tmp_path / "in", []
    source.mkdir()
    (source / "a.json").write_text(json.dumps({"id": 1}))

    def start(fail_until):
        def write(df, batch):
            calls.append(batch)
            if len(calls) <= fail_until:
                raise RuntimeError("lost")
            df.count()

        stream = jsonl.replay_stream(spark, str(source), "id long")
        return stream.writeStream.option("checkpointLocation", str(tmp_path / f"cp{fail_until}")).foreachBatch(write).trigger(availableNow=True).start()

    job = supervisor.Job("ok", lambda: start(2), delay=0.01)
    assert job.run() == supervisor.FINISHED and len(job.failures) == 2 and calls == [0, 0, 0]
    assert job.status()["restarts"] == 2 and job.checkpoints()[-1]["id"] == 0 and job.metrics()[-1]["records_in"] == 1 and job.lag()
    assert not job.cancel()
    assert job.view(spark, "status").first().restarts == 2 and job.view(spark, "metrics").count() == job.view(spark, "checkpoints").count() >= 1
    assert job.view(spark, "lag").columns == ["source", "partition", "position", "end", "lag"]
    calls.clear()
    job = supervisor.Job("never", lambda: start(99), attempts=1, delay=0.01)
    assert job.run() == supervisor.FAILED and len(calls) == 2
    assert job.view(spark, "status").first().last_failure and job.status()["restarts"] == 1
    calls.clear()
    cp = str(tmp_path / "cp77")
    states = []

    def asked():
        states.append(job.state)
        return supervisor.has_checkpoint(spark, cp)

    job = supervisor.Job("nothing to go on from", lambda: start(77), delay=0.01, resumable=asked)
    assert job.run() == supervisor.FAILED and calls == [0] and states == [supervisor.FAILING] and job.status()["restarts"] == 0


def test_a_running_job_is_seen(spark, tmp_path):
    path = tmp_path / "lines.jsonl"
    path.write_text('{"id": 1}\n{"id": \n{"id": 3}\n')
    rows = jsonl.counted(replay.lines(spark, str(path), step=2), "id long")

    def start():
        return rows.writeStream.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, n: df.count()).start()

    job = supervisor.Job("live", start)
    thread = threading.Thread(target=job.run, daemon=True)
    thread.start()
    try:
        deadline = time.time() + 120
        while time.time() < deadline and sum(m["records_in"] for m in job.metrics()) < 3:
            time.sleep(0.2)
        assert job.status()["state"] == supervisor.RUNNING
        assert sum(m["deserialization_failures"] for m in job.metrics()) == 1
        gauges = dict(x.rsplit(" ", 1) for x in job.gauges().splitlines())
        assert gauges['tidewheel_current_watermark{job="live"}'] == "NaN" and gauges['tidewheel_restarts{job="live"}'] == "0"
        assert any(k.startswith('tidewheel_source_lag_records{job="live",source=') and 'partition="line"' in k for k in gauges)
        assert [(x["partition"], x["position"]) for x in job.lag() if x["partition"] == "line"] == [("line", 3)], job.intervals()[-1]["sources"]
    finally:
        cancelled = job.cancel()
        thread.join(60)
    assert cancelled and job.status()["state"] == supervisor.CANCELLED and supervisor.has_checkpoint(spark, str(tmp_path / "cp"))


def test_gauges_of_a_job_that_has_not_run():
    job = supervisor.Job("none", lambda: None)
    assert 'tidewheel_records_in{job="none"} NaN\n' in job.gauges()
    job.history = [{"batchId": 0, "numInputRows": 5, "sources": [], "eventTime": {"watermark": "1970-01-01T00:00:01.500Z"}, "stateOperators": [{"memoryUsedBytes": 7}]}]
    lines = job.gauges().splitlines()
    assert 'tidewheel_current_watermark{job="none"} 1500' in lines and 'tidewheel_state_size_bytes{job="none"} 7' in lines


def test_positions_by_partition():
    assert supervisor._positions('{"t": {"0": 3, "1": 4}}') == {"t.0": 3, "t.1": 4}
    assert supervisor._positions({"line": 2, "owner": "x"}) == supervisor._positions("{'line': 2, 'owner': 'x'}") == {"line": 2}
    assert supervisor._positions(7) == {"": 7} and supervisor._positions(None) == supervisor._positions("x") == supervisor._positions("None") == {}
