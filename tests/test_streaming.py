"""Topics, micro-batches, dead letters and refreshes on streams."""

from __future__ import annotations

import json
import os
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_storage import line, put, records, stored_lines, summaries

from hourtally.operators.counting import tumbling_counts
from hourtally.plans.refresh import refresh
from hourtally.sinks.dead_letters import read_consumer_dead_letters
from hourtally.sinks.hourly_logs import write_hourly
from hourtally.sinks.topic import topic_messages
from hourtally.sources.topic import file_messages
from hourtally.streaming.ingest import start_ingest, stream_counters
from hourtally.streaming.refresh import (
    read_windowed_counts,
    start_periodic_refresh,
    start_refresh_on_arrival,
    start_windowed_counts,
    windowed_counts,
)

WAIT = 120


def publish(folder, name, *values, partition=1, offset=0):
    rows = [{"value": v, "partition": partition, "offset": offset + i} for i, v in enumerate(values)]
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("".join(json.dumps(row) + "\n" for row in rows))


def drain(query):
    assert query.awaitTermination(WAIT)
    assert query.exception() is None
    return query


def eventually(check):
    deadline = time.monotonic() + WAIT
    while time.monotonic() < deadline:
        try:
            if check():
                return
        except Exception:  # a file was replaced while it was read
            pass
        time.sleep(0.5)
    raise AssertionError("condition not met in time")


def paths_of(root):
    return sorted(r["path"] for rows in stored_lines(root).values() for r in rows)


def test_stream_ingest(spark, tmp_path):
    topic, logs, dlq, checkpoint = (tmp_path / n for n in ("topic", "logs", "dlq", "checkpoint"))

    def run():
        return drain(start_ingest(file_messages(spark, str(topic)), str(logs), str(dlq), str(checkpoint), None))

    publish(topic, "1.json", line("/home"), "{not-json", line("/a"), offset=42)
    publish(topic, "2.json", line("/late", ts="2025-11-14T01:00:00Z"), partition=2)
    query = run()
    # One file per micro-batch, so two of them; the malformed value is gone.
    seen = [p["observedMetrics"]["ingest"] for p in query.recentProgress if p["numInputRows"]]
    assert [(m["messages"], m["decoded"], m["malformed"]) for m in map(lambda r: r.asDict(), seen)] == [(3, 2, 1), (1, 1, 0)]
    assert {k: len(v) for k, v in stored_lines(logs).items()} == {
        "date=2025-11-14/hour=01": 1,
        "date=2025-11-15/hour=14": 2,
    }
    assert not dlq.exists()
    # Started again, only what is new is stored; equal records are all kept.
    publish(topic, "3.json", line("/home"), line("/home"))
    run()
    assert paths_of(logs) == ["/a", "/home", "/home", "/home", "/late"]


def test_missing_time_is_stored_under_the_zero_hour(spark, tmp_path):
    publish(tmp_path / "topic", "1.json", '{"path":"/x"}')
    drain(
        start_ingest(
            file_messages(spark, str(tmp_path / "topic")),
            str(tmp_path / "logs"),
            str(tmp_path / "dlq"),
            str(tmp_path / "checkpoint"),
            None,
            name="zero",
        )
    )
    assert stored_lines(tmp_path / "logs") == {
        "date=0001-01-01/hour=00": [{"timestamp": "0001-01-01T00:00:00Z", "path": "/x", "userAgent": ""}]
    }


def test_stream_ingest_by_time(spark, tmp_path):
    topic, logs = tmp_path / "topic", tmp_path / "logs"
    publish(topic, "1.json", line("/1"))
    query = start_ingest(
        file_messages(spark, str(topic)), str(logs), str(tmp_path / "dlq"), str(tmp_path / "checkpoint"), name="timed"
    )
    try:
        eventually(lambda: paths_of(logs) == ["/1"])
        publish(topic, "2.json", line("/2"))
        eventually(lambda: paths_of(logs) == ["/1", "/2"])
    finally:
        query.stop()


def test_stream_dead_letters(spark, tmp_path):
    topic, logs, dlq = (tmp_path / n for n in ("topic", "logs", "dlq"))
    publish(topic, "1.json", line("/bad"), "{not-json", line("/worse"), offset=7)
    os.utime(topic / "1.json", (1_000, 1_000))
    publish(topic, "2.json", line("/good"))
    calls = []

    def store(batch, root):
        calls.append(1)
        if len(calls) == 1:
            raise OSError("disk write failed")
        write_hourly(batch, root)

    drain(
        start_ingest(
            file_messages(spark, str(topic)), str(logs), str(dlq), str(tmp_path / "checkpoint"), None, store, "dlq"
        )
    )
    assert paths_of(logs) == ["/good"]
    letters = read_consumer_dead_letters(spark, str(dlq)).collect()
    got = sorted((r["record"]["path"], r["partition"], r["offset"], r["reason"]) for r in letters)
    assert got == [("/bad", 1, 7, "disk write failed"), ("/worse", 1, 9, "disk write failed")]
    assert {r["record"]["timestamp"] for r in letters} == {datetime(2025, 11, 15, 14)}


def test_other_errors_stop_the_stream(spark, tmp_path):
    publish(tmp_path / "topic", "1.json", line())

    def store(batch, root):
        raise ValueError("a bug")

    query = start_ingest(
        file_messages(spark, str(tmp_path / "topic")),
        str(tmp_path / "logs"),
        str(tmp_path / "dlq"),
        str(tmp_path / "checkpoint"),
        None,
        store,
        "bug",
    )
    with pytest.raises(Exception, match="a bug"):
        query.awaitTermination(WAIT)
    assert not (tmp_path / "dlq").exists()


def test_stream_refresh(spark, tmp_path):
    logs, out = tmp_path / "logs", tmp_path / "out"
    write_hourly(records(spark), str(logs))
    query = start_periodic_refresh(spark, str(logs), str(out), str(tmp_path / "checkpoint"), "1 second")
    try:
        eventually(lambda: len(summaries(spark, out)) == 2)
        # A late record reopens its hour and no other.
        write_hourly(records(spark, [("2025-01-02T03:59:00Z", "/late", "ua1")]), str(logs))
        wanted = ({"/home": 1, "/about": 1, "/late": 1}, {"ua1": 2, "ua2": 1})
        eventually(lambda: summaries(spark, out).get("2025-01-02T03:00:00Z") == wanted)
        assert summaries(spark, out)["2025-01-02T04:00:00Z"] == ({"/contact<&>": 1}, {"ua3": 1})
    finally:
        query.stop()


def test_periodic_refresh_starts_at_once_and_outlives_failures(spark, tmp_path):
    runs = []

    def run(session, logs_root, analytics_root, dates):
        runs.append((logs_root, analytics_root, dates))
        if len(runs) == 1:
            raise OSError("unreachable")

    query = start_periodic_refresh(spark, "logs", "out", str(tmp_path / "checkpoint"), "1 second", run, dates=["d"])
    try:
        assert len(runs) == 1
        eventually(lambda: len(runs) >= 3)
        assert set(map(str, runs)) == {str(("logs", "out", ["d"]))}
    finally:
        query.stop()


def test_refresh_on_arrival(spark, tmp_path):
    logs, out = tmp_path / "logs", tmp_path / "out"
    put(logs, "2025-11-15/14/a-1.log.json", [line()])
    put(logs, "2025-11-16/14/a-2.log.json", [line("/other")])

    def run():
        drain(start_refresh_on_arrival(spark, str(logs), str(out), str(tmp_path / "checkpoint"), None))

    run()
    assert len(summaries(spark, out)) == 2
    put(logs, "2025-11-15/14/a-3.log.json", [line("/late")])
    run()
    assert summaries(spark, out)["2025-11-15T14:00:00Z"] == ({"/home": 1, "/late": 1}, {"ua1": 2})


def test_stream_window(spark, tmp_path):
    source = tmp_path / "source"
    rows = [("2025-01-02T03:30:00Z", "/a", "u"), ("2025-01-02T03:59:59Z", "/a", "u"), ("2025-01-02T04:00:00Z", "/a", "u")]
    records(spark, rows).coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema("timestamp timestamp, path string, userAgent string").parquet(str(source))
    query = (
        windowed_counts(stream)
        .writeStream.format("memory")
        .queryName("windowed")
        .outputMode("update")
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    drain(query)
    got = {(r["window_start"].hour, r["path"]): r["requests"] for r in spark.table("windowed").collect()}
    assert got == {(3, "/a"): 2, (4, "/a"): 1}
    batch = tumbling_counts(spark.read.parquet(str(source))).collect()
    assert {(r["window_start"].hour, r["path"]): r["requests"] for r in batch} == got


def test_late_records_correct_their_window(spark, tmp_path):
    source, root = str(tmp_path / "source"), str(tmp_path / "windows")
    schema = "timestamp timestamp, path string, userAgent string"

    def deliver(*rows):
        records(spark, list(rows)).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        drain(start_windowed_counts(stream, root, str(tmp_path / "checkpoint"), timedelta(hours=2), None))
        return {(r["window_start"].hour, r["path"]): r["requests"] for r in read_windowed_counts(spark, root).collect()}

    first = deliver(("2025-01-02T03:30:00Z", "/a", "u"), ("2025-01-02T04:30:00Z", "/a", "u"))
    assert first == {(3, "/a"): 1, (4, "/a"): 1}
    second = deliver(("2025-01-02T03:59:59Z", "/a", "u"), ("2025-01-02T03:00:00Z", "/b", "u"), ("2025-01-02T05:30:00Z", "/a", "u"))
    assert second == {(3, "/a"): 2, (3, "/b"): 1, (4, "/a"): 1, (5, "/a"): 1}
    # Two hours behind the newest record the window is closed; a refresh would still take these.
    assert deliver(("2025-01-02T02:10:00Z", "/a", "u"), ("2025-01-02T05:40:00Z", "/a", "u")) == second | {(5, "/a"): 2}


def test_topic_round_trip(spark, tmp_path):
    """What the topic sink encodes, the topic source decodes."""
    values = [row["value"] for row in topic_messages(records(spark)).collect()]
    assert json.loads(values[2]) == {"timestamp": "2025-01-02T04:45:00.5Z", "path": "/contact<&>", "userAgent": "ua3"}
    publish(tmp_path / "topic", "1.json", *values)
    drain(
        start_ingest(
            file_messages(spark, str(tmp_path / "topic")),
            str(tmp_path / "logs"),
            str(tmp_path / "dlq"),
            str(tmp_path / "checkpoint"),
            None,
            name="round_trip",
        )
    )
    assert refresh(spark, str(tmp_path / "logs"), str(tmp_path / "out")).refreshed_hours == 2


def test_source_failure_is_no_store_failure(spark, tmp_path):
    topic, logs, dlq, checkpoint = (tmp_path / n for n in ("topic", "logs", "dlq", "checkpoint"))
    publish(topic, "1.json", line("/home"))
    broken = file_messages(spark, str(topic)).withColumn("value", F.coalesce(F.raise_error(F.lit("source lost")).cast("string"), "value"))
    query = start_ingest(broken, str(logs), str(dlq), str(checkpoint), None)
    with pytest.raises(Exception, match="source lost"):
        query.awaitTermination(WAIT)
    assert not dlq.exists() and not logs.exists()


def test_unstorable_time_becomes_a_dead_letter(spark, tmp_path):
    topic, logs, dlq, checkpoint = (tmp_path / n for n in ("topic", "logs", "dlq", "checkpoint"))
    publish(topic, "1.json", line("/late", ts="9999-12-31T23:59:59-01:00"), line("/home"))
    drain(start_ingest(file_messages(spark, str(topic)), str(logs), str(dlq), str(checkpoint), None))
    assert paths_of(logs) == ["/home"]
    letters = read_consumer_dead_letters(spark, str(dlq)).select("record.path", "offset", "reason").collect()
    assert [tuple(r) for r in letters] == [("/late", 0, "timestamp outside of the years 0 to 9999")]


def test_writers_share_a_session(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: write_hourly(records(spark), str(tmp_path / f"logs{i}")), range(6)))
    assert before == (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"))
    assert sum(len(rows) for rows in stored_lines(tmp_path / "logs5").values()) == 3


def test_totals_of_a_stream_survive_a_repetition(spark, tmp_path):
    topic, counters = tmp_path / "topic", str(tmp_path / "counters")
    publish(topic, "1.json", line("/1"), "bad", line("/2", ts="9999-12-31T23:59:59-01:00"), "")

    def start(checkpoint, store=write_hourly):
        return start_ingest(
            file_messages(spark, str(topic)), str(tmp_path / "logs"), str(tmp_path / "dead"), str(tmp_path / checkpoint), None, store, "totals", counters
        )

    drain(start("checkpoint"))
    wanted = {"messages_total": 4, "malformed_messages_total": 2, "logs_ingested_total": 1, "ingest_errors_total": 1}
    assert {r["metric"]: r["value"] for r in stream_counters(spark, counters).collect()} == wanted

    def broken(records, root):
        raise OSError("disk write failed")

    drain(start("again", broken))  # the same first micro-batch, whose totals replace the earlier ones
    wanted |= {"logs_ingested_total": 0, "ingest_errors_total": 2}
    assert {r["metric"]: r["value"] for r in stream_counters(spark, counters).collect()} == wanted
    publish(topic, "2.json", line("/3"))
    drain(start("again"))
    assert {r["metric"]: r["value"] for r in stream_counters(spark, counters).collect()}["logs_ingested_total"] == 1
