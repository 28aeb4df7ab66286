"""Hourly logs, listings, summaries: the file round trip."""

from __future__ import annotations

import json
import os
from datetime import datetime, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hourtally.functions.keys import (
    hour_from_flat_path,
    hour_from_key,
    hour_from_summary_key,
    sanitize_writer_id,
    token_of_file_path,
)
from hourtally.operators.counters import run_counters
from hourtally.operators.ingest import batch_outcomes
from hourtally.operators.documents import summary_documents
import hourtally.plans.refresh as refresh_module
from hourtally.plans.ingest import publish_batches, store_batches
from hourtally.plans.refresh import (
    RefreshReport,
    counts_path,
    refresh,
    refresh_current_hour,
    refresh_hour,
    runs_path,
    summaries_path,
)
from hourtally.schema import RAW_BATCH
from hourtally.sinks.dead_letters import read_producer_dead_letters
from hourtally.sinks.hourly_logs import compression_option, write_hourly
from hourtally.sinks.summaries import committed_hours, read_counts, read_documents
from hourtally.sources.batches import read_body_files, stream_body_files
from hourtally.sources.listing import list_log_objects

RECORDS = [
    ("2025-01-02T10:15:00+07:00", "/home", "ua1"),
    ("2025-01-02T03:30:00Z", "/about", "ua2"),
    ("2025-01-02T04:45:00.5Z", "/contact<&>", "ua3"),
]


def records(spark, rows=RECORDS):
    frame = spark.createDataFrame(rows, "timestamp string, path string, userAgent string")
    return frame.withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def line(path="/home", agent="ua1", ts="2025-11-15T14:00:00Z"):
    return json.dumps({"timestamp": ts, "path": path, "userAgent": agent})


def put(root: Path, key: str, lines: list[str], mtime: float | None = None) -> Path:
    target = root / key
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_bytes("".join(text + "\n" for text in lines).encode())
    if mtime is not None:
        os.utime(target, (mtime, mtime))
    return target


def stored_lines(root: Path) -> dict[str, list[dict]]:
    found = {}
    for file in sorted(root.rglob("part-*")):
        folder = str(file.parent.relative_to(root))
        found.setdefault(folder, []).extend(json.loads(text) for text in file.read_text().splitlines())
    return found


def summaries(spark, analytics) -> dict[str, tuple[dict, dict]]:
    if not Path(summaries_path(str(analytics))).exists():
        return {}
    merged = {}
    for row in read_documents(spark, summaries_path(str(analytics))).collect():
        document = json.loads(row["value"])
        assert list(document) == ["hour", "requestsPerPath", "requestsPerUserAgent"]
        for name in ("requestsPerPath", "requestsPerUserAgent"):
            assert list(document[name]) == sorted(document[name], key=str.encode)
        paths, agents = merged.setdefault(document["hour"], ({}, {}))
        assert not set(paths) & set(document["requestsPerPath"])
        paths.update(document["requestsPerPath"])
        agents.update(document["requestsPerUserAgent"])
    return merged


def test_write_hourly_groups_by_utc_hour(spark, tmp_path):
    write_hourly(records(spark), str(tmp_path / "logs"))
    lines = stored_lines(tmp_path / "logs")
    assert {folder: len(found) for folder, found in lines.items()} == {
        "date=2025-01-02/hour=03": 2,
        "date=2025-01-02/hour=04": 1,
    }
    assert lines["date=2025-01-02/hour=04"] == [
        {"timestamp": "2025-01-02T04:45:00.5Z", "path": "/contact<&>", "userAgent": "ua3"}
    ]


def test_two_writers_keep_both(spark, tmp_path):
    for name in ("/from-a", "/from-b"):
        write_hourly(records(spark, [("2025-01-02T03:00:00Z", name, "u")]), str(tmp_path / "logs"))
    lines = stored_lines(tmp_path / "logs")
    assert sorted(r["path"] for r in lines["date=2025-01-02/hour=03"]) == ["/from-a", "/from-b"]


def test_hot_hour_is_split_over_tasks(spark, tmp_path):
    """Half of the rows lie in one hour; they must not pass through one task."""
    hour = F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 20)
    frame = spark.range(0, 40_000, 1, 8).select(
        F.timestamp_seconds(F.lit(1_700_002_800) + hour * 3600).alias("timestamp"),
        F.concat(F.lit("/"), F.sha2(F.col("id").cast("string"), 256)).alias("path"),
        F.lit("ua").alias("userAgent"),
    )
    advisory = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(advisory)
    spark.conf.set(advisory, "256k")
    try:
        write_hourly(frame, str(tmp_path / "logs"))
    finally:
        spark.conf.set(advisory, before)
    files = {f.name: len(list(f.glob("part-*"))) for f in (tmp_path / "logs").rglob("hour=*")}
    # Hours that share the reducer of the hot one are split with it, others are not.
    assert max(files.values()) > 3 and min(files.values()) == 1
    refresh(spark, str(tmp_path / "logs"), str(tmp_path / "out"))
    totals = [sum(agents.values()) for _, agents in summaries(spark, tmp_path / "out").values()]
    assert sorted(totals, reverse=True) == [20_000] + [2_000] * 10


def test_empty_write(spark, tmp_path):
    write_hourly(records(spark, []), str(tmp_path / "logs"))
    assert stored_lines(tmp_path / "logs") == {}


@pytest.mark.parametrize(
    ("name", "codec"),
    [
        ("", "none"),
        (None, "none"),
        ("none", "none"),
        (" GZIP ", "gzip"),
        ("Snappy", "snappy"),
        ("lz4", "lz4"),
        ("zstd", "zstd"),
        ("zstandard", "zstd"),
        ("brotli", "none"),
    ],
)
def test_compression_option(name, codec):
    assert compression_option(name) == codec


def test_compressed_hours_can_be_summarised(spark, tmp_path):
    write_hourly(records(spark), str(tmp_path / "logs"), compression="gzip")
    assert list((tmp_path / "logs").rglob("*.gz"))
    refresh(spark, str(tmp_path / "logs"), str(tmp_path / "out"))
    assert summaries(spark, tmp_path / "out")["2025-01-02T03:00:00Z"][0] == {"/home": 1, "/about": 1}


KEYS = {
    "logs/2026-01-01/09/pod-a-1.log.json": "09",
    "logs/2026-01-01/10.log.json": "10",
    "logs/not-a-date/file.log.json": None,
    "logs/2026-01-01/09/10.log.json": "09",
    "logs/2026-01-01/9.log.json": "09",
    "2026-01-01/9/x.log.json": "09",
    "2026-01-01/23.log.json": "23",
    "/a/b/2026-01-01/10.log.json/ ": "10",
    "x/date=2026-01-01/hour=07/part-0.txt": "07",
    "logs/2026-01-01/25.log.json": None,
    "logs/2026-02-30/10.log.json": None,
    "logs/2026-01-01/09/pod.txt": None,
    "2026-01-01.log.json": None,
    "": None,
}


def test_hours_from_keys(spark):
    frame = spark.createDataFrame([(key,) for key in KEYS], "key string")
    for row in frame.select("key", hour_from_key(F.col("key")).alias("hour")).collect():
        want = KEYS[row["key"]]
        assert row["hour"] == (want and datetime(2026, 1, 1, int(want))), row["key"]
    flat = {
        "file:/r/2026-01-01/10.log.json": 10,
        "file:/r/2026-01-01/7.log.json": 7,
        "file:/r/x/2026-01-01/10.log.json": None,
        "file:/r/2026-01-01/09/pod.log.json": None,
        "file:/other/2026-01-01/10.log.json": None,
    }
    frame = spark.createDataFrame([(key,) for key in flat], "key string")
    for row in frame.select("key", hour_from_flat_path(F.col("key"), "file:/r/").alias("hour")).collect():
        assert row["hour"] == (flat[row["key"]] and datetime(2026, 1, 1, flat[row["key"]]))
    tokens = {
        "file:/r/2026-01-01/9.log.json": "2026-01-01/09",
        "file:/r/2026-01-01/09/10.log.json": "2026-01-01/09",
        "file:/r/date=2026-01-01/hour=11/part-0.txt": "2026-01-01/11",
    }
    frame = spark.createDataFrame([(key,) for key in tokens], "key string")
    for row in frame.select("key", token_of_file_path(F.col("key")).alias("token")).collect():
        assert row["token"] == tokens[row["key"]]
    keys = {"s/2026-01-01/summary_09.json": 9, "s/date=2026-01-01/hour=08/part-0.txt": 8, "s/2026-01-01/09.json": None}
    frame = spark.createDataFrame([(key,) for key in keys], "key string")
    for row in frame.select("key", hour_from_summary_key(F.col("key")).alias("hour")).collect():
        assert row["hour"] == (keys[row["key"]] and datetime(2026, 1, 1, keys[row["key"]]))


def test_writer_ids(spark):
    ids = {" pod a/1 ": "pod-a-1", "--x--": "x", "é": "", "": "", "A_b.9-": "A_b.9"}
    frame = spark.createDataFrame([(value,) for value in ids], "value string")
    for row in frame.select("value", sanitize_writer_id(F.col("value")).alias("id")).collect():
        assert row["id"] == ids[row["value"]]


def test_listing_is_sorted_and_filtered(spark, tmp_path):
    for name in ("pod-a-2.log.json", "not-log.txt", "pod-a-1.log.json"):
        put(tmp_path, f"logs/2026-01-01/09/{name}", ["x"])
    rows = list_log_objects(spark, str(tmp_path / "logs")).collect()
    assert [row["key"].rsplit("/", 1)[1] for row in rows] == ["pod-a-1.log.json", "pod-a-2.log.json"]
    assert list_log_objects(spark, str(tmp_path / "nowhere")).collect() == []


def test_refresh_all_layouts(spark, tmp_path):
    logs, out = tmp_path / "logs", tmp_path / "out"
    put(logs, "2025-11-15/14.log.json", [line(), line(), line("/login", "ua2")])
    put(logs, "2025-11-15/14/pod-a-1.log.json", [line("/shard")])
    put(logs, "2025-11-15/14/ignored.txt", [line("/ignored")])
    put(logs, "2025-11-15/15/pod-b-2.log.json", [line("/contact")])
    put(logs, "deep/er/2025-11-16/8.log.json", [line("/legacy")])
    put(logs, "elsewhere/file.log.json", [line("/nowhere")])
    write_hourly(records(spark, [("2025-11-15T15:10:00Z", "/hive", "ua9")]), str(logs))
    report = refresh(spark, str(logs), str(out))
    assert report == RefreshReport(refreshed_hours=3, failed_hours=0, malformed_lines=0, skipped_objects=1)
    assert summaries(spark, out) == {
        "2025-11-15T14:00:00Z": ({"/home": 2, "/login": 1, "/shard": 1}, {"ua1": 3, "ua2": 1}),
        "2025-11-15T15:00:00Z": ({"/contact": 1, "/hive": 1}, {"ua1": 1, "ua9": 1}),
        "2025-11-16T08:00:00Z": ({"/legacy": 1}, {"ua1": 1}),
    }
    counts = read_counts(spark, counts_path(str(out))).where("date = '2025-11-15' and hour_token = '15'")
    assert {(r["dim"], r["key"], r["requests"]) for r in counts.collect()} == {
        ("path", "/contact", 1),
        ("path", "/hive", 1),
        ("userAgent", "ua1", 1),
        ("userAgent", "ua9", 1),
        ("listed", "", 2),
    }
    # Nothing is stale any more; the run is counted all the same.
    assert refresh(spark, str(logs), str(out)) == RefreshReport(skipped_objects=1)
    runs = spark.read.json(runs_path(str(out)))
    assert run_counters(runs).collect()[0]["value"] == 2


def test_flat_layout_takes_only_flat_files(spark, tmp_path):
    logs, out = tmp_path / "logs", tmp_path / "out"
    put(logs, "2025-11-15/14.log.json", [line()])
    put(logs, "2025-11-15/14/pod-a-1.log.json", [line("/shard")])
    put(logs, "x/2025-11-15/15.log.json", [line("/deep")])
    report = refresh(spark, str(logs), str(out), layout="flat")
    assert (report.refreshed_hours, report.skipped_objects) == (1, 2)
    assert summaries(spark, out) == {"2025-11-15T14:00:00Z": ({"/home": 1}, {"ua1": 1})}


def test_odd_lines(spark, tmp_path):
    logs, out = tmp_path / "logs", tmp_path / "out"
    good = [
        line(),
        "  " + line() + "\t\r",
        "{}",
        "null",
        '{"path":"/home"}',
        '{"PATH":"/home","timestamp":null}',
        '{"userAgent":"ua1","path":"/ho\\u006de","timestamp":"2025-11-15T14:00:00+02:00"}',
        '{"path":"/x","path":"/home","userAgent":"ua1","n":1e999}',
    ]
    bad = [
        "{not-json",
        '{"path":1}',
        line(ts="yesterday"),
        line(ts=""),
        line() + " x",
        line() + line(),
        "[]",
        '"text"',
        "7",
    ]
    put(logs, "2025-11-15/14.log.json", good + ["", "  ", "\r"] + bad)
    report = refresh(spark, str(logs), str(out))
    assert report.malformed_lines == len(bad)
    assert summaries(spark, out) == {
        "2025-11-15T14:00:00Z": ({"": 2, "/home": 6}, {"": 4, "ua1": 4}),
    }


def test_empty_and_wholly_malformed_hours_get_empty_summaries(spark, tmp_path):
    logs, out = tmp_path / "logs", tmp_path / "out"
    put(logs, "2025-11-15/14.log.json", [])
    put(logs, "2025-11-15/15.log.json", ["{"])
    assert refresh(spark, str(logs), str(out)).refreshed_hours == 2
    assert summaries(spark, out) == {
        "2025-11-15T14:00:00Z": ({}, {}),
        "2025-11-15T15:00:00Z": ({}, {}),
    }


def test_hour_that_becomes_empty(spark, tmp_path):
    logs, out = tmp_path / "logs", tmp_path / "out"
    put(logs, "2025-11-15/14.log.json", [line()], 1_000)
    refresh(spark, str(logs), str(out))
    put(logs, "2025-11-15/14.log.json", [], 5_000_000_000)
    refresh(spark, str(logs), str(out))
    assert summaries(spark, out) == {"2025-11-15T14:00:00Z": ({}, {})}
    dims = [r["dim"] for r in read_counts(spark, counts_path(str(out))).collect()]
    assert dims == ["listed"]


def test_overlong_line_fails_only_its_hour(spark, tmp_path):
    logs, out = tmp_path / "logs", tmp_path / "out"
    fits = line("/" + "x" * (1_048_575 - len(line("/"))))
    assert len(fits) == 1_048_575
    put(logs, "2025-11-15/13.log.json", [fits])
    put(logs, "2025-11-15/14.log.json", [line(), fits + " "])
    put(logs, "2025-11-15/15.log.json", [line()])
    report = refresh(spark, str(logs), str(out))
    assert (report.refreshed_hours, report.failed_hours) == (2, 1)
    found = summaries(spark, out)
    assert set(found) == {"2025-11-15T13:00:00Z", "2025-11-15T15:00:00Z"}
    # The failed hour keeps being tried.
    put(logs, "2025-11-15/14.log.json", [line()])
    assert refresh(spark, str(logs), str(out)).refreshed_hours == 1
    assert len(summaries(spark, out)) == 3


def test_freshness_boundary(spark, tmp_path):
    logs, out = tmp_path / "logs", tmp_path / "out"
    commits = {}
    for hour in (10, 11, 12, 13):
        put(logs, f"2025-11-15/{hour}.log.json", [line()], 1_700_000_000)
        refresh_hour(spark, str(logs), str(out), datetime(2025, 11, 15, hour))
        (commits[hour],) = set((out / "commits").iterdir()) - set(commits.values())
    for hour in (10, 11, 12, 13):
        put(logs, f"2025-11-15/{hour}.log.json", [line("/new")], 1_700_000_000)
    for hour, mtime in ((10, 1_699_999_999), (11, 1_700_000_000), (12, 1_700_000_001)):
        for file in commits[hour].glob("part-*"):
            os.utime(file, (mtime, mtime))
    for file in commits[13].iterdir():
        file.unlink()
    assert refresh(spark, str(logs), str(out)).refreshed_hours == 2
    found = {hour: list(paths)[0] for hour, (paths, _) in summaries(spark, out).items()}
    assert found == {
        "2025-11-15T10:00:00Z": "/new",
        "2025-11-15T11:00:00Z": "/home",
        "2025-11-15T12:00:00Z": "/home",
        "2025-11-15T13:00:00Z": "/new",
    }


def test_log_written_while_counting(spark, tmp_path, monkeypatch):
    """A log that arrives after the listing but before the summary is not lost."""
    logs, out = tmp_path / "logs", tmp_path / "out"
    put(logs, "2025-11-15/14/a.log.json", [line()], 1_000)
    put(logs, "2025-11-15/15/a.log.json", [line()], 1_000)
    real = refresh_module.write_documents
    written = []

    def slow_write(documents, root):
        if not written:
            put(logs, "2025-11-15/14/b.log.json", [line("/late")], 2_000)
        written.append(root)
        real(documents, root)

    monkeypatch.setattr(refresh_module, "write_documents", slow_write)
    assert refresh(spark, str(logs), str(out)).refreshed_hours == 3
    assert len(written) == 2
    assert summaries(spark, out)["2025-11-15T14:00:00Z"][0] == {"/home": 1, "/late": 1}


def test_single_hour(spark, tmp_path):
    logs, out = tmp_path / "logs", tmp_path / "out"
    put(logs, "2025-11-15/14.log.json", [line()])
    put(logs, "2025-11-15/15/pod.log.json", [line("/login")])
    put(logs, "2025-11-16/14.log.json", [line("/other")])
    moment = datetime(2025, 11, 15, 15, 59, tzinfo=timezone.utc)
    assert refresh_hour(spark, str(logs), str(out), moment).refreshed_hours == 1
    assert summaries(spark, out) == {"2025-11-15T15:00:00Z": ({"/login": 1}, {"ua1": 1})}
    assert refresh_current_hour(spark, str(logs), str(out), now=moment.replace(hour=14)).refreshed_hours == 1
    assert len(summaries(spark, out)) == 2
    days = iter((["2025-11-15"], ["2025-11-16"]))
    assert refresh(spark, str(logs), str(out), dates=lambda: next(days)).refreshed_hours == 0
    assert refresh(spark, str(logs), str(out), dates=lambda: next(days)).refreshed_hours == 1
    missing = refresh_hour(spark, str(logs), str(out), moment.replace(hour=3))
    assert missing == RefreshReport()


def test_scans_in_groups(spark, tmp_path):
    """The same result when the stale folders take several scans."""
    logs, out = tmp_path / "logs", tmp_path / "out"
    for hour in range(5):
        put(logs, f"2025-11-15/{hour:02}/pod.log.json", [line(f"/{hour}")])
    put(logs, "stray.log.json", [line("/stray")])
    refresh_hour(spark, str(logs), str(out), datetime(2025, 11, 15, 2))
    run_of = lambda: {r["hour"].hour: r["run"] for r in committed_hours(spark, str(out)).collect()}
    before = run_of()
    assert refresh(spark, str(logs), str(out), paths_per_scan=2).refreshed_hours == 4
    assert before == {2: run_of()[2]} and len(set(run_of().values())) == 2
    assert {list(paths)[0] for paths, _ in summaries(spark, out).values()} == {f"/{h}" for h in range(5)}


def test_documents_in_parts(spark, tmp_path):
    logs, out = tmp_path / "logs", tmp_path / "out"
    put(logs, "2025-11-15/14.log.json", [line(f"/{i}", f"ua{i % 90}") for i in range(500)])
    put(logs, "2025-11-15/15.log.json", [line()])
    refresh(spark, str(logs), str(out), document_parts=8)
    found = summaries(spark, out)
    assert found["2025-11-15T14:00:00Z"][0] == {f"/{i}": 1 for i in range(500)}
    assert sum(found["2025-11-15T14:00:00Z"][1].values()) == 500
    assert found["2025-11-15T15:00:00Z"] == ({"/home": 1}, {"ua1": 1})
    counts = read_counts(spark, counts_path(str(out)))
    parts = {r["hour"].hour: r["n"] for r in summary_documents(counts, 8).groupBy("hour").agg(F.count("*").alias("n")).collect()}
    assert parts[15] <= 3 and parts[14] == 8


def test_missing_log_root(spark, tmp_path):
    assert refresh(spark, str(tmp_path / "none"), str(tmp_path / "out")) == RefreshReport()


def test_failing_run_is_recorded(spark, tmp_path):
    logs, out = tmp_path / "logs", tmp_path / "out"
    put(logs, "2025-11-15/14.log.json", [line()])
    out.mkdir()
    (out / "counts").write_text("in the way")
    with pytest.raises(Exception):
        refresh(spark, str(logs), str(out))
    runs = spark.read.json(runs_path(str(out))).collect()
    assert len(runs) == 1 and runs[0]["error"]


def batches(spark):
    rows = [
        ("a", "application/json", "[%s,%s]" % (line("/1"), line("/2", ts="2025-11-15T15:00:00Z"))),
        ("b", "application/json", "[]"),
        ("c", "text/csv", "2025-11-15T14:30:00Z,/3,ua"),
    ]
    return spark.createDataFrame(rows, RAW_BATCH)


def test_store_batches(spark, tmp_path):
    logs = tmp_path / "logs"
    totals = store_batches(batches(spark), str(logs), str(tmp_path / "rejects"))
    assert totals["log_batches_received_total"] == 2
    assert totals["logs_ingested_total"] == 3
    assert totals["invalid_requests_total"] == 1
    assert {k: sorted(r["path"] for r in v) for k, v in stored_lines(logs).items()} == {
        "date=2025-11-15/hour=14": ["/1", "/3"],
        "date=2025-11-15/hour=15": ["/2"],
    }
    rejects = spark.read.parquet(str(tmp_path / "rejects")).collect()
    assert [(r["batch_id"], r["status"], r["reason"]) for r in rejects] == [("b", 400, "no log records provided")]


def test_publish_failure_becomes_dead_letters(spark, tmp_path):
    def broken(_):
        raise OSError("dial tcp: connection refused\nmore")

    published = []
    totals = publish_batches(batches(spark), lambda df: published.append(df.count()), str(tmp_path / "dlq"))
    assert totals == {
        "log_batches_received_total": 2,
        "invalid_requests_total": 1,
        "logs_ingested_total": 3,
        "ingest_errors_total": 0,
    }
    assert published == [3] and not (tmp_path / "dlq").exists()
    totals = publish_batches(batches(spark), broken, str(tmp_path / "dlq"))
    assert totals["ingest_errors_total"] == 2 and totals["logs_ingested_total"] == 0
    letters = read_producer_dead_letters(spark, str(tmp_path / "dlq")).collect()
    assert sorted(len(r["records"]) for r in letters) == [1, 2]
    assert {r["reason"] for r in letters} == {"dial tcp: connection refused"}
    assert all(r["time"] is not None and r["records"][0]["timestamp"] is not None for r in letters)
    assert list((tmp_path / "dlq").glob("date=*"))


def test_body_files(spark, tmp_path):
    folder = tmp_path / "bodies"
    put(folder, "day/one.json", ["[%s," % line("/1"), "%s]" % line("/2")])
    put(folder, "two.csv", ["2025-11-15T14:30:00Z,/3,ua"])
    put(folder, "three.xml", ["<logs/>"])
    put(folder, "four.json", ["[" + line("/" + "x" * 500) + "]"])
    put(folder, "day/empty.json", [])
    put(folder, "empty.csv", [])
    put(folder, "_hidden.json", ["[" + line("/4") + "]"])
    put(folder, ".five.csv", ["x" * 500])
    frame = read_body_files(spark, str(folder), max_body_bytes=400)
    got = {Path(r["batch_id"]).name: r for r in batch_outcomes(frame, max_body_bytes=400).collect()}
    assert {name: r["status"] for name, r in got.items()} == {
        "one.json": 202,
        "two.csv": 202,
        "three.xml": 415,
        "four.json": 413,
        "empty.json": 400,
        "empty.csv": 400,
        "_hidden.json": 202,
        ".five.csv": 413,
    }
    assert [r["path"] for r in got["one.json"]["records"]] == ["/1", "/2"]
    # As a stream, which shows neither empty nor hidden files: large ones are rejected, accepted records straight into the hourly logs.
    query = (
        stream_body_files(spark, str(folder), max_body_bytes=400)
        .writeStream.foreachBatch(
            lambda batch, _: store_batches(batch, str(tmp_path / "logs"), str(tmp_path / "rejects")) and None
        )
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    assert query.awaitTermination(120)
    assert sorted(r["path"] for rows in stored_lines(tmp_path / "logs").values() for r in rows) == ["/1", "/2", "/3"]
    rejects = spark.read.parquet(str(tmp_path / "rejects")).collect()
    # The stream's own limit is the default one, so the sizes decide here as the bodies would there.
    assert {Path(r["batch_id"]).name: r["status"] for r in rejects}["three.xml"] == 415
    assert "four.json" in {Path(r["batch_id"]).name for r in rejects}


def test_no_log_file_vanishes(spark, tmp_path):
    """Hidden names, empty shards, and folders whose names look like patterns."""
    logs, out = tmp_path / "l[1]{a,b} *?%20", tmp_path / "out"
    for name in ("pod", "_pod", ".pod", "t[1]", "{x}", "a b", "p%20q", "s*"):
        put(logs, f"2025-11-15/14/{name}.log.json", [line(f"/{name}"), "bad"])
    put(logs, "2025-11-15/15/only.log.json", [])
    put(logs, "2025-11-15/16/_only.log.json", [])
    put(logs, "2025-11-15/17/_temporary/0/x.log.json", [line("/unfinished")])
    put(logs, "date=2025-11-15/hour=18/part-0.txt", [line("/written")])
    put(logs, "date=2025-11-15/hour=18/.part-0.txt.crc", ["checksum"])
    report = refresh(spark, str(logs), str(out))
    assert report.refreshed_hours == 4 and report.malformed_lines == 8
    found = summaries(spark, out)
    names = {f"/{n}": 1 for n in ("pod", "_pod", ".pod", "t[1]", "{x}", "a b", "p%20q", "s*")}
    assert found["2025-11-15T14:00:00Z"] == (names, {"ua1": 8})
    assert found["2025-11-15T15:00:00Z"] == found["2025-11-15T16:00:00Z"] == ({}, {})
    assert found["2025-11-15T18:00:00Z"][0] == {"/written": 1}
    assert refresh(spark, str(logs), str(out)).refreshed_hours == 0


def test_flat_files_and_shards_of_one_hour(spark, tmp_path):
    logs = tmp_path / "logs"
    for hour in range(6):
        put(logs, f"2026-01-01/{hour:02}.log.json", [line("/flat")])
        put(logs, f"2026-01-01/{hour:02}/pod.log.json", [line("/shard")])
    for layout, want in (("flat", {"/flat": 1}), ("any", {"/flat": 1, "/shard": 1})):
        for paths_per_scan in (1, 5, 2000):
            out = tmp_path / f"{layout}{paths_per_scan}"
            assert refresh(spark, str(logs), str(out), layout=layout, paths_per_scan=paths_per_scan).refreshed_hours == 6
            assert [paths for paths, _ in summaries(spark, out).values()] == [want] * 6


def test_many_days_are_listed(spark, tmp_path):
    days = [f"{2020 + i // 300}-{1 + i // 28 % 10:02}-{1 + i % 28:02}" for i in range(900)]
    for day in set(days):
        put(tmp_path, f"{day}/03/x.log.json", [line()])
    assert list_log_objects(spark, str(tmp_path)).count() == len(set(days))
    assert list_log_objects(spark, str(tmp_path), sorted(set(days))[:40]).count() == 40


def test_years_that_no_folder_can_hold(spark, tmp_path):
    rows = [
        (str(i), "application/json", "[%s]" % line("/y", ts=ts))
        for i, ts in enumerate(("9999-12-31T23:59:59-01:00", "0000-01-01T00:30:00+01:00", "9999-12-31T23:59:59Z", "0000-01-01T00:30:00Z"))
    ]
    totals = store_batches(spark.createDataFrame(rows, RAW_BATCH), str(tmp_path / "logs"), str(tmp_path / "rejects"))
    assert totals["ingest_errors_total"] == 2 and totals["log_batches_received_total"] == 2
    assert set(stored_lines(tmp_path / "logs")) == {"date=9999-12-31/hour=23", "date=0000-01-01/hour=00"}
    rejects = spark.read.parquet(str(tmp_path / "rejects")).collect()
    assert {(r["batch_id"], r["status"]) for r in rejects} == {("0", 500), ("1", 500)}


def test_bodies_in_hidden_folders_and_with_partition_names(spark, tmp_path):
    """Every file has one outcome, whichever way Spark's readers take its name or its folders' names."""
    names = ["a.json", "_k=1.json", "_b.json", ".c.json", "_metadata.json", "d._COPYING_", "in/_late/x.json", "in/.late/x.json"]
    names += ["_k=2/x.json", "_k=2/_x.json", "_metadata/x.json", "_metadata_2/_y/x.json", "_common_metadata/x.json", "e._COPYING_/x.json"]
    root = tmp_path / "_root" / ".in"
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name)
    rows = read_body_files(spark, str(root)).collect()
    assert sorted(r["body"] for r in rows) == sorted(names)
