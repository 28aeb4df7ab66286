"""Files as they arrive, and dead letters that are replayed."""

from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_storage import line, put, stored_lines, summaries

import hourtally.plans.replay as replay_module
from hourtally.operators.ingest import batch_outcomes
from hourtally.plans.replay import ReplayReport, replay_consumer_letters
from hourtally.schema import CONSUMER_DEAD_LETTER
from hourtally.sinks.dead_letters import write_consumer_dead_letters
from hourtally.sinks.hourly_logs import write_hourly
from hourtally.sources.batches import bodies_of, read_body_files
from hourtally.streaming.arrivals import refresh_arrivals, start_arrivals, store_arrivals, take_arrivals


def bodies(folder):
    put(folder, "day/one.json", ["[%s," % line("/1"), "%s]" % line("/2")], 1_000)
    put(folder, "two.csv", ["2025-11-15T14:30:00Z,/3,ua"], 2_000)
    put(folder, "three.xml", ["<logs/>"], 3_000)
    put(folder, "four.json", ["[" + line("/" + "x" * 500) + "]"], 4_000)
    put(folder, "day/empty.json", [], 5_000)
    put(folder, "_hidden.json", ["[" + line("/4") + "]"], 6_000)
    put(folder, ".late/.five.csv", ["x" * 500], 7_000)


def names(files):
    return sorted(Path(r["key"]).name for r in files.collect())


def test_arriving_bodies_have_the_outcomes_of_files(spark, tmp_path):
    folder = tmp_path / "bodies [1]*"
    bodies(folder)
    taken = []
    passes = take_arrivals(spark, str(folder), str(tmp_path / "state"), lambda files, n: taken.append((n, files)), max_files=3)
    assert passes == 3 and [n for n, _ in taken] == [0, 1, 2]
    got = {}
    for _, files in taken:
        for r in batch_outcomes(bodies_of(files, 400), max_body_bytes=400).collect():
            assert r["batch_id"] not in got
            got[r["batch_id"]] = (r["status"], r["reason"], r["records"])
    read = batch_outcomes(read_body_files(spark, str(folder), 400), max_body_bytes=400).collect()
    spelled = lambda key: key.replace("file:///", "file:/").replace("%20", " ").replace("%5B", "[").replace("%5D", "]")
    assert got == {spelled(r["batch_id"]): (r["status"], r["reason"], r["records"]) for r in read} and len(got) == 7
    assert take_arrivals(spark, str(folder), str(tmp_path / "state"), None) == 0


def test_a_pass_that_dies_is_handed_on_again(spark, tmp_path):
    folder, state = tmp_path / "in", str(tmp_path / "state")
    bodies(folder)

    def dies(files, number):
        raise OSError("killed")

    with pytest.raises(OSError):
        take_arrivals(spark, str(folder), state, dies, max_files=2)
    put(folder, "new.csv", ["x"], 500)
    put(folder, "two.csv", ["changed"], 9_000)
    taken = []
    take_arrivals(spark, str(folder), state, lambda files, n: taken.append((n, names(files))))
    assert taken[0] == (0, ["one.json", "two.csv"])
    assert taken[1] == (1, sorted(["new.csv", "two.csv", "three.xml", "four.json", "empty.json", "_hidden.json", ".five.csv"]))


def test_arrivals_are_stored_and_refreshed(spark, tmp_path):
    folder, logs = tmp_path / "in", tmp_path / "logs"
    bodies(folder)
    totals = store_arrivals(spark, str(folder), str(logs), str(tmp_path / "state"), str(tmp_path / "rejects"), 400, max_files=4)
    assert (totals["log_batches_received_total"], totals["logs_ingested_total"], totals["invalid_requests_total"]) == (3, 4, 4)
    assert sorted(r["path"] for rows in stored_lines(logs).values() for r in rows) == ["/1", "/2", "/3", "/4"]
    runs = []
    query = start_arrivals(spark, lambda: runs.append(1) or 1 / (len(runs) - 1), str(tmp_path / "checkpoint"), "1 second")
    query.stop()
    assert runs


def test_arriving_logs_refresh_their_days(spark, tmp_path):
    logs, out, state = tmp_path / "l{x}", tmp_path / "out", str(tmp_path / "state")
    put(logs, "2025-11-15/14/_a.log.json", [line("/hidden")])
    put(logs, "2025-11-16/14/b.log.json", [])
    assert refresh_arrivals(spark, str(logs), str(out), state) == 1
    assert summaries(spark, out) == {"2025-11-15T14:00:00Z": ({"/hidden": 1}, {"ua1": 1}), "2025-11-16T14:00:00Z": ({}, {})}
    assert refresh_arrivals(spark, str(logs), str(out), state) == 0


REASONS = ["dial tcp: refused", "disk write failed", "Leader Not Available"]


def letters(spark, start, count):
    rows = [(("2025-11-15T14:00:00Z", f"/{i}", "ua"), i % 2, i, REASONS[i % 3]) for i in range(start, start + count)]
    frame = spark.createDataFrame(rows, "record struct<timestamp: string, path: string, userAgent: string>, partition int, offset long, reason string")
    return frame.withColumn("record", F.col("record").withField("timestamp", F.to_timestamp("record.timestamp"))).to(CONSUMER_DEAD_LETTER)


@pytest.mark.parametrize("step", ["store", "_publish", "half a move", "commits"])
def test_an_interrupted_replay_stores_each_letter_once(spark, tmp_path, monkeypatch, step):
    dead, logs, ledger = (str(tmp_path / name) for name in ("dead", "logs", "ledger"))
    for _ in range(2):  # the same batch went to the dead letters twice
        write_consumer_dead_letters(letters(spark, 0, 12), dead)
    real = {name: getattr(replay_module, name) for name in ("_publish", "_note")}

    def dies(*args):
        if step == "store":
            write_hourly(*args)
        if step == "half a move":
            moved = next(Path(args[1]).rglob("part-*"))
            target = Path(logs) / moved.parent.relative_to(args[1]) / f"{args[3]}-{moved.name}"
            target.parent.mkdir(parents=True)
            moved.rename(target)
        raise OSError("killed")

    with monkeypatch.context() as patch:
        if step in ("_publish", "half a move"):
            patch.setattr(replay_module, "_publish", dies)
        elif step == "commits":
            patch.setattr(replay_module, "_note", lambda *args: dies() if args[2] == "commits" else real["_note"](*args))
        with pytest.raises(OSError):
            replay_consumer_letters(spark, dead, logs, ledger, dies if step == "store" else write_hourly)
    assert replay_consumer_letters(spark, dead, logs, ledger) == ReplayReport(8, 4)
    assert replay_consumer_letters(spark, dead, logs, ledger) == ReplayReport(0, 4)
    write_consumer_dead_letters(letters(spark, 10, 5), dead)
    assert replay_consumer_letters(spark, dead, logs, ledger).replayed == 2
    found = sorted(r["path"] for path in Path(logs).rglob("*.txt") for r in map(json.loads, path.read_text().splitlines()))
    assert found == sorted(f"/{i}" for i in range(15) if i % 3 != 1)


def test_replay_without_letters(spark, tmp_path):
    assert replay_consumer_letters(spark, str(tmp_path / "none"), str(tmp_path / "logs"), str(tmp_path / "ledger")) == ReplayReport()
