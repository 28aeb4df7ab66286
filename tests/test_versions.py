"""Runs and commits, refreshes by object, compaction, listing in rounds, reading by ranges."""

from __future__ import annotations

import io
import os
import time
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_storage import line, put, summaries

import hourtally.plans.compaction as compaction_module
import hourtally.plans.refresh as refresh_module
from hourtally.plans.compaction import CompactionReport, compact
from hourtally.plans.refresh import counts_path, refresh
from hourtally.sinks.summaries import drop_superseded_runs, read_counts, read_objects
from hourtally.sources.compacted import visible_objects
from hourtally.sources.files import _lines_of_range, list_files, read_hidden_lines

LATER = datetime(2100, 1, 1)


def counts(spark, out):
    rows = read_counts(spark, counts_path(str(out))).collect()
    return {(r["hour"].hour, r["dim"], r["key"]): r["requests"] for r in rows}


def watch(monkeypatch):
    """The paths of every scan of a refresh."""
    seen = []
    real = refresh_module.read_object_lines
    monkeypatch.setattr(refresh_module, "read_object_lines", lambda spark, paths: seen.extend(paths) or real(spark, paths))
    return seen


@pytest.mark.parametrize("step", ["write_counts", "write_documents", "write_commit"])
def test_a_run_that_dies_shows_the_old_pair(spark, tmp_path, monkeypatch, step):
    logs, out = tmp_path / "logs", tmp_path / "out"
    put(logs, "2025-11-15/14/a.log.json", [line()], 1_000)
    refresh(spark, str(logs), str(out))
    before = counts(spark, out), summaries(spark, out)
    put(logs, "2025-11-15/14/b.log.json", [line("/new")], time.time() + 100)
    real = getattr(refresh_module, step)

    def dies(*args):
        if step != "write_commit":
            real(*args)
        raise OSError("killed")

    with monkeypatch.context() as patch:
        patch.setattr(refresh_module, step, dies)
        with pytest.raises(OSError):
            refresh(spark, str(logs), str(out))
    assert (counts(spark, out), summaries(spark, out)) == before
    os.utime(logs / "2025-11-15/14/b.log.json")
    refresh(spark, str(logs), str(out))
    assert counts(spark, out)[14, "path", "/new"] == 1
    assert summaries(spark, out)["2025-11-15T14:00:00Z"][0] == {"/home": 1, "/new": 1}


def test_one_new_shard_of_a_hundred_is_one_file_read(spark, tmp_path, monkeypatch):
    logs, out = tmp_path / "logs", tmp_path / "out"
    for i in range(100):
        put(logs, f"2025-11-15/14/pod-{i}.log.json", [line(f"/{i % 7}"), line("/all"), "bad"], 1_000)
    put(logs, "2025-11-15/15/pod.log.json", [line("/other")], 1_000)
    seen = watch(monkeypatch)
    assert refresh(spark, str(logs), str(out)).malformed_lines == 100
    assert len(seen) == 2
    put(logs, "2025-11-15/14/pod +%20é.log.json", [line("/all"), line("/late", "ua9"), "bad"], time.time() + 5)
    seen.clear()
    report = refresh(spark, str(logs), str(out))
    assert [Path(p).name for p in seen] == ["pod +%20é.log.json"]
    assert (report.refreshed_hours, report.malformed_lines) == (1, 101)
    found = counts(spark, out)
    assert found[14, "path", "/all"] == 101 and found[14, "path", "/late"] == 1 and found[14, "listed", ""] == 101
    assert found[14, "userAgent", "ua1"] == 201 and found[15, "path", "/other"] == 1


def test_changed_and_vanished_objects_are_subtracted(spark, tmp_path, monkeypatch):
    logs, out, fresh = tmp_path / "logs", tmp_path / "out", tmp_path / "fresh"
    for i in range(6):
        put(logs, f"2025-11-15/14/{'_' * (i == 5)}pod-{i}.log.json", [line(f"/{i}"), line("/all")], 1_000)
    refresh(spark, str(logs), str(out))
    (logs / "2025-11-15/14/pod-1.log.json").unlink()
    put(logs, "2025-11-15/14/pod-2.log.json", [line("/two")], 900)
    put(logs, "2025-11-15/14/_pod-5.log.json", [line("/five"), line("/all"), line("/all")], time.time() + 5)
    seen = watch(monkeypatch)
    refresh(spark, str(logs), str(out))
    assert [Path(p).name for p in seen] == ["pod-2.log.json"]  # the hidden one is read by ranges
    # The same again, now from runs that hold some objects each.
    put(logs, "2025-11-15/14/pod-6.log.json", [line("/six")], time.time() + 9)
    (logs / "2025-11-15/14/_pod-5.log.json").unlink()
    refresh(spark, str(logs), str(out))
    refresh(spark, str(logs), str(fresh))
    assert counts(spark, out) == counts(spark, fresh) and summaries(spark, out) == summaries(spark, fresh)
    assert counts(spark, out)[14, "path", "/all"] == 3 and (14, "path", "/1") not in counts(spark, out)
    assert read_objects(spark, str(out)).select("stored").distinct().count() == 3


def test_superseded_runs_are_dropped(spark, tmp_path):
    logs, out = tmp_path / "logs", tmp_path / "out"
    for i in range(4):
        put(logs, f"2025-11-15/14/pod-{i}.log.json", [line(f"/{i}")], time.time() + 10 * i)
        put(logs, f"2025-11-15/{i:02}.log.json", [line()], 1_000)
        refresh(spark, str(logs), str(out))
    before = counts(spark, out), summaries(spark, out)
    assert drop_superseded_runs(spark, str(out)) == 0
    time.sleep(0.01)
    drop_superseded_runs(spark, str(out), timedelta(0))
    assert (counts(spark, out), summaries(spark, out)) == before
    assert len(list((out / "commits").glob("run=*"))) == 1
    put(logs, "2025-11-15/14/pod-1.log.json", [line("/one")], time.time() + 60)
    assert refresh(spark, str(logs), str(out)).refreshed_hours == 1
    assert counts(spark, out)[14, "path", "/one"] == 1 and (14, "path", "/1") not in counts(spark, out)
    # Runs that only hold partial counts of live objects stay.
    assert len(list((out / "partials").glob("run=*"))) >= 4


def many_shards(logs, mtime=1_000):
    for hour in (3, 4):
        for i in range(6):
            put(logs, f"2025-11-15/{hour:02}/{'_' * (i == 4)}pod-{i}.log.json", [line(f"/{i}"), "bad", "", line("/all")], mtime + i)
    put(logs, "2025-11-15/05/pod.log.json", [line("/alone")], mtime)
    put(logs, "2025-11-15/03.log.json", [line("/flat")], mtime)


def test_compaction_keeps_counts_and_freshness(spark, tmp_path):
    logs, out, again = tmp_path / "logs", tmp_path / "out", tmp_path / "again"
    many_shards(logs)
    refresh(spark, str(logs), str(out))
    before = counts(spark, out)
    assert compact(spark, str(logs), LATER) == CompactionReport(hours=2, objects=12, deleted=12)
    visible = [r["key"] for r in visible_objects(spark, str(logs)).collect()]
    assert len(visible) <= 6 and len(list((logs / "2025-11-15").rglob("*.json"))) == 2
    assert refresh(spark, str(logs), str(out)).refreshed_hours == 0
    refresh(spark, str(logs), str(again))
    only = lambda found: {k: v for k, v in found.items() if k[1] != "listed"}
    assert only(counts(spark, again)) == only(before)
    # A late shard reopens its hour, and compacting again takes over the compacted files.
    put(logs, "2025-11-15/03/late.log.json", [line("/late")], time.time() + 5)
    assert refresh(spark, str(logs), str(out)).refreshed_hours == 1
    assert counts(spark, out)[3, "path", "/all"] == 6 and counts(spark, out)[3, "path", "/late"] == 1
    assert compact(spark, str(logs), LATER, least_objects=2).hours >= 1
    assert refresh(spark, str(logs), str(out)).refreshed_hours == 0
    assert compact(spark, str(logs), datetime(2025, 11, 15, 3, 30), least_objects=1).hours == 0


@pytest.mark.parametrize("step", ["before the commit", "before deleting"])
def test_a_compaction_that_dies_loses_nothing(spark, tmp_path, monkeypatch, step):
    logs, out = tmp_path / "logs", tmp_path / "out"
    many_shards(logs)
    refresh(spark, str(logs), str(out))
    before = counts(spark, out)

    def dies(*_, **__):
        raise OSError("killed")

    with monkeypatch.context() as patch:
        if step == "before deleting":
            patch.setattr(compaction_module, "delete_replaced", dies)
        else:
            real = compaction_module.compacted_path
            patch.setattr(compaction_module, "compacted_path", lambda root, table: dies() if table.startswith("commits") else real(root, table))
        with pytest.raises(OSError):
            compact(spark, str(logs), LATER)
    for _ in range(2):
        fresh = tmp_path / f"fresh{_}"
        refresh(spark, str(logs), str(fresh))
        assert {k: v for k, v in counts(spark, fresh).items() if k[1] != "listed"} == {k: v for k, v in before.items() if k[1] != "listed"}
        assert refresh(spark, str(logs), str(out)).refreshed_hours == 0
        compact(spark, str(logs), LATER)
    assert len(list((logs / "2025-11-15").rglob("*.json"))) == 2


def test_listing_in_rounds_finds_every_file(spark, tmp_path):
    names = {f"only/{a}/{b}/f{c}.txt" for a in range(5) for b in range(4) for c in range(3)} | {"top.txt", "only/_x/.y/z"}
    for name in names:
        put(tmp_path, name, ["x"])
    (tmp_path / "only" / "none").mkdir()
    root = f"file:{tmp_path}"
    for entries in (1, 7, 20_000):
        rows = list_files(spark, root, entries=entries).collect()
        assert sorted(r["key"] for r in rows) == sorted(f"{root}/{name}" for name in names)
        assert all(r["bytes"] == 2 and r["modified"] for r in rows)
    assert list_files(spark, root, {"nothing"}).count() == 0


def test_wide_trees_are_listed_by_many_tasks(spark, tmp_path):
    for a in range(40):
        put(tmp_path, f"one/{a}/f.txt", ["x"])
    listed = list_files(spark, f"file:{tmp_path}", entries=3)
    files = listed.select(F.input_file_name().alias("part")).distinct().count()
    assert files > 4 and listed.count() == 40


def test_ranges_of_a_file_share_its_lines(spark, tmp_path):
    text = b"".join(b"%d" % i * (i % 9) + b"\n" for i in range(200)) + b"last"
    for size in (1, 2, 7, 64, 10_000):
        got = [x for start in range(0, len(text), size) for x in _lines_of_range(io.BytesIO(text), start, start + size)]
        assert got == text.decode().split("\n")
    path = tmp_path / "_x.log.json"
    path.write_bytes(text)
    listed = spark.createDataFrame([(f"file:{path}", len(text)), (f"file:{tmp_path}/_none", 0)], "key string, bytes bigint")
    lines = read_hidden_lines(listed, 100)
    assert sorted(r["value"] for r in lines.collect()) == sorted(text.decode().split("\n"))
    assert lines.select(F.spark_partition_id()).distinct().count() > 1
