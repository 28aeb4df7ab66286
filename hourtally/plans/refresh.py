"""Refreshing hourly summaries: only hours whose logs are newer than their summary.

Within such an hour only objects that are new or changed are read; the counts of
the others are taken over, and those of vanished ones subtracted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce
from itertools import islice

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hourtally.functions.keys import LOG_SUFFIX
from hourtally.operators.documents import summary_documents
from hourtally.operators.freshness import log_objects, oversized_hours, stale_hours, unexpected_objects
from hourtally.operators.lines import MAX_LINE_BYTES, count_decoded, decode_lines
from hourtally.schema import DIM_LISTED, DIM_MALFORMED
from hourtally.session import materialize, work_folder
from hourtally.sinks.summaries import (
    committed_hours,
    new_run,
    read_counts,
    read_objects,
    read_partials,
    run_path,
    table_path,
    write_commit,
    write_counts,
    write_documents,
    write_objects,
    write_partials,
)
from hourtally.sources.compacted import visible_objects
from hourtally.sources.files import is_hidden, read_hidden_lines
from hourtally.sources.hourly_logs import object_of, plain_key, read_object_lines
from hourtally.sources.listing import flat_objects, literal_path, qualified_path

# Folders (or single files) that one scan reads. All are read, group after
# group; the driver holds the names of one group.
PATHS_PER_SCAN = 2_000


@dataclass(frozen=True)
class RefreshReport:
    """What one run did. ``failed_hours`` keep the summary they had."""

    refreshed_hours: int = 0
    failed_hours: int = 0
    malformed_lines: int = 0
    skipped_objects: int = 0


def counts_path(analytics_root: str) -> str:
    return table_path(analytics_root, "counts")


def summaries_path(analytics_root: str) -> str:
    return table_path(analytics_root, "summaries")


def runs_path(analytics_root: str) -> str:
    return table_path(analytics_root, "runs")


def scan_paths(objects: DataFrame) -> DataFrame:
    """``path``: what scans have to read of listed objects ``key, fresh``.

    The folder of a sharded hour where all its objects are fresh, else the
    objects themselves, as also where a file is an hour. Objects that are hidden
    from Spark's readers are left out.
    """
    is_hour_file = F.col("key").rlike(r"/[0-9]{4}-[0-9]{2}-[0-9]{2}/[0-9]{1,2}\.log\.json\z")
    parent = F.when(is_hour_file, F.col("key")).otherwise(F.regexp_replace("key", r"/[^/]*\z", ""))
    seen = objects.where(~is_hidden(F.col("key"))).withColumn("parent", parent)
    mixed = seen.groupBy("parent").agg(F.bool_and("fresh").alias("whole")).where("not whole").select("parent")
    whole = seen.where("fresh").join(mixed, "parent", "left_anti").select(F.col("parent").alias("path")).distinct()
    return whole.unionByName(seen.where("fresh").join(mixed, "parent", "left_semi").select(F.col("key").alias("path")))


def path_groups(paths: DataFrame, paths_per_scan: int = PATHS_PER_SCAN) -> Iterator[list[str]]:
    """The paths to read, in order and in groups of at most ``paths_per_scan``."""
    names = paths.orderBy("path").toLocalIterator()
    while group := [row["path"] for row in islice(names, paths_per_scan)]:
        yield group


def count_lines(lines: DataFrame, max_line_bytes: int = MAX_LINE_BYTES) -> DataFrame:
    """``path, dim, key, requests`` of scanned lines ``value, path``."""
    return count_decoded(decode_lines(lines, max_line_bytes), "path")


def count_objects(
    spark: SparkSession,
    objects: DataFrame,
    max_line_bytes: int = MAX_LINE_BYTES,
    paths_per_scan: int = PATHS_PER_SCAN,
    folder: str | None = None,
) -> DataFrame:
    """``hour, object, dim, key, requests`` of the fresh ones of ``objects``, which must be materialized.

    Only folders and files with fresh objects are read, whatever their number.
    What a folder holds beside them, by now or by another name, is not counted.
    """
    counted = []
    for group in path_groups(scan_paths(objects), paths_per_scan):
        lines = count_lines(read_object_lines(spark, list(map(literal_path, group))), max_line_bytes)
        named = lines.select(object_of(F.col("path")).alias("object"), "dim", "key", "requests")
        counted.append(materialize(named, folder))
    hidden = objects.where(F.col("fresh") & is_hidden(F.col("key")) & F.endswith("key", F.lit(LOG_SUFFIX)))
    if not hidden.isEmpty():
        lines = count_lines(read_hidden_lines(hidden.select("key", "bytes")), max_line_bytes)
        counted.append(lines.select(plain_key(F.col("path")).alias("object"), "dim", "key", "requests"))
    if not counted:
        counted.append(spark.createDataFrame([], "object STRING, dim STRING, key STRING, requests BIGINT"))
    fresh = objects.where("fresh").select("hour", "object")
    return reduce(DataFrame.unionByName, counted).join(fresh, "object").select("hour", "object", "dim", "key", "requests")


@dataclass(frozen=True)
class _Options:
    dates: list[str] | None
    hour: datetime | None
    layout: str
    max_line_bytes: int
    paths_per_scan: int
    document_parts: int


def _locate(spark: SparkSession, logs_root: str, options: _Options, folder: str) -> tuple[DataFrame, DataFrame]:
    """The log files with their hours, and the log files that have none."""
    listing = visible_objects(spark, logs_root, options.dates, folder)
    if options.layout == "flat":
        objects = flat_objects(listing, qualified_path(spark, logs_root))
        skipped = listing.where(F.endswith("key", F.lit(LOG_SUFFIX))).join(
            objects.select("key"), "key", "left_anti"
        )
    else:
        objects = log_objects(listing)
        skipped = unexpected_objects(listing)
    if options.hour is not None:
        start = options.hour.astimezone(timezone.utc).strftime("%Y-%m-%d %H:00:00")
        objects = objects.where(F.col("hour") == F.lit(start).cast("timestamp"))
    return objects, skipped


def _state_of_hours(objects: DataFrame) -> DataFrame:
    return objects.groupBy("hour").agg(
        F.count(F.lit(1)).alias("objects"), F.sum("bytes").alias("bytes"), F.max("modified").alias("latest")
    )


def _missed_hours(before: DataFrame, now: DataFrame, summaries: DataFrame) -> DataFrame:
    """Hours that changed while they were counted and yet look fresh.

    A log written after the listing but before the summary is older than the
    summary that lacks it. Hours with still newer logs are stale anyway and
    left to the next run.
    """
    seen = before.select("hour", F.struct("objects", "bytes", "latest").alias("seen"))
    changed = now.join(seen, "hour").where(F.struct("objects", "bytes", "latest") != F.col("seen"))
    return changed.drop("seen").join(stale_hours(now, summaries).select("hour"), "hour", "left_anti")


def compare_objects(now: DataFrame, before: DataFrame) -> DataFrame:
    """Listed objects ``hour, key, modified, bytes`` beside those that the hours' counts hold.

    Adds ``object``, ``stored`` (the run whose partial counts hold it) and what
    to do: ``fresh`` ones are to be counted, ``gone`` ones, vanished or changed
    since, to be subtracted. An hour without one unchanged object is counted
    anew, with nothing to subtract.
    """
    listed = now.withColumn("object", plain_key(F.col("key")))
    held = before.select("hour", "object", F.struct("modified", "bytes", "stored").alias("held"))
    both = listed.join(held, ["hour", "object"], "full")
    same = (F.col("modified") == F.col("held.modified")) & (F.col("bytes") == F.col("held.bytes"))
    kept = F.coalesce(same, F.lit(False))
    merging = F.bool_or(kept).over(Window.partitionBy("hour"))
    return both.select(
        "hour", "object", "key", "modified", "bytes", "held.stored",
        (F.col("key").isNotNull() & ~kept).alias("fresh"),
        (F.col("held").isNotNull() & ~kept & merging).alias("gone"),
        merging.alias("merging"),
    )


def merged_counts(base: DataFrame, fresh: DataFrame, gone: DataFrame) -> DataFrame:
    """``hour, dim, key, requests``: counts plus fresh partial counts minus those of objects that are gone."""
    columns = ["hour", "dim", "key"]
    parts = base.select(*columns, "requests").unionByName(fresh.select(*columns, "requests"))
    parts = parts.unionByName(gone.select(*columns, (-F.col("requests")).alias("requests")))
    return parts.groupBy(*columns).agg(F.sum("requests").alias("requests")).where("requests > 0")


def _side_by_side(*writes: tuple[Callable[[DataFrame, str], None], DataFrame, str]) -> None:
    """Run writes as concurrent jobs; the first error is raised when all have ended."""
    with ThreadPoolExecutor(len(writes)) as pool:
        for done in [pool.submit(write, rows, folder) for write, rows, folder in writes]:
            done.result()


def _summarise(
    spark: SparkSession, analytics_root: str, objects: DataFrame, todo: DataFrame, hours: int, options: _Options, folder: str
) -> tuple[int, int]:
    """Count what is new in the hours and commit them; returns failed hours and malformed lines."""
    wanted = todo.select("hour")
    before = read_objects(spark, analytics_root).join(wanted, "hour", "left_semi")
    now = objects.join(wanted, "hour", "left_semi").select("hour", "key", "modified", "bytes")
    compared = materialize(compare_objects(now, before), folder)
    partials = materialize(
        count_objects(spark, compared.where("key is not null"), options.max_line_bytes, options.paths_per_scan, folder), folder
    )
    failed = oversized_hours(partials).select("hour").distinct()
    failed_hours = failed.count()
    if failed_hours:
        compared, partials = (rows.join(failed, "hour", "left_anti") for rows in (compared, partials))
    listed = compared.where("key is not null")
    counts = listed.groupBy("hour").agg(F.count(F.lit(1)).alias("requests"))
    counts = counts.select("hour", F.lit(DIM_LISTED).alias("dim"), F.lit("").alias("key"), "requests")
    merging = compared.where("merging").select("hour").distinct()
    if merging.isEmpty():
        scanned = partials.groupBy("hour", "dim", "key").agg(F.sum("requests").alias("requests"))
    else:
        base = read_counts(spark, counts_path(analytics_root)).where(F.col("dim") != DIM_LISTED)
        lost = compared.where("gone").select("hour", "object", "stored")
        gone = read_partials(spark, analytics_root).join(lost, ["hour", "object", "stored"])
        scanned = merged_counts(base.join(merging, "hour", "left_semi"), partials, gone)
    counts = materialize(counts.unionByName(scanned), folder)
    malformed = counts.where(F.col("dim") == DIM_MALFORMED).agg(F.sum("requests")).first()[0] or 0
    if failed_hours < hours:
        run = new_run()
        stored = F.when(F.col("fresh"), F.lit(run)).otherwise(F.col("stored"))
        _side_by_side(
            (write_partials, partials, run_path(analytics_root, "partials", run)),
            (write_objects, listed.withColumn("stored", stored), run_path(analytics_root, "objects", run)),
            (write_counts, counts, run_path(analytics_root, "counts", run)),
            (write_documents, summary_documents(counts, options.document_parts), run_path(analytics_root, "summaries", run)),
        )
        write_commit(listed.select("hour").distinct(), analytics_root, run)
    return failed_hours, malformed


def _refresh(
    spark: SparkSession, logs_root: str, analytics_root: str, options: _Options, folder: str
) -> RefreshReport:
    def look() -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        objects, skipped = _locate(spark, logs_root, options, folder)
        objects = materialize(objects, folder)
        return objects, _state_of_hours(objects), committed_hours(spark, analytics_root), skipped

    objects, state, summaries, skipped = look()
    todo = materialize(stale_hours(state, summaries), folder)
    skipped_objects = skipped.count()
    refreshed, failed, malformed = 0, 0, 0
    while hours := todo.count():
        failed_now, malformed_now = _summarise(spark, analytics_root, objects, todo, hours, options, folder)
        refreshed, failed, malformed = refreshed + hours - failed_now, failed + failed_now, malformed + malformed_now
        objects, state, summaries, _ = look()
        todo = materialize(_missed_hours(todo, state, summaries), folder)
    return RefreshReport(refreshed, failed, malformed, skipped_objects)


def refresh(
    spark: SparkSession,
    logs_root: str,
    analytics_root: str,
    dates: list[str] | Callable[[], list[str]] | None = None,
    hour: datetime | None = None,
    layout: str = "any",
    max_line_bytes: int = MAX_LINE_BYTES,
    paths_per_scan: int = PATHS_PER_SCAN,
    document_parts: int = 1,
) -> RefreshReport:
    """Recount every stale hour below ``logs_root``, or only those of some days or one hour.

    ``layout="flat"`` takes only ``<root>/<date>/<HH>.log.json``; ``"any"`` also
    takes sharded and ``date=/hour=`` folders at any depth. ``dates`` may be a
    function, so that a periodic refresh can list a moving window of days. A
    run is recorded whether it succeeds or not.
    """
    started = datetime.now(timezone.utc)
    report, error = None, None
    try:
        options = _Options(dates() if callable(dates) else dates, hour, layout, max_line_bytes, paths_per_scan, document_parts)
        with work_folder(spark) as folder:
            report = _refresh(spark, logs_root, analytics_root, options, folder)
        return report
    except BaseException as problem:
        error = type(problem).__name__
        raise
    finally:
        _record_run(spark, analytics_root, started, report, error)


def _record_run(spark, analytics_root, started, report, error) -> None:
    report = report or RefreshReport()
    row = (
        started.strftime("%Y-%m-%dT%H:%M:%SZ"),
        error,
        report.refreshed_hours,
        report.failed_hours,
        report.malformed_lines,
        report.skipped_objects,
    )
    schema = (
        "started STRING, error STRING, refreshed_hours BIGINT, failed_hours BIGINT, "
        "malformed_lines BIGINT, skipped_objects BIGINT"
    )
    runs = spark.createDataFrame([row], schema).withColumn("date", F.substring("started", 1, 10))
    runs.write.partitionBy("date").mode("append").json(runs_path(analytics_root))


def refresh_hour(spark: SparkSession, logs_root: str, analytics_root: str, moment: datetime, **options) -> RefreshReport:
    """Refresh the UTC hour that contains ``moment``; only its day is listed."""
    moment = moment.replace(tzinfo=timezone.utc) if moment.tzinfo is None else moment.astimezone(timezone.utc)
    day = moment.strftime("%Y-%m-%d")
    return refresh(spark, logs_root, analytics_root, dates=[day], hour=moment, **options)


def refresh_current_hour(
    spark: SparkSession, logs_root: str, analytics_root: str, now: datetime | None = None, **options
) -> RefreshReport:
    """Refresh the running UTC hour; ``now`` replaces the clock in tests."""
    return refresh_hour(spark, logs_root, analytics_root, now or datetime.now(timezone.utc), **options)
