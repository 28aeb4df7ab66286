"""Hourly counts and summary documents, kept by run and made visible by commits.

A run writes its counts, documents and bookkeeping into folders of its own,
``<table>/run=<run>``, in as few files as their size asks for, and last a commit:
one file that names the hours it replaces. An hour is what the newest commit with
that hour says. A run that dies before its commit has changed nothing, and counts
and documents of an hour always change together.

==========  ==================================================================
counts      ``hour, dim, key, requests``, the table that queries should read
summaries   one JSON document per line
objects     the log objects behind an hour, and the run that counted each
partials    ``hour, object, dim, key, requests`` of each object when counted
commits     ``hour, data_run, summarised``
==========  ==================================================================
"""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourtally.functions.timestamps import date_token, hour_token
from hourtally.sources.listing import child_folders, delete_folder, literal_path, path_exists

_COUNTS = "hour TIMESTAMP, dim STRING, key STRING, requests BIGINT"
_OBJECTS = "hour TIMESTAMP, object STRING, modified TIMESTAMP, bytes BIGINT, stored STRING"
_PARTIALS = "hour TIMESTAMP, object STRING, dim STRING, key STRING, requests BIGINT"
_COMMITS = "hour TIMESTAMP, data_run STRING, summarised TIMESTAMP"
TABLES = ("counts", "summaries", "objects", "partials")


def new_run() -> str:
    """A name that sorts after those of earlier runs."""
    return f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S.%fZ}-{uuid.uuid4().hex[:8]}"


def table_path(analytics_root: str, table: str) -> str:
    return f"{analytics_root.rstrip('/')}/{table}"


def run_path(analytics_root: str, table: str, run: str) -> str:
    return f"{table_path(analytics_root, table)}/run={run}"


def _analytics_root(path: str) -> str:
    return path.rstrip("/").rpartition("/")[0]


def _together(df: DataFrame, *order: str) -> DataFrame:
    """Files of a good size, each hour in few of them and in order, so that readers can skip."""
    return df.hint("rebalance", "hour").sortWithinPartitions("hour", *order)


def write_counts(counts: DataFrame, folder: str) -> None:
    """Store ``hour, dim, key, requests`` in the folder of a run."""
    _together(counts.select("hour", "dim", "key", "requests"), "dim", "key").write.parquet(folder)


def write_documents(documents: DataFrame, folder: str) -> None:
    """Store one JSON document per line, one line per hour and part, in the folder of a run."""
    _together(documents.select("hour", "document")).select("document").write.option("lineSep", "\n").text(folder)


def write_objects(objects: DataFrame, folder: str) -> None:
    _together(objects.select("hour", "object", "modified", "bytes", "stored"), "object").write.parquet(folder)


def write_partials(partials: DataFrame, folder: str) -> None:
    _together(partials.select("hour", "object", "dim", "key", "requests"), "object").write.parquet(folder)


def write_commit(hours: DataFrame, analytics_root: str, run: str) -> None:
    """Make the hours of a run visible: a single file, so all of them or none."""
    rows = hours.select("hour", F.lit(run).alias("data_run"), F.lit(None).cast("timestamp").alias("summarised"))
    rows.coalesce(1).write.parquet(run_path(analytics_root, "commits", run))


def committed_hours(spark: SparkSession, analytics_root: str) -> DataFrame:
    """``hour, run, modified``: the run that holds each hour, and when it was committed."""
    root = table_path(analytics_root, "commits")
    if not path_exists(spark, root):
        return spark.createDataFrame([], "hour TIMESTAMP, run STRING, modified TIMESTAMP")
    stored = spark.read.schema(f"{_COMMITS}, run STRING").parquet(literal_path(root))
    when = F.coalesce("summarised", F.col("_metadata.file_modification_time"))
    newest = F.max(F.struct("data_run", when.alias("modified"))).alias("newest")
    return stored.groupBy("hour").agg(newest).select("hour", F.col("newest.data_run").alias("run"), "newest.modified")


def _visible(spark: SparkSession, analytics_root: str, table: str, schema: str) -> DataFrame:
    """The rows of the hours' newest runs; ``run`` is a folder, so other runs are not read."""
    root = table_path(analytics_root, table)
    if not path_exists(spark, root):
        return spark.createDataFrame([], f"{schema}, run STRING")
    stored = spark.read.schema(f"{schema}, run STRING").parquet(literal_path(root))
    return stored.join(committed_hours(spark, analytics_root).drop("modified"), ["hour", "run"]).select(*stored.columns)


def read_counts(spark: SparkSession, root: str) -> DataFrame:
    """Stored counts below ``<analytics>/counts``; ``date`` and ``hour_token`` spell the hour."""
    counts = _visible(spark, _analytics_root(root), "counts", _COUNTS)
    return counts.select(
        "hour", "dim", "key", "requests", date_token(F.col("hour")).alias("date"), hour_token(F.col("hour")).alias("hour_token")
    )


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """``value, date, hour`` of the documents below ``<analytics>/summaries``."""
    if not path_exists(spark, root):
        return spark.createDataFrame([], "value STRING, date STRING, hour STRING")
    lines = spark.read.schema("value STRING, run STRING").option("lineSep", "\n").text(literal_path(root))
    # A document begins with its hour.
    at = F.to_timestamp(F.substring("value", len('{"hour":"') + 1, 13), "yyyy-MM-dd'T'HH")
    newest = committed_hours(spark, _analytics_root(root)).drop("modified")
    found = lines.withColumn("at", at).join(newest.withColumnRenamed("hour", "at"), ["at", "run"])
    return found.select("value", date_token(F.col("at")).alias("date"), hour_token(F.col("at")).alias("hour"))


def read_objects(spark: SparkSession, analytics_root: str) -> DataFrame:
    """``hour, object, modified, bytes, stored`` of the visible hours; ``stored`` is the run with the partials."""
    return _visible(spark, analytics_root, "objects", _OBJECTS).drop("run")


def read_partials(spark: SparkSession, analytics_root: str) -> DataFrame:
    """``hour, object, dim, key, requests, stored`` of all runs, dead ones included; join with ``read_objects``."""
    root = table_path(analytics_root, "partials")
    if not path_exists(spark, root):
        return spark.createDataFrame([], f"{_PARTIALS}, stored STRING")
    return spark.read.schema(f"{_PARTIALS}, run STRING").parquet(literal_path(root)).withColumnRenamed("run", "stored")


def drop_superseded_runs(spark: SparkSession, analytics_root: str, older_than: timedelta = timedelta(days=1)) -> int:
    """Remove folders of runs that no visible hour needs, and fold old commits into one; returns the folders removed.

    Folders of runs begun within ``older_than`` stay, for runs that are not
    committed yet and readers that have planned with them.
    """
    limit = f"{datetime.now(timezone.utc) - older_than:%Y%m%dT%H%M%S.%fZ}"
    commits = [f for f in child_folders(spark, table_path(analytics_root, "commits")) if f.removeprefix("run=") < limit]
    if len(commits) > 1:
        run = new_run()
        hours = committed_hours(spark, analytics_root).select("hour", F.col("run").alias("data_run"), F.col("modified").alias("summarised"))
        hours.coalesce(1).write.parquet(run_path(analytics_root, "commits", run))
        for folder in commits:
            delete_folder(spark, f"{table_path(analytics_root, 'commits')}/{folder}")
    holding = {r["run"] for r in committed_hours(spark, analytics_root).select("run").distinct().collect()}
    counted = {r["stored"] for r in read_objects(spark, analytics_root).select("stored").distinct().collect()}
    removed = 0
    for table in TABLES:
        for folder in child_folders(spark, table_path(analytics_root, table)):
            run = folder.removeprefix("run=")
            if run < limit and run not in (counted if table == "partials" else holding):
                delete_folder(spark, f"{table_path(analytics_root, table)}/{folder}")
                removed += 1
    return removed
