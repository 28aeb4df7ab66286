"""Compaction: the many small objects of closed hours become few."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourtally.functions.timestamps import date_token, hour_token
from hourtally.operators.freshness import log_objects
from hourtally.plans.refresh import PATHS_PER_SCAN, path_groups, scan_paths
from hourtally.session import materialize, work_folder
from hourtally.sinks.hourly_logs import compression_option
from hourtally.sinks.summaries import new_run
from hourtally.sources.compacted import compacted_path, replaced_objects, visible_objects
from hourtally.sources.files import is_hidden, open_file_system, read_hidden_lines
from hourtally.sources.hourly_logs import object_of, plain_key, read_object_lines
from hourtally.sources.listing import literal_path

LEAST_OBJECTS = 4


@dataclass(frozen=True)
class CompactionReport:
    hours: int = 0
    objects: int = 0
    deleted: int = 0


def small_hours(objects: DataFrame, before: datetime, least_objects: int) -> DataFrame:
    """The objects ``hour, key, modified, bytes`` to compact: of hours that ended before ``before`` and have many.

    A file that is an hour by its own name stays, as other layouts read it.
    """
    closed = F.lit(before.astimezone(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
    shards = objects.where(F.col("hour") + F.expr("interval 1 hour") <= closed).where(
        ~F.col("key").rlike(r"/[0-9]{4}-[0-9]{2}-[0-9]{2}/[0-9]{1,2}\.log\.json\z")
    )
    many = shards.groupBy("hour").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_objects).select("hour")
    return shards.join(many, "hour", "left_semi").select("hour", "key", "modified", "bytes")


def compact(
    spark: SparkSession,
    logs_root: str,
    before: datetime | None = None,
    least_objects: int = LEAST_OBJECTS,
    compression: str = "none",
    paths_per_scan: int = PATHS_PER_SCAN,
    delete: bool = True,
) -> CompactionReport:
    """Rewrite hours that ended before ``before``, by default the running hour, and have ``least_objects`` or more.

    Lines are copied as they are, malformed and blank ones included. New files
    become visible, and the old ones invisible, with one commit; the old ones
    are deleted after it. A run that dies before the commit has changed nothing,
    one that dies after it leaves files that no reader sees and that the next
    run deletes. Logs are then to be read through ``visible_objects``, as
    refreshes do.
    """
    before = before or datetime.now(timezone.utc).replace(minute=0, second=0, microsecond=0)
    with work_folder(spark) as folder:
        objects = log_objects(visible_objects(spark, logs_root, folder=folder))
        chosen = materialize(small_hours(objects, before, least_objects).withColumn("fresh", F.lit(True)), folder)
        hours = chosen.select("hour").distinct().count()
        if hours:
            _rewrite(spark, logs_root, chosen, hours, compression, paths_per_scan)
        deleted = delete_replaced(spark, logs_root, folder) if delete else 0
        return CompactionReport(hours, chosen.count(), deleted)


def _rewrite(spark, logs_root: str, chosen: DataFrame, hours: int, compression: str, paths_per_scan: int) -> None:
    run = new_run()
    data = compacted_path(logs_root, f"data/run={run}")
    known = chosen.select(plain_key(F.col("key")).alias("object"), "hour")
    lines = [
        read_object_lines(spark, list(map(literal_path, group))).withColumn("object", object_of(F.col("path")))
        for group in path_groups(scan_paths(all_of_folders(chosen)), paths_per_scan)
    ]
    hidden = chosen.where(is_hidden(F.col("key")))
    if not hidden.isEmpty():
        lines.append(read_hidden_lines(hidden.select("key", "bytes")).withColumn("object", plain_key(F.col("path"))))
    for part in lines:
        (
            part.join(known, "object")
            .select("value", date_token(F.col("hour")).alias("date"), hour_token(F.col("hour")).alias("hour"))
            .hint("rebalance", "date", "hour")
            .sortWithinPartitions("date", "hour")
            .write.partitionBy("date", "hour")
            .mode("append")
            .option("lineSep", "\n")
            .option("compression", compression_option(compression))
            .text(data)
        )
    chosen.select("hour", "key", "modified", "bytes").write.parquet(compacted_path(logs_root, f"manifest/run={run}"))
    commit = spark.createDataFrame([(hours,)], "hours BIGINT").coalesce(1)
    commit.write.parquet(compacted_path(logs_root, f"commits/run={run}"))


def all_of_folders(chosen: DataFrame) -> DataFrame:
    """``key, fresh`` for ``scan_paths``: each object by itself, as a folder may have got newer ones."""
    return chosen.select("key", "fresh").unionByName(
        chosen.select(F.concat(F.regexp_replace("key", r"/[^/]*\z", ""), F.lit("/-")).alias("key"), F.lit(False).alias("fresh")).distinct()
    )


def delete_replaced(spark: SparkSession, logs_root: str, folder: str | None = None) -> int:
    """Delete objects that committed compactions replaced and that have not changed since; returns their number."""

    def delete(batches):
        from pyarrow import fs

        for batch in batches:
            done = []
            for row in batch.to_pylist():
                file_system, path = open_file_system(row["key"])
                info = file_system.get_file_info(path)
                same = info.type == fs.FileType.File and info.size == row["bytes"] and (info.mtime_ns or 0) // 1000 == row["micros"]
                if same or (row["ours"] and info.type == fs.FileType.File):
                    file_system.delete_file(path)
                    done.append(row["key"])
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["key"])

    tasks = 4 * spark.sparkContext.defaultParallelism
    micros, ours = F.unix_micros("modified").alias("micros"), F.contains("key", F.lit("/_compacted/data/")).alias("ours")
    rows = replaced_objects(spark, logs_root).select("key", "bytes", micros, ours).repartition(tasks, "key")
    return rows.mapInArrow(delete, "key STRING").count()
