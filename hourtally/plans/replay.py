"""Replaying dead letters whose failure has passed, each stored once.

An attempt goes through steps that are each noted below ``ledger_root``: its
letters are planned, their records staged, the staged files moved into the logs
under names of the attempt, and the attempt committed. Whatever step dies, the
next call goes on there: staging starts over as nothing of it is visible, moving
passes over files that are moved already. A letter in a plan is in no other.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourtally.functions.triage import is_transient
from hourtally.session import materialize, work_folder
from hourtally.sinks.dead_letters import read_consumer_dead_letters
from hourtally.sinks.hourly_logs import write_hourly
from hourtally.sources.files import list_files, open_file_system
from hourtally.sources.listing import child_folders, delete_folder, literal_path, path_exists, qualified_path

_LETTERS = "record STRUCT<timestamp: TIMESTAMP, path: STRING, userAgent: STRING>, partition INT, offset BIGINT"


@dataclass(frozen=True)
class ReplayReport:
    """Letters that this call stored, and those that are left for good: no repetition helps them."""

    replayed: int = 0
    permanent: int = 0


def pending_letters(letters: DataFrame, planned: DataFrame) -> DataFrame:
    """One row per position in the topic whose failure was transient and that no plan holds.

    A batch that was stored twice as dead letters has each of its positions once.
    """
    transient = letters.where(is_transient(F.col("reason")))
    once = transient.groupBy("partition", "offset").agg(F.first("record").alias("record"))
    return once.join(planned.select("partition", "offset"), ["partition", "offset"], "left_anti").select("record", "partition", "offset")


def _planned(spark: SparkSession, ledger_root: str) -> DataFrame:
    if not child_folders(spark, f"{ledger_root}/plans"):
        return spark.createDataFrame([], _LETTERS)
    return spark.read.schema(f"{_LETTERS}, attempt STRING").parquet(literal_path(f"{ledger_root}/plans")).drop("attempt")


def _note(spark: SparkSession, ledger_root: str, step: str, name: str) -> None:
    spark.createDataFrame([(name,)], "attempt STRING").coalesce(1).write.parquet(f"{ledger_root}/{step}/{name}")


def _publish(spark: SparkSession, staged: str, logs_root: str, name: str) -> None:
    """Move staged files to the same folders of the logs, in tasks; files that are gone have been moved before."""
    source, target = qualified_path(spark, staged), qualified_path(spark, logs_root)

    def move(batches):
        from pyarrow import fs

        for batch in batches:
            for key in batch.column("key").to_pylist():
                folder, _, file = key[len(source) :].rpartition("/")
                file_system, old = open_file_system(key)
                _, new = open_file_system(f"{target}{folder}/{name}-{file}")
                if file_system.get_file_info(old).type == fs.FileType.File:
                    file_system.create_dir(new.rpartition("/")[0], recursive=True)
                    file_system.move(old, new)
            yield pa.RecordBatch.from_arrays([batch.column("key")], names=["key"])

    files = list_files(spark, source).where(~F.substring_index("key", "/", -1).rlike(r"\A[_.]")).select("key")
    files.repartition(4 * spark.sparkContext.defaultParallelism, "key").mapInArrow(move, "key STRING").count()


def replay_consumer_letters(
    spark: SparkSession,
    dead_letter_root: str,
    logs_root: str,
    ledger_root: str,
    store: Callable[[DataFrame, str], None] = write_hourly,
) -> ReplayReport:
    """Store the records of transient dead letters in the hourly logs, once each however often this is called.

    ``store(records, folder)`` writes into a staging folder. Its failure, like
    any other, is raised and leaves the attempt to the next call. Letters stay
    where they are.
    """
    ledger_root = ledger_root.rstrip("/")
    if not path_exists(spark, dead_letter_root):
        return ReplayReport()
    with work_folder(spark) as work:
        letters = read_consumer_dead_letters(spark, literal_path(dead_letter_root))
        pending = materialize(pending_letters(letters, _planned(spark, ledger_root)), work)
        plans = child_folders(spark, f"{ledger_root}/plans")
        if not pending.isEmpty():
            pending.write.parquet(f"{ledger_root}/plans/attempt={len(plans):09}")
            plans = child_folders(spark, f"{ledger_root}/plans")
        replayed = 0
        for name in sorted(set(plans) - set(child_folders(spark, f"{ledger_root}/commits"))):
            chosen = spark.read.schema(_LETTERS).parquet(literal_path(f"{ledger_root}/plans/{name}"))
            staged = f"{ledger_root}/staged/{name}"
            if name not in child_folders(spark, f"{ledger_root}/ready"):
                delete_folder(spark, staged)
                store(chosen.select("record.*"), staged)
                _note(spark, ledger_root, "ready", name)
            _publish(spark, staged, logs_root, name.replace("=", "-"))
            _note(spark, ledger_root, "commits", name)
            replayed += chosen.count()
        permanent = letters.where(~is_transient(F.col("reason"))).select("partition", "offset").distinct().count()
        return ReplayReport(replayed, permanent)
