"""Files as they arrive, hidden and empty ones included.

Spark's streams of files pass over both kinds. Here a folder is listed in tasks,
and what has not been seen yet becomes a numbered pass: its files are planned
below ``state_root``, handed on, and the pass is committed. A pass that dies is
handed on again with the same number and the same files, so nothing is lost and
a handler can tell a repetition. A file that changes arrives again.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hourtally.operators.freshness import log_objects
from hourtally.operators.ingest import MAX_BODY_BYTES
from hourtally.plans.ingest import store_batches
from hourtally.plans.refresh import refresh
from hourtally.session import materialize, work_folder
from hourtally.sources.batches import bodies_of
from hourtally.sources.listing import child_folders, list_objects, literal_path

LOG = logging.getLogger(__name__)

_FILES = "key STRING, modified TIMESTAMP, bytes BIGINT"


def planned_files(spark: SparkSession, state_root: str) -> DataFrame:
    """``key, modified, bytes, pass`` of all files seen so far."""
    if not child_folders(spark, f"{state_root}/plans"):
        return spark.createDataFrame([], f"{_FILES}, pass STRING")
    return spark.read.schema(f"{_FILES}, pass STRING").parquet(literal_path(f"{state_root}/plans"))


def plan_pass(spark: SparkSession, folder: str, state_root: str, max_files: int | None, work: str) -> str | None:
    """The first pass that is planned and not committed, or a new one; ``None`` if nothing has arrived."""
    plans, commits = (child_folders(spark, f"{state_root}/{name}") for name in ("plans", "commits"))
    left = sorted(set(plans) - set(commits))
    if left:
        return left[0]
    new = list_objects(spark, folder, folder=work).join(
        planned_files(spark, state_root).drop("pass"), ["key", "modified", "bytes"], "left_anti"
    )
    if max_files:
        new = new.orderBy("modified", "key").limit(max_files)
    new = materialize(new, work)
    if new.isEmpty():
        return None
    name = f"pass=p{len(plans):09}"
    new.write.parquet(f"{state_root}/plans/{name}")
    return name


def take_arrivals(
    spark: SparkSession, folder: str, state_root: str, handle: Callable[[DataFrame, int], None], max_files: int | None = None
) -> int:
    """Hand everything that has arrived to ``handle(files, number)``, pass by pass; returns the passes.

    Files have ``key, modified, bytes``. ``max_files`` bounds a pass, not what is taken.
    """
    state_root, passes = state_root.rstrip("/"), 0
    while True:
        with work_folder(spark) as work:
            name = plan_pass(spark, folder, state_root, max_files, work)
            if name is None:
                return passes
            number = int(name.removeprefix("pass=p"))
            files = spark.read.schema(_FILES).parquet(literal_path(f"{state_root}/plans/{name}"))
            handle(files, number)
            spark.createDataFrame([(number,)], "number BIGINT").coalesce(1).write.parquet(f"{state_root}/commits/{name}")
            passes += 1


def store_arrivals(
    spark: SparkSession,
    folder: str,
    logs_root: str,
    state_root: str,
    rejects_root: str | None = None,
    max_body_bytes: int = MAX_BODY_BYTES,
    max_files: int | None = None,
) -> dict[str, int]:
    """Store the bodies that have arrived in ``folder`` as hourly logs; returns the counters of all passes."""
    totals: dict[str, int] = {}

    def handle(files: DataFrame, number: int) -> None:
        found = store_batches(bodies_of(files, max_body_bytes), logs_root, rejects_root, max_body_bytes=max_body_bytes)
        for name, value in found.items():
            totals[name] = totals.get(name, 0) + value

    take_arrivals(spark, folder, state_root, handle, max_files)
    return totals


def refresh_arrivals(spark: SparkSession, logs_root: str, analytics_root: str, state_root: str, **options) -> int:
    """Refresh the days in which log files have arrived or changed, empty and hidden ones included; returns the passes."""

    def handle(files: DataFrame, number: int) -> None:
        days = log_objects(files).select(F.to_date("hour").alias("day")).distinct()
        dates = [row["day"].isoformat() for row in days.collect()]
        if dates:
            refresh(spark, logs_root, analytics_root, dates=sorted(dates), **options)

    return take_arrivals(spark, logs_root, state_root, handle)


def start_arrivals(spark: SparkSession, take: Callable[[], object], checkpoint: str, interval: str = "1 minute") -> StreamingQuery:
    """Call ``take``, such as a ``store_arrivals``, now and once per interval; a failure is logged and tried again."""

    def tick(*_) -> None:
        try:
            take()
        except Exception:
            LOG.exception("taking arrivals failed")

    tick()
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return (
        clock.writeStream.foreachBatch(tick)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=interval)
        .start()
    )
