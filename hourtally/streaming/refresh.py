"""Keeping the hourly summaries up to date while logs arrive."""

from __future__ import annotations

import logging
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hourtally.operators.counting import tumbling_counts
from hourtally.operators.freshness import log_objects
from hourtally.plans.refresh import RefreshReport, refresh
from hourtally.sources.listing import literal_path

LOG = logging.getLogger(__name__)

REFRESH_INTERVAL = "1 minute"


def start_periodic_refresh(
    spark: SparkSession,
    logs_root: str,
    analytics_root: str,
    checkpoint: str,
    interval: str = REFRESH_INTERVAL,
    run: Callable[..., RefreshReport] = refresh,
    **options,
) -> StreamingQuery:
    """Run a refresh now and then once per interval, for any layout.

    The stream is only a clock. Late records change their file's time, so
    their hour is found stale and recounted at the next run. A failed run is
    recorded and logged, and the next one tries again.
    """

    def tick(*_) -> None:
        try:
            run(spark, logs_root, analytics_root, **options)
        except Exception:
            LOG.exception("refresh failed")

    tick()
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return (
        ticks.writeStream.foreachBatch(tick)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=interval)
        .start()
    )


def start_refresh_on_arrival(
    spark: SparkSession,
    logs_root: str,
    analytics_root: str,
    checkpoint: str,
    interval: str | None = REFRESH_INTERVAL,
    **options,
) -> StreamingQuery:
    """Refresh the days in which new log files appear.

    For layouts whose files never change once written: the stream sees a file
    once, and no empty or hidden one, which ``arrivals.refresh_arrivals`` takes as
    well. Only the days touched by a micro-batch are listed, and within them
    only stale hours are read.
    """
    schema = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"
    arrivals = (
        spark.readStream.format("binaryFile")
        .schema(schema)
        .option("recursiveFileLookup", "true")
        .load(literal_path(logs_root))
        .select(
            F.col("path").alias("key"),
            F.col("modificationTime").alias("modified"),
            F.col("length").alias("bytes"),
        )
    )

    def handle(batch: DataFrame, batch_id: int) -> None:
        days = log_objects(batch).select(F.to_date("hour").alias("day")).distinct()
        dates = [row["day"].isoformat() for row in days.collect()]
        if dates:
            refresh(spark, logs_root, analytics_root, dates=sorted(dates), **options)

    trigger = {"availableNow": True} if interval is None else {"processingTime": interval}
    return (
        arrivals.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def windowed_counts(records: DataFrame, lateness: timedelta = timedelta(hours=1)) -> DataFrame:
    """``window_start, window_end, path, requests`` of a stream of records.

    The state is bounded by the watermark, so a record later than ``lateness``
    may be missed; the refreshes above miss none. Use ``update`` mode.
    """
    return tumbling_counts(records.withWatermark("timestamp", f"{int(lateness.total_seconds())} seconds"))


def start_windowed_counts(
    records: DataFrame,
    root: str,
    checkpoint: str,
    lateness: timedelta = timedelta(hours=1),
    interval: str | None = REFRESH_INTERVAL,
) -> StreamingQuery:
    """Keep the ``windowed_counts`` of a stream below ``root``; late records within ``lateness`` correct their window.

    A micro-batch writes the windows it changed into a folder of its own, which
    a repetition replaces; ``read_windowed_counts`` takes the newest of each.
    """

    def handle(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{root.rstrip('/')}/batch={batch_id}")

    trigger = {"availableNow": True} if interval is None else {"processingTime": interval}
    return (
        windowed_counts(records, lateness)
        .writeStream.outputMode("update")
        .foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def read_windowed_counts(spark: SparkSession, root: str) -> DataFrame:
    """``window_start, window_end, path, requests`` as of the newest micro-batch that changed each."""
    schema = "window_start TIMESTAMP, window_end TIMESTAMP, path STRING, requests BIGINT, batch BIGINT"
    stored = spark.read.schema(schema).parquet(literal_path(root))
    keys = ["window_start", "window_end", "path"]
    return stored.groupBy(*keys).agg(F.max_by("requests", "batch").alias("requests"))
