"""Requests per path and per user agent, per UTC hour."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourtally.functions.timestamps import utc_hour
from hourtally.schema import DIM_PATH, DIM_USER_AGENT


def _keyed(records: DataFrame) -> DataFrame:
    """A missing text is the empty text, which is a key like any other."""
    return records.select(
        utc_hour(F.col("timestamp")).alias("hour"),
        F.coalesce("path", F.lit("")).alias("path"),
        F.coalesce("userAgent", F.lit("")).alias("userAgent"),
    )


def requests_per_path(records: DataFrame) -> DataFrame:
    return _keyed(records).groupBy("hour", "path").agg(F.count(F.lit(1)).alias("requests"))


def requests_per_user_agent(records: DataFrame) -> DataFrame:
    return _keyed(records).groupBy("hour", "userAgent").agg(F.count(F.lit(1)).alias("requests"))


def hourly_counts(records: DataFrame) -> DataFrame:
    """``hour, dim, key, requests``: both counts from one scan and one shuffle."""
    by_user_agent = F.grouping("path") == 1
    return (
        _keyed(records)
        .groupingSets([["hour", "path"], ["hour", "userAgent"]], "hour", "path", "userAgent")
        .agg(
            F.when(by_user_agent, F.lit(DIM_USER_AGENT)).otherwise(F.lit(DIM_PATH)).alias("dim"),
            F.when(by_user_agent, F.col("userAgent")).otherwise(F.col("path")).alias("key"),
            F.count(F.lit(1)).alias("requests"),
        )
        .select("hour", "dim", "key", "requests")
    )


def records_of_hour(records: DataFrame, moment: datetime | None = None) -> DataFrame:
    """The records of the UTC hour that contains ``moment``; by default the current one.

    A plain range on ``timestamp``, so the source can skip files and row groups.
    """
    moment = moment or datetime.now(timezone.utc)
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    start = moment.astimezone(timezone.utc).replace(minute=0, second=0, microsecond=0)
    literal = lambda at: F.lit(at.strftime("%Y-%m-%d %H:%M:%S")).cast(
        records.schema["timestamp"].dataType
    )
    return records.where(
        (F.col("timestamp") >= literal(start)) & (F.col("timestamp") < literal(start + timedelta(hours=1)))
    )


def tumbling_counts(records: DataFrame) -> DataFrame:
    """``window_start, window_end, path, requests`` over one-hour windows, batch or stream."""
    return (
        records.groupBy(F.window("timestamp", "1 hour").alias("window"), "path")
        .agg(F.count(F.lit(1)).alias("requests"))
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "path",
            "requests",
        )
    )


def batch_hour_groups(records: DataFrame) -> DataFrame:
    """``batch_id, hour, records``: how each batch splits into hours."""
    return records.groupBy("batch_id", utc_hour(F.col("timestamp")).alias("hour")).agg(
        F.count(F.lit(1)).alias("records")
    )
