"""Which hours have logs newer than their summary, and which cannot be summarised."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourtally.functions.keys import LOG_SUFFIX, hour_from_key
from hourtally.operators.ingest import keep_when
from hourtally.schema import DIM_OVERSIZED
from hourtally.sources.files import is_hidden


def log_objects(listing: DataFrame) -> DataFrame:
    """The log files of a listing, each with its hour.

    Keeps ``key, modified, bytes`` and adds ``hour``; files with another suffix
    and keys without a date and hour are left out. Files below ``date=/hour=``
    folders count whatever their suffix, but hidden ones, which are not logs.
    """
    written = F.contains(F.col("key"), F.lit("/hour=")) & ~is_hidden(F.col("key"))
    is_log = F.endswith("key", F.lit(LOG_SUFFIX)) | written
    located = listing.withColumn("hour", F.when(is_log, hour_from_key(F.col("key"))))
    return keep_when(located, F.col("hour").isNotNull(), *listing.columns, "hour")


def unexpected_objects(listing: DataFrame) -> DataFrame:
    """Log files whose key holds no date and hour; they are skipped and worth a warning."""
    return listing.where(F.endswith("key", F.lit(LOG_SUFFIX)) & hour_from_key(F.col("key")).isNull())


def objects_per_hour(objects: DataFrame) -> DataFrame:
    """``hour, objects, bytes, latest`` of located log files."""
    return objects.groupBy("hour").agg(
        F.count(F.lit(1)).alias("objects"),
        F.sum("bytes").alias("bytes"),
        F.max("modified").alias("latest"),
    )


def stale_hours(hours: DataFrame, summaries: DataFrame) -> DataFrame:
    """The hours without a summary, or with one strictly older than the newest log.

    ``hours`` has ``hour, latest``; ``summaries`` has ``hour, modified``, of
    which the oldest row of an hour counts. Equal times mean fresh.
    """
    known = summaries.groupBy("hour").agg(F.min("modified").alias("summarised"))
    return (
        hours.join(known, "hour", "left")
        .where(F.col("summarised").isNull() | (F.col("summarised") < F.col("latest")))
        .drop("summarised")
    )


def oversized_hours(counts: DataFrame) -> DataFrame:
    """``hour, oversized_lines`` of the hours that fail because of an overlong line."""
    return counts.where(F.col("dim") == DIM_OVERSIZED).select(
        "hour", F.col("requests").alias("oversized_lines")
    )
