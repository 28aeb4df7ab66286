"""Hourly NDJSON logs below ``date=<YYYY-MM-DD>/hour=<HH>`` folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourtally.functions.json_records import record_to_json
from hourtally.functions.timestamps import date_token, format_rfc3339, hour_token, stored_time

# The accepted codec names and what Spark and Kafka call them.
CODECS = {
    "": "none",
    "none": "none",
    "gzip": "gzip",
    "snappy": "snappy",
    "lz4": "lz4",
    "zstd": "zstd",
    "zstandard": "zstd",
}


def compression_option(name: str | None) -> str:
    """The codec of that name, any case; an unknown name means no compression."""
    return CODECS.get((name or "").strip().lower(), "none")


def encode_records(records: DataFrame) -> DataFrame:
    """Add ``value``, the record as one line of JSON."""
    timestamp = format_rfc3339(stored_time(F.col("timestamp")))
    return records.withColumn("value", record_to_json(timestamp, F.col("path"), F.col("userAgent")))


def write_hourly(records: DataFrame, root: str, compression: str = "none", rebalance: bool = True) -> None:
    """Append records to the folders of their UTC hours.

    Every task writes files of its own, so writers never overwrite each other,
    and a failed job leaves nothing behind. Rows are first brought together by
    hour with a rebalancing shuffle: a small hour ends up in one file, a hot
    hour (and any that shares its reducer) is split over as many tasks as its
    size asks for.
    """
    encoded = encode_records(records).select(
        "value",
        date_token(stored_time(F.col("timestamp"))).alias("date"),
        hour_token(stored_time(F.col("timestamp"))).alias("hour"),
    )
    if rebalance:
        encoded = encoded.hint("rebalance", "date", "hour")
    writer = (
        encoded.sortWithinPartitions("date", "hour")
        .write.partitionBy("date", "hour")
        .mode("append")
        .option("lineSep", "\n")
        .option("compression", compression_option(compression))
    )
    writer.text(root)
