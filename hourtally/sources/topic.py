"""Topics of log records as streams of ``value, partition, offset``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourtally.operators.lines import decode_lines
from hourtally.schema import MESSAGE


def kafka_messages(spark: SparkSession, servers: str, topic: str, flush_size: int | None = None, **options: str) -> DataFrame:
    """A Kafka topic; ``flush_size``, if given, bounds a micro-batch. Needs Spark's Kafka connector.

    Spark tracks offsets itself, so committing is the checkpoint's work.
    """
    if flush_size is not None:
        options["maxOffsetsPerTrigger"] = str(flush_size)
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .options(**options)
        .load()
        .select(F.col("value").cast("string").alias("value"), "partition", "offset")
    )


def file_messages(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Messages kept as JSON files of ``value, partition, offset``."""
    return (
        spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files_per_batch).json(folder)
    )


def decode_messages(messages: DataFrame) -> DataFrame:
    """``record, partition, offset, line_state``; ``record`` is NULL for a malformed value."""
    return decode_lines(messages)
