"""Records to a topic, one JSON value per record and no key."""

from __future__ import annotations

from pyspark.sql import DataFrame

from hourtally.sinks.hourly_logs import compression_option, encode_records


def topic_messages(records: DataFrame) -> DataFrame:
    """``value`` only: without a key the records spread over all partitions.

    Spark's Kafka sink has no message time; the event time is inside the value.
    """
    return encode_records(records).select("value")


def write_topic(records: DataFrame, servers: str, topic: str, compression: str = "none", **options: str) -> None:
    """Publish a batch of records to Kafka. Needs Spark's Kafka connector."""
    (
        topic_messages(records)
        .write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("kafka.compression.type", compression_option(compression))
        .option("topic", topic)
        .options(**options)
        .save()
    )
