"""Dead letters as JSON files below ``date=<YYYY-MM-DD>`` folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourtally.functions.timestamps import date_token, format_rfc3339, stored_time
from hourtally.schema import CONSUMER_DEAD_LETTER, PRODUCER_DEAD_LETTER


def _append(letters: DataFrame, root: str, date: Column) -> None:
    letters.withColumn("date", date).write.partitionBy("date").mode("append").json(root)


def write_consumer_dead_letters(letters: DataFrame, root: str) -> None:
    """Append ``record, partition, offset, reason`` under today's UTC date."""
    stamped = letters.withColumn(
        "record",
        F.col("record").withField("timestamp", format_rfc3339(stored_time(F.col("record.timestamp")))),
    )
    _append(stamped, root, date_token(F.current_timestamp()))


def write_producer_dead_letters(letters: DataFrame, root: str) -> None:
    """Append ``records, reason, time`` under the date of ``time``; a batch is one line."""
    date = date_token(F.col("time"))
    stamped = letters.withColumns(
        {
            "records": F.transform(
                "records", lambda r: r.withField("timestamp", format_rfc3339(r["timestamp"]))
            ),
            "date": date,
            "time": format_rfc3339(F.col("time")),
        }
    )
    _append(stamped, root, F.col("date"))


def read_consumer_dead_letters(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(CONSUMER_DEAD_LETTER).json(root)


def read_producer_dead_letters(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(PRODUCER_DEAD_LETTER).json(root)
