"""Schemas of the tables the library reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

LOG_RECORD = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("path", T.StringType()),
        T.StructField("userAgent", T.StringType()),
    ]
)

RAW_BATCH = T.StructType(
    [
        T.StructField("batch_id", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("body", T.StringType()),
    ]
)

# A message as a topic delivers it: the text of one record and its position.
MESSAGE = T.StructType(
    [
        T.StructField("value", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
    ]
)

# Every counted key of every hour. ``dim`` is one of the constants below.
HOURLY_COUNT = T.StructType(
    [
        T.StructField("hour", T.TimestampType()),
        T.StructField("dim", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("requests", T.LongType()),
    ]
)

CONSUMER_DEAD_LETTER = T.StructType(
    [
        T.StructField("record", LOG_RECORD),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("reason", T.StringType()),
    ]
)

PRODUCER_DEAD_LETTER = T.StructType(
    [
        T.StructField("records", T.ArrayType(LOG_RECORD)),
        T.StructField("reason", T.StringType()),
        T.StructField("time", T.TimestampType()),
    ]
)

# Values of ``dim``. The first two are the analytics; the others describe the
# scan of an hour and never enter a summary.
DIM_PATH = "path"
DIM_USER_AGENT = "userAgent"
DIM_MALFORMED = "malformed"
DIM_OVERSIZED = "oversized"
DIM_LISTED = "listed"
