"""Hourly counts to summary documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourtally.functions.timestamps import hour_rfc3339
from hourtally.schema import DIM_PATH, DIM_USER_AGENT


def summary_documents(counts: DataFrame, parts: int = 1) -> DataFrame:
    """``hour, part, parts, document`` with keys in byte order.

    An hour is one JSON document of the form ``{"hour": ..., "requestsPerPath":
    {...}, "requestsPerUserAgent": {...}}``. With more ``parts`` every hour is up
    to that many documents of this form, over which its keys are dealt by a hash,
    for hours with too many keys for one row; together they hold every key. The
    form depends on ``parts`` alone, never on the size of an hour. Other ``dim``
    values only make sure that their hour gets a document, if an empty one.
    """
    placed = counts.withColumn("parts", F.lit(parts)).withColumn(
        "part", F.pmod(F.xxhash64("dim", "key"), F.lit(parts)).cast("int")
    )
    entries = lambda dim: F.array_sort(
        F.collect_list(F.when(F.col("dim") == dim, F.struct("key", "requests")))
    )
    return (
        placed.groupBy("hour", "part", "parts")
        .agg(entries(DIM_PATH).alias("paths"), entries(DIM_USER_AGENT).alias("agents"))
        .select(
            "hour",
            "part",
            "parts",
            F.to_json(
                F.struct(
                    hour_rfc3339(F.col("hour")).alias("hour"),
                    F.map_from_entries("paths").alias("requestsPerPath"),
                    F.map_from_entries("agents").alias("requestsPerUserAgent"),
                )
            ).alias("document"),
        )
    )
