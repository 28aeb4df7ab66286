"""Rows of the two dead-letter tables, and their triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourtally.functions.triage import triage_class


def consumer_dead_letters(messages: DataFrame, reason: Column) -> DataFrame:
    """One row per record that could not be stored, with its position in the topic.

    ``messages`` has ``record, partition, offset``.
    """
    return messages.select("record", "partition", "offset", reason.alias("reason"))


def producer_dead_letters(batches: DataFrame, reason: Column, time: Column) -> DataFrame:
    """One row per batch that could not be handed on, with all its records.

    The records already are one array, at most one request body long.
    """
    kept = [c for c in batches.columns if c == "batch_id"]
    return batches.select(*kept, "records", reason.alias("reason"), time.alias("time"))


def triage(letters: DataFrame) -> DataFrame:
    """``class, letters``: how many dead letters are worth another try."""
    return letters.groupBy(triage_class(F.col("reason")).alias("class")).agg(
        F.count(F.lit(1)).alias("letters")
    )
