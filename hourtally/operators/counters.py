"""Totals of what was accepted, rejected, stored and run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourtally.operators.ingest import ACCEPTED, STORE_ERROR

# The counter names.
BATCHES_RECEIVED = "log_batches_received_total"
INVALID_REQUESTS = "invalid_requests_total"
LOGS_INGESTED = "logs_ingested_total"
INGEST_ERRORS = "ingest_errors_total"
AGGREGATION_RUNS = "aggregation_runs_total"


def _total(condition: Column, amount: Column | None = None) -> Column:
    amount = F.lit(1) if amount is None else amount
    return F.coalesce(F.sum(F.when(condition, amount).otherwise(0)), F.lit(0)).cast("bigint")


def batch_totals(store_failed: Column) -> list[Column]:
    """Aggregates over batch outcomes; usable with ``agg`` and with ``observe``.

    A batch whose records could not be stored is an error and nothing else.
    """
    accepted = F.col("status") == ACCEPTED
    stored = accepted & ~store_failed
    return [
        _total(stored).alias(BATCHES_RECEIVED),
        _total(~accepted & (F.col("status") != STORE_ERROR)).alias(INVALID_REQUESTS),
        _total(stored, F.size("records")).alias(LOGS_INGESTED),
        _total((accepted & store_failed) | (F.col("status") == STORE_ERROR)).alias(INGEST_ERRORS),
    ]


def as_rows(totals: DataFrame) -> DataFrame:
    """One row of totals to ``metric, value`` rows."""
    return totals.select(
        F.inline(
            F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in totals.columns])
        )
    )


def ingest_counters(outcomes: DataFrame, store_failed: Column | None = None) -> DataFrame:
    failed = F.lit(False) if store_failed is None else store_failed
    return as_rows(outcomes.agg(*batch_totals(failed)))


def run_counters(runs: DataFrame) -> DataFrame:
    """Aggregation runs, failed ones included; ``runs`` has one row per run."""
    return as_rows(runs.agg(F.count(F.lit(1)).alias(AGGREGATION_RUNS)))
