"""Batches of request bodies into storage or onto a topic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourtally.operators.counters import batch_totals
from hourtally.operators.dead_letters import producer_dead_letters
from hourtally.operators.ingest import ACCEPTED, MAX_BODY_BYTES, batch_outcomes, keep_when, rejected_batches, validated_records
from hourtally.session import materialize
from hourtally.sinks.dead_letters import write_producer_dead_letters
from hourtally.sinks.hourly_logs import write_hourly

# What a failing write raises: Spark's own errors, and Py4J's for the rest.
try:
    from py4j.protocol import Py4JError

    WRITE_ERRORS: tuple[type[BaseException], ...] = (PySparkException, Py4JError, OSError)
except ImportError:
    WRITE_ERRORS = (PySparkException, OSError)


def short_reason(error: BaseException) -> str:
    """The first line of an error, as a dead letter's reason."""
    text = str(error).strip()
    return text.splitlines()[0] if text else type(error).__name__


def _decoded_once(batches: DataFrame, max_body_bytes: int) -> DataFrame:
    """The outcomes as a table, so that records, rejects and totals are of one decoding."""
    return materialize(batch_outcomes(batches, max_body_bytes).select("batch_id", "status", "reason", "records"))


def _totals(outcomes: DataFrame, store_failed: bool) -> dict[str, int]:
    return outcomes.agg(*batch_totals(F.lit(store_failed))).first().asDict()


def store_batches(
    batches: DataFrame,
    logs_root: str,
    rejects_root: str | None = None,
    compression: str = "none",
    max_body_bytes: int = MAX_BODY_BYTES,
) -> dict[str, int]:
    """Validate the batches, append the accepted records to the hourly logs and return the counters.

    A failing write is raised; ``publish_batches`` turns one into dead letters.
    """
    outcomes = _decoded_once(batches, max_body_bytes)
    write_hourly(validated_records(outcomes), logs_root, compression)
    if rejects_root:
        rejected_batches(outcomes).write.mode("append").parquet(rejects_root)
    return _totals(outcomes, False)


def publish_batches(
    batches: DataFrame,
    publish: Callable[[DataFrame], None],
    dead_letter_root: str,
    max_body_bytes: int = MAX_BODY_BYTES,
) -> dict[str, int]:
    """Validate the batches, hand the accepted records to ``publish`` and return the counters.

    When publishing fails, every accepted batch becomes one dead letter with
    the reason, and counts as an error; the job itself does not fail.
    """
    outcomes = _decoded_once(batches, max_body_bytes)
    try:
        publish(validated_records(outcomes))
    except WRITE_ERRORS as error:
        accepted = keep_when(outcomes, F.col("status") == ACCEPTED, "records")
        letters = producer_dead_letters(accepted, F.lit(short_reason(error)), F.current_timestamp())
        write_producer_dead_letters(letters, dead_letter_root)
        return _totals(outcomes, True)
    return _totals(outcomes, False)
