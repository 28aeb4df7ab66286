"""Sorting failure reasons into those worth retrying and the rest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that mark a failure as transient.
TRANSIENT_TEXTS = (
    "connection refused",
    "connection reset",
    "broken pipe",
    "i/o timeout",
    "dial tcp",
    "network is unreachable",
    "leader not available",
    "temporary failure",
)
# The texts of timeouts, cancellations, a full queue and an open circuit.
TRANSIENT_ERRORS = (
    "context deadline exceeded",
    "context canceled",
    "producer queue full",
    "producer circuit open",
)


def is_transient(reason: Column) -> Column:
    """Whether a failure reason names a passing condition."""
    texts = "|".join(text.replace(".", r"\.") for text in TRANSIENT_TEXTS + TRANSIENT_ERRORS)
    return F.lower(F.coalesce(reason, F.lit(""))).rlike(texts)


def triage_class(reason: Column) -> Column:
    return F.when(is_transient(reason), F.lit("transient")).otherwise(F.lit("permanent"))
