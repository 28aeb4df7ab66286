"""RFC 3339 timestamps and UTC hours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What ``cast`` reads the same way as RFC 3339 does.
PLAIN_TIME = (
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]++)?"
    r"(?:Z|[+-](?:0[0-9]|1[0-7]):[0-5][0-9])"
)
_PLAIN = rf"\A{PLAIN_TIME}\z"
# Also accepted: a one-digit hour, a comma before the fraction, and offsets up
# to 24:60. Groups: date and time, fraction digits, offset.
_LENIENT = (
    r"\A([0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{1,2}:[0-9]{2}:[0-9]{2})(?:[.,]([0-9]++))?"
    r"(Z|[+-](?:[01][0-9]|2[0-4]):(?:[0-5][0-9]|60))\z"
)

ZERO_TIME = "0001-01-01 00:00:00Z"


def _parse_lenient(text: Column) -> Column:
    """The local time read as UTC, less the offset; the offset has a fixed width."""
    local = F.regexp_replace(text, _LENIENT, "$1.$20Z").try_cast("timestamp")
    number = lambda start: F.substring(text, start, 2).try_cast("int")
    seconds = number(-5) * 3600 + number(-2) * 60
    return (
        F.when(F.endswith(text, F.lit("Z")), local)
        .when(F.substring(text, -6, 1) == "-", local + F.make_dt_interval(secs=seconds))
        .otherwise(local - F.make_dt_interval(secs=seconds))
    )


def parse_rfc3339(text: Column) -> Column:
    """RFC 3339 text with an offset or ``Z`` as TIMESTAMP; NULL for anything else."""
    return F.when(text.rlike(_PLAIN), text.try_cast("timestamp")).when(
        text.rlike(_LENIENT), _parse_lenient(text)
    )


def is_zero_time(ts: Column) -> Column:
    """A missing time: NULL or the first instant of year 1."""
    return ts.isNull() | (ts == F.lit(ZERO_TIME).cast("timestamp"))


def stored_time(ts: Column) -> Column:
    """The time a record is stored under: a missing one is the zero time."""
    return F.coalesce(ts, F.lit(ZERO_TIME).cast("timestamp"))


def format_rfc3339(ts: Column) -> Column:
    """UTC text with the fraction only where there is one."""
    return F.concat(F.replace(ts.cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))


def utc_hour(ts: Column) -> Column:
    return F.date_trunc("hour", ts)


def hour_rfc3339(hour: Column) -> Column:
    return F.date_format(hour, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def date_token(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def hour_token(ts: Column) -> Column:
    return F.date_format(ts, "HH")
