"""Object keys and paths: hours read from them, and keys built for hours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hourtally.functions.expressions import trim_space
from hourtally.functions.timestamps import date_token, hour_token

LOG_SUFFIX = ".log.json"

# <date>/<HH>.log.json directly below the root.
_FLAT = r"\A([0-9]{4}-[0-9]{2}-[0-9]{2}/[0-9]{1,2})\.log\.json\z"
# The last segments of a key: <date>/<hour>/<file>.log.json,
# <date>/<hour>.log.json, or date=<date>/hour=<hour>/<any file>.
_ANY = (
    r"(?:\A|/)(?:([0-9]{4}-[0-9]{2}-[0-9]{2}/[0-9]{1,2})(?:/[^/]*)?\.log\.json"
    r"|date=([0-9]{4}-[0-9]{2}-[0-9]{2}/hour=[0-9]{1,2})/[^/]+)\z"
)
# <date>/summary_<HH>.json or date=<date>/hour=<hour>/<any file>.
_SUMMARY = (
    r"(?:\A|/)(?:([0-9]{4}-[0-9]{2}-[0-9]{2}/)summary_([0-9]{1,2})\.json"
    r"|date=([0-9]{4}-[0-9]{2}-[0-9]{2}/)hour=([0-9]{1,2})/[^/]+)\z"
)


def _tail(key: Column) -> Column:
    """The last three segments, where every layout keeps date and hour."""
    return F.substring_index(F.btrim(trim_space(key), F.lit("/")), "/", -3)


def hour_of_token(token: Column) -> Column:
    """``<date>/<hour>`` as the hour's TIMESTAMP; NULL for no such date or hour."""
    return F.try_to_timestamp(F.replace(token, F.lit("hour=")), F.lit("yyyy-MM-dd/H"))


def token_of_key(key: Column) -> Column:
    """The ``<date>/<hour>`` text inside a log key, unchecked; NULL without one.

    """
    tail = _tail(key)
    return F.nullif(
        F.concat(F.regexp_extract(tail, _ANY, 1), F.regexp_extract(tail, _ANY, 2)), F.lit("")
    )


def token_of_file_path(path: Column) -> Column:
    """The same for the path of a scanned file, as ``<date>/<HH>``; empty without one.

    Meant for every line of a scan, so it matches only the last path segments
    and pads the hour with plain string functions.
    """
    token = F.regexp_extract(
        F.substring_index(path, "/", -3),
        r"(?:\A|/|date=)([0-9]{4}-[0-9]{2}-[0-9]{2}/(?:hour=)?[0-9]{1,2})(?:/[^/]*|\.log\.json)\z",
        1,
    )
    hour = F.substring_index(F.substring_index(token, "/", -1), "=", -1)
    return F.concat(F.substring(token, 1, 11), F.lpad(hour, 2, "0"))


def hour_from_key(key: Column) -> Column:
    """Hour of a log object below any prefix; NULL when the key has none."""
    return hour_of_token(token_of_key(key))


def hour_from_flat_path(path: Column, root: str) -> Column:
    """Hour of ``<root>/<date>/<HH>.log.json``; NULL for any other place."""
    prefix = root.rstrip("/") + "/"
    relative = F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 2**30))
    return hour_of_token(F.nullif(F.regexp_extract(relative, _FLAT, 1), F.lit("")))


def hour_from_summary_key(key: Column) -> Column:
    """Hour of a stored summary; NULL when the key has none."""
    tail = _tail(key)
    part = lambda group: F.regexp_extract(tail, _SUMMARY, group)
    return hour_of_token(F.nullif(F.concat(part(1), part(2), part(3), part(4)), F.lit("")))


def flat_log_key(ts: Column, prefix: str) -> Column:
    """``<prefix>/<date>/<HH>.log.json``"""
    return F.concat(F.lit(prefix + "/"), date_token(ts), F.lit("/"), hour_token(ts), F.lit(LOG_SUFFIX))


def hour_prefix(ts: Column, prefix: str) -> Column:
    """``<prefix>/<date>/<HH>``, below which an hour keeps its shards."""
    return F.concat(F.lit(prefix + "/"), date_token(ts), F.lit("/"), hour_token(ts))


def shard_log_key(ts: Column, prefix: str, writer: Column, seq: Column) -> Column:
    """``<prefix>/<date>/<HH>/<writer>-<seq>.log.json``"""
    return F.concat(
        hour_prefix(ts, prefix), F.lit("/"), writer, F.lit("-"), seq.cast("string"), F.lit(LOG_SUFFIX)
    )


def summary_path(hour: Column, root: str) -> Column:
    """``<root>/<date>/summary_<HH>.json``"""
    return F.concat(
        F.lit(root + "/"), date_token(hour), F.lit("/summary_"), hour_token(hour), F.lit(".json")
    )


def sanitize_writer_id(value: Column) -> Column:
    """Letters, digits, ``-``, ``_`` and ``.`` stay; others become ``-``; edge ``-`` go."""
    return F.btrim(F.regexp_replace(trim_space(value), "[^A-Za-z0-9_.-]", "-"), F.lit("-"))
