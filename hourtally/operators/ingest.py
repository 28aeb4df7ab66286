"""Request bodies to outcomes and records.

Input is one row per body: ``batch_id, content_type, body``. A body is accepted
or rejected as a whole and its records stay in its row until then, so nothing
is shuffled and no batch is ever split over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourtally.functions import csv_records, json_records
from hourtally.functions.expressions import (
    Stages,
    bind,
    built_once,
    first_not_null,
    trim_space,
    with_stages,
)
from hourtally.functions.timestamps import is_zero_time, parse_rfc3339

MAX_BODY_BYTES = 2 * 1024 * 1024

ACCEPTED, INVALID, TOO_LARGE, UNSUPPORTED, STORE_ERROR = 202, 400, 413, 415, 500

UNSTORABLE = "timestamp outside of the years 0 to 9999"


def is_storable(ts: Column) -> Column:
    """Whether a time can be written as RFC 3339 text and found below its date; a missing one can."""
    return F.coalesce(F.year(ts).between(0, 9999), F.lit(True))


def keep_when(df: DataFrame, condition: Column, *columns: str) -> DataFrame:
    """The given columns of the rows that meet ``condition``.

    A filter on a decoded column would be pushed below the decode, which would
    then run twice for every row. A generator is not, so it drops the rows here.
    """
    return df.select(F.inline(F.when(condition, F.array(F.struct(*columns)))))


def _media_kind(content_type: Column, body_bytes: Column, max_body_bytes: int) -> Column:
    media = F.coalesce(content_type, F.lit(""))
    return (
        F.when(
            ~F.contains(media, F.lit("application/json")) & ~F.contains(media, F.lit("text/csv")),
            F.lit("unsupported"),
        )
        .when(body_bytes > max_body_bytes, F.lit("large"))
        .when(F.contains(media, F.lit("application/json")), F.lit("json"))
        .otherwise(F.lit("csv"))
    )


def _checked(records: Column, problem_of) -> Column:
    """Normalised records, each with its decoding problem and its missing field."""

    def check(record: Column, index: Column) -> Column:
        return bind(
            F.struct(
                parse_rfc3339(record["timestamp"]).alias("timestamp"),
                trim_space(F.coalesce(record["path"], F.lit(""))).alias("path"),
                trim_space(F.coalesce(record["userAgent"], F.lit(""))).alias("userAgent"),
            ),
            lambda r: F.struct(
                r.alias("record"),
                problem_of(record, r["timestamp"]).alias("problem"),
                F.when(is_zero_time(r["timestamp"]), F.lit("timestamp"))
                .when(r["path"] == "", F.lit("path"))
                .when(r["userAgent"] == "", F.lit("userAgent"))
                .alias("missing"),
                index.alias("index"),
            ),
        )

    return F.transform(records, check)


def _json_problem(record: Column, timestamp: Column) -> Column:
    return F.when(record["timestamp"].isNotNull() & timestamp.isNull(), F.lit("invalid JSON payload"))


def _csv_problem(record: Column, timestamp: Column) -> Column:
    row = F.concat(F.lit("row "), record["row"].cast("string"))
    return F.when(~record["complete"], F.concat(row, F.lit(" missing required columns"))).when(
        timestamp.isNull(), F.concat(row, F.lit(" has invalid timestamp"))
    )


@built_once
def _outcome_stages(max_body_bytes: int, sized: bool) -> Stages:
    kind, body, rows = F.col("_kind"), F.col("_body"), F.col("_rows")
    checked, bad = F.col("_checked"), F.col("_bad")
    body_bytes = F.col("body_bytes") if sized else F.octet_length(body)
    problem = first_not_null(F.transform(bad, lambda c: c["problem"]))
    missing = first_not_null(
        F.transform(
            bad,
            lambda c: F.concat(F.lit("record "), c["index"].cast("string"), F.lit(" missing "), c["missing"]),
        )
    )
    unstorable = F.exists(checked, lambda c: ~is_storable(c["record"]["timestamp"]))
    reason = (
        F.when(
            kind == "unsupported",
            F.concat(F.lit("unsupported content-type: "), F.coalesce("content_type", F.lit(""))),
        )
        .when(kind == "large", F.lit("request body too large"))
        .when((kind == "json") & checked.isNull(), F.lit("invalid JSON payload"))
        .when((kind == "csv") & (F.size(rows) == 0), F.lit("empty CSV payload"))
        .when((kind == "csv") & checked.isNull(), F.lit("invalid CSV payload"))
        .when(F.size(checked) == 0, F.lit("no log records provided"))
        .otherwise(F.coalesce(problem, missing, F.when(unstorable, UNSTORABLE), F.lit("")))
    )
    status = (
        F.when(kind == "unsupported", UNSUPPORTED)
        .when(kind == "large", TOO_LARGE)
        .when(F.col("reason") == "", ACCEPTED)
        .when(F.col("reason") == UNSTORABLE, STORE_ERROR)
        .otherwise(INVALID)
    )
    return [
        ("_body", F.coalesce(F.col("body"), F.lit(""))),
        ("_kind", _media_kind(F.col("content_type"), body_bytes, max_body_bytes)),
        ("_json", F.when(kind == "json", json_records.records_of_body(body))),
        ("_rows", F.when(kind == "csv", csv_records.rows_of_body(body))),
        ("_csv", F.when(csv_records.rows_are_even(rows), csv_records.records_of_rows(rows, body))),
        (
            "_checked",
            F.when(kind == "json", _checked(F.col("_json"), _json_problem)).when(
                kind == "csv", _checked(F.col("_csv"), _csv_problem)
            ),
        ),
        ("_bad", F.filter(checked, lambda c: c["problem"].isNotNull() | c["missing"].isNotNull())),
        ("reason", reason),
        ("status", status),
        (
            "records",
            F.when(F.col("status") == ACCEPTED, F.transform(checked, lambda c: c["record"])),
        ),
    ]


def batch_outcomes(batches: DataFrame, max_body_bytes: int = MAX_BODY_BYTES) -> DataFrame:
    """Each batch with ``status``, ``reason`` and, when accepted, its ``records``.

    The reason is empty for an accepted batch. Checks run in a fixed order:
    media type, size, syntax, then the records one by one; last, whether every
    time can be stored, which is an error of the store and not of the batch. A ``body_bytes``
    column, where there is one, gives the size in place of the body itself.
    """
    outcomes = with_stages(batches, _outcome_stages(max_body_bytes, "body_bytes" in batches.columns))
    return outcomes.drop("_body", "_kind", "_json", "_rows", "_csv", "_checked", "_bad")


def rejected_batches(outcomes: DataFrame) -> DataFrame:
    """``batch_id, status, reason`` of the batches that were not accepted."""
    return keep_when(outcomes, F.col("status") != ACCEPTED, "batch_id", "status", "reason")


def validated_records(outcomes: DataFrame) -> DataFrame:
    """``batch_id, position, timestamp, path, userAgent`` of the accepted records."""
    accepted = F.when(F.col("status") == ACCEPTED, F.col("records"))
    return outcomes.select("batch_id", F.posexplode(accepted).alias("position", "record")).select(
        "batch_id", "position", "record.*"
    )


def normalize_records(records: DataFrame) -> DataFrame:
    """Text records to stored form: RFC 3339 text to UTC time, white space trimmed."""
    return records.withColumns(
        {
            "timestamp": parse_rfc3339(F.col("timestamp")),
            "path": trim_space(F.col("path")),
            "userAgent": trim_space(F.col("userAgent")),
        }
    )
