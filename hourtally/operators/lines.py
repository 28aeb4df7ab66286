"""Lines of hourly log files to records and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourtally.functions.expressions import Stages, built_once, trim_space, with_stages
from hourtally.functions.json_records import (
    record_of_line,
    stored_line_parts,
    typed_record,
)
from hourtally.schema import DIM_MALFORMED, DIM_OVERSIZED, DIM_PATH, DIM_USER_AGENT

# A line this long or longer makes its whole hour fail.
MAX_LINE_BYTES = 1024 * 1024


@built_once
def _decode_stages(max_line_bytes: int) -> Stages:
    value, parts, odd, text = F.col("value"), F.col("_parts"), F.col("_odd"), F.col("_text")
    too_long = F.octet_length(value) >= max_line_bytes
    stored = F.struct(
        F.col("_time").alias("timestamp"), parts[7].alias("path"), parts[11].alias("userAgent")
    )
    return [
        ("_parts", F.when(~too_long, stored_line_parts(value))),
        ("_time", parts[3].try_cast("timestamp")),
        ("_odd", F.when(parts.isNull() & ~too_long, trim_space(value))),
        ("_text", F.when(odd != "", record_of_line(odd))),
        ("record", F.when(F.col("_time").isNotNull(), stored).when(text.isNotNull(), typed_record(text))),
        (
            "line_state",
            F.when(too_long, F.lit("oversized"))
            .when(F.col("record").isNotNull(), F.lit("ok"))
            .when(odd == "", F.lit("blank"))
            .otherwise(F.lit("malformed")),
        ),
    ]


def decode_lines(lines: DataFrame, max_line_bytes: int = MAX_LINE_BYTES) -> DataFrame:
    """Replace ``value`` by ``record`` and ``line_state``.

    ``line_state`` is ``ok``, ``blank``, ``malformed`` or ``oversized``;
    ``record`` is NULL unless it is ``ok``. No line makes the job fail.
    """
    decoded = with_stages(lines, _decode_stages(max_line_bytes))
    return decoded.drop("value", "_parts", "_time", "_odd", "_text")


def count_decoded(decoded: DataFrame, group: str) -> DataFrame:
    """``group, dim, key, requests`` over decoded lines, in one scan and one shuffle.

    Every good line counts once under its path and once under its user agent; a
    bad one counts under ``malformed`` or ``oversized``. Counts are combined
    before the shuffle, so one hour or one key holding most lines is no harm.
    """
    entry = lambda dim, key: F.struct(F.lit(dim).alias("dim"), key.alias("key"))
    state = F.col("line_state")
    entries = (
        F.when(
            state == "ok",
            F.array(entry(DIM_PATH, F.col("record.path")), entry(DIM_USER_AGENT, F.col("record.userAgent"))),
        )
        .when(state == "malformed", F.array(entry(DIM_MALFORMED, F.lit(""))))
        .when(state == "oversized", F.array(entry(DIM_OVERSIZED, F.lit(""))))
    )
    return (
        decoded.select(group, F.inline(entries))
        .groupBy(group, "dim", "key")
        .agg(F.count(F.lit(1)).alias("requests"))
    )
