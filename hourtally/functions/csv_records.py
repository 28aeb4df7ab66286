"""CSV request bodies: quoted fields may hold commas, quotes and newlines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hourtally.functions.expressions import WHITE_SPACE, bind, trim_space

# All quantifiers that could back off are possessive, so a pattern passes over
# a body once and needs no deep stack.
_RECORD = r'(?:[^"\n]++|"[^"]*+(?:"|\z))++'
_FIELD = r',((?U:\s)*+"(?:[^"]++|"")*+"|[^",]*+)'
_ROW = rf"\A(?:{_FIELD})++\z"
_QUOTED = r'\A(?U:\s)*+"'
_LEADING_SPACE = r"\A(?U:\s)++"
_HEADER = r"(?iu)\Atimestamp\z"


def _field(raw: Column) -> Column:
    unquoted = F.regexp_replace(raw, _LEADING_SPACE, "")
    quoted = F.replace(
        F.regexp_replace(F.regexp_replace(raw, _QUOTED, ""), r'"\z', ""), F.lit('""'), F.lit('"')
    )
    return F.when(raw.rlike(_QUOTED), quoted).otherwise(unquoted)


def _has_quotes(body: Column) -> Column:
    return F.contains(body, F.lit('"'))


def rows_of_body(body: Column) -> Column:
    """The rows of a CSV body; blank lines do not count, a badly quoted row is NULL.

    White space around a field may still be there.
    """
    text = F.regexp_replace(F.replace(body, F.lit("\r\n"), F.lit("\n")), r"\r\z", "")
    simple = F.transform(
        F.filter(F.split(text, "\n", -1), lambda line: line != ""), lambda line: F.split(line, ",", -1)
    )
    general = F.transform(
        F.regexp_extract_all(text, F.lit(_RECORD), F.lit(0)),
        lambda line: bind(
            F.concat(F.lit(","), line),
            lambda row: F.when(
                row.rlike(_ROW),
                F.transform(F.regexp_extract_all(row, F.lit(_FIELD), F.lit(1)), _field),
            ),
        ),
    )
    return F.when(_has_quotes(body), general).otherwise(simple)


def rows_are_even(rows: Column) -> Column:
    """Every row is well quoted and as wide as the first one."""
    width = F.size(F.get(rows, F.lit(0)))
    return ~F.exists(rows, lambda row: row.isNull() | (F.size(row) != width))


def has_header(rows: Column, body: Column) -> Column:
    """Whether the first row names the columns. Space before a name does not count,
    unless it is inside quotes."""
    first = F.get(rows, F.lit(0))
    name = F.get(first, F.lit(0))
    return (F.size(first) >= 3) & F.when(_has_quotes(body), name).otherwise(
        F.ltrim(name, F.lit(WHITE_SPACE))
    ).rlike(_HEADER)


def records_of_rows(rows: Column, body: Column) -> Column:
    """The rows below the header as text records, with their row number."""

    def record(row: Column, index: Column) -> Column:
        return F.struct(
            trim_space(F.get(row, F.lit(0))).alias("timestamp"),
            F.get(row, F.lit(1)).alias("path"),
            F.get(row, F.lit(2)).alias("userAgent"),
            (index + 1).alias("row"),
            (F.size(row) >= 3).alias("complete"),
        )

    numbered = F.transform(rows, record)
    return F.when(has_header(rows, body), F.slice(numbered, 2, 2**31 - 2)).otherwise(numbered)
