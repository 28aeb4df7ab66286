"""Strict JSON decoding of log records.

``from_json`` alone is too forgiving here: it ignores text after the document,
turns a number into a string and knows only one spelling of a key. So a pattern
or a type check comes first, the cheapest one that settles the text:

* A line in the form this library writes is recognised by one pattern and split
  at its quotes. Nearly all stored lines take this way.
* Objects whose three known keys hold strings, in any order, with escapes and
  white space, are recognised by a second pattern and read by ``from_json``.
* Anything else is parsed as a VARIANT and its types are checked one by one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hourtally.functions.expressions import bind
from hourtally.functions.timestamps import PLAIN_TIME, parse_rfc3339

_WS = r"[ \t\r\n]*+"
_STRING = r'"(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"'
_PAIR = rf'"(?:timestamp|path|userAgent)"{_WS}:{_WS}{_STRING}{_WS}'
_OBJECT = rf"\{{{_WS}{_PAIR}(?:,{_WS}{_PAIR})*+\}}"

PLAIN_LINE = rf"\A{_WS}{_OBJECT}{_WS}\z"
PLAIN_BODY = rf"\A{_WS}\[{_WS}{_OBJECT}{_WS}(?:,{_WS}{_OBJECT}{_WS})*+\]{_WS}\z"

_BARE_STRING = r'"[^"\\\x00-\x1f]*+"'
STORED_LINE = (
    rf'\A\{{"timestamp":"{PLAIN_TIME}","path":{_BARE_STRING},"userAgent":{_BARE_STRING}\}}[ \t\r]*+\z'
)

FIELDS = ("timestamp", "path", "userAgent")
_TEXT_RECORD = "timestamp STRING, path STRING, userAgent STRING"
TEXT_RECORDS = f"ARRAY<STRUCT<{_TEXT_RECORD}>>"


def strict_document(text: Column) -> Column:
    """The single JSON document in ``text`` as a VARIANT, NULL if it is not one.

    The text is parsed as the first of two array elements, the second being a
    hash of the text itself. Trailing data moves or removes that second
    element, and no text can contain its own hash by accident.
    """
    mark = F.xxhash64(text).cast("string")
    pair = F.from_json(
        F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]')),
        "ARRAY<VARIANT>",
        {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"},
    )
    return bind(
        pair,
        lambda p: F.when(
            (F.size(p) == 2) & (F.try_variant_get(F.get(p, F.lit(1)), "$", "string") == mark),
            F.get(p, F.lit(0)),
        ),
    )


def _member(members: Column, name: str) -> Column:
    """A member by its exact name, else by any spelling of it, the last one first."""
    spelled = F.filter(F.map_entries(members), lambda entry: F.lower(entry["key"]) == name.lower())
    return F.coalesce(
        F.try_element_at(members, F.lit(name)), F.try_element_at(spelled, F.lit(-1))["value"]
    )


def _text_of(member: Column) -> Column:
    """``struct(ok, text)``: absent and null give no text, other types are wrong."""
    kind = F.coalesce(F.schema_of_variant(member), F.lit("VOID"))
    return F.struct(
        kind.isin("VOID", "STRING").alias("ok"),
        F.when(kind == "STRING", F.try_variant_get(member, "$", "string")).alias("text"),
    )


def record_of_variant(doc: Column) -> Column:
    """A record of text fields from one JSON value; NULL when it cannot be a record.

    ``null`` and missing members leave the fields NULL.
    """
    no_fields = F.struct(*[F.lit(None).cast("string").alias(name) for name in FIELDS])
    return F.when(F.is_variant_null(doc), no_fields).otherwise(
        bind(
            F.try_variant_get(doc, "$", "map<string,variant>"),
            lambda members: F.when(
                members.isNotNull(),
                bind(
                    F.struct(*[bind(_member(members, name), _text_of).alias(name) for name in FIELDS]),
                    lambda f: F.when(
                        f["timestamp"]["ok"] & f["path"]["ok"] & f["userAgent"]["ok"],
                        F.struct(*[f[name]["text"].alias(name) for name in FIELDS]),
                    ),
                ),
            ),
        )
    )


def typed_record(record: Column) -> Column:
    """Parse the timestamp; NULL when one is given and wrong.

    A missing text becomes the empty text, a missing timestamp stays NULL.
    """
    return bind(
        parse_rfc3339(record["timestamp"]),
        lambda ts: F.when(
            ts.isNotNull() | record["timestamp"].isNull(),
            F.struct(
                ts.alias("timestamp"),
                F.coalesce(record["path"], F.lit("")).alias("path"),
                F.coalesce(record["userAgent"], F.lit("")).alias("userAgent"),
            ),
        ),
    )


def stored_line_parts(line: Column) -> Column:
    """A line in stored form split at its quotes, NULL for any other line.

    The values are the parts 3, 7 and 11; the timestamp needs only a cast.
    """
    return F.when(line.rlike(STORED_LINE), F.split(line, '"', -1))


def record_of_line(line: Column) -> Column:
    """A record of text fields from any line; NULL when the line is malformed."""
    return F.when(line.rlike(PLAIN_LINE), F.from_json(line, _TEXT_RECORD)).otherwise(
        bind(strict_document(line), record_of_variant)
    )


def records_of_body(body: Column) -> Column:
    """The JSON array of a request body as an array of text records.

    NULL for anything but one array, and for an array with a wrong element;
    a ``null`` body is an empty array.
    """
    elements = bind(
        strict_document(body),
        lambda doc: F.when(F.is_variant_null(doc), F.array().cast("array<variant>")).otherwise(
            F.try_variant_get(doc, "$", "array<variant>")
        ),
    )
    checked = F.transform(elements, record_of_variant)
    general = bind(checked, lambda records: F.when(~F.exists(records, lambda r: r.isNull()), records))
    return F.when(body.rlike(PLAIN_BODY), F.from_json(body, TEXT_RECORDS)).otherwise(general)


def record_to_json(timestamp: Column, path: Column, user_agent: Column) -> Column:
    """One record as a line of JSON; the timestamp must already be text."""
    return F.to_json(
        F.struct(timestamp.alias("timestamp"), path.alias("path"), user_agent.alias("userAgent"))
    )
