"""Request bodies: decoding, validation, outcomes."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from hourtally.operators.counters import ingest_counters
from hourtally.operators.ingest import (
    batch_outcomes,
    normalize_records,
    rejected_batches,
    validated_records,
)
from hourtally.schema import RAW_BATCH

JSON, CSV = "application/json", "text/csv"
T0 = "2023-01-02T03:04:05Z"
REC = '{"timestamp":"%s","path":"/a","userAgent":"u"}' % T0


def rec(ts=f'"{T0}"', path='"/a"', agent='"u"'):
    return f'{{"timestamp":{ts},"path":{path},"userAgent":{agent}}}'


# name: (content type, body, status, start of reason, records)
CASES = {
    "offset and trim": (
        JSON,
        '[{"timestamp":"2023-01-02T03:04:05+02:00","path":"/home","userAgent":" UA "}]',
        202,
        "",
        [("2023-01-02 01:04:05", "/home", "UA")],
    ),
    "broken json": (JSON, "{invalid", 400, "invalid JSON payload", None),
    "csv header and trim": (
        CSV,
        "timestamp,path,userAgent\n2023-03-04T10:00:00Z,/api ,test-agent\n"
        "2023-03-04T11:00:00Z,/health, second-agent \n",
        202,
        "",
        [("2023-03-04 10:00:00", "/api", "test-agent"), ("2023-03-04 11:00:00", "/health", "second-agent")],
    ),
    "csv two columns": (
        CSV,
        "timestamp,path\n2023-03-04T10:00:00Z,/api",
        400,
        "row 1 missing required columns",
        None,
    ),
    "blank path": (JSON, f"[{rec(path='\"\"')}]", 400, "record 0 missing path", None),
    "other type": ("application/xml", "<logs></logs>", 415, "unsupported content-type: application/xml", None),
    "no type": (None, f"[{REC}]", 415, "unsupported content-type: ", None),
    "type with charset": ("application/json; charset=utf-8", f"[{REC}]", 202, "", 1),
    "upper case type": ("Application/JSON", f"[{REC}]", 415, "unsupported content-type", None),
    "json before csv": ("text/csv, application/json", f"[{REC}]", 202, "", 1),
    "trailing data": (JSON, f'[{REC}]{{"extra":true}}', 400, "invalid JSON payload", None),
    "trailing array": (JSON, f"[{REC}],[{REC}]", 400, "invalid JSON payload", None),
    "closing early": (JSON, "],[", 400, "invalid JSON payload", None),
    "surrounding space": (JSON, f" \n[ {REC} ,\t{REC} ]\r\n", 202, "", 2),
    "too large": (
        JSON,
        f"[{rec(path='\"' + 'x' * 2097152 + '\"')}]",
        413,
        "request body too large",
        None,
    ),
    "large and unsupported": ("text/plain", "x" * 2097153, 415, "unsupported content-type", None),
    "empty json": (JSON, "", 400, "invalid JSON payload", None),
    "null body column": (JSON, None, 400, "invalid JSON payload", None),
    "empty array": (JSON, "[]", 400, "no log records provided", None),
    "null": (JSON, "null", 400, "no log records provided", None),
    "object": (JSON, "{}", 400, "invalid JSON payload", None),
    "null element": (JSON, f"[{REC},null]", 400, "record 1 missing timestamp", None),
    "empty element": (JSON, "[{}]", 400, "record 0 missing timestamp", None),
    "number element": (JSON, "[1]", 400, "invalid JSON payload", None),
    "numeric path": (JSON, f"[{rec(path='7')}]", 400, "invalid JSON payload", None),
    "object path": (JSON, f"[{rec(path='{}')}]", 400, "invalid JSON payload", None),
    "null path": (JSON, f"[{rec(path='null')}]", 400, "record 0 missing path", None),
    "null agent": (JSON, f"[{rec(agent='null')}]", 400, "record 0 missing userAgent", None),
    "null time": (JSON, f"[{rec(ts='null')}]", 400, "record 0 missing timestamp", None),
    "zero time": (JSON, f"[{rec(ts='\"0001-01-01T00:00:00Z\"')}]", 400, "record 0 missing timestamp", None),
    "bad time": (JSON, f"[{REC},{rec(ts='\"yesterday\"')}]", 400, "invalid JSON payload", None),
    "bad time beats blank path": (
        JSON,
        f"[{rec(path='\" \"')},{rec(ts='\"\"')}]",
        400,
        "invalid JSON payload",
        None,
    ),
    "no such day": (JSON, f"[{rec(ts='\"2023-02-30T00:00:00Z\"')}]", 400, "invalid JSON payload", None),
    "numeric time": (JSON, f"[{rec(ts='1')}]", 400, "invalid JSON payload", None),
    "unicode blank path": (JSON, f"[{rec(path='\" 　\"')}]", 400, "record 0 missing path", None),
    "duplicate key": (
        JSON,
        '[{"path":"/x","path":"/y","timestamp":"%s","userAgent":"u"}]' % T0,
        202,
        "",
        [("2023-01-02 03:04:05", "/y", "u")],
    ),
    "duplicate key with unknown": (
        JSON,
        '[{"path":"/x","n":1,"path":"/y","timestamp":"%s","userAgent":"u"}]' % T0,
        202,
        "",
        [("2023-01-02 03:04:05", "/y", "u")],
    ),
    "key spelling": (
        JSON,
        '[{"PATH":"/x","TimeStamp":"%s","useragent":"u"}]' % T0,
        202,
        "",
        [("2023-01-02 03:04:05", "/x", "u")],
    ),
    "unknown keys": (JSON, '[{"n":[1,{"a":null}],"path":"/x","timestamp":"%s","userAgent":"u"}]' % T0, 202, "", 1),
    "escapes": (
        JSON,
        f"[{rec(path='\"/a\\u0026b\\\"\\/\"')}]",
        202,
        "",
        [("2023-01-02 03:04:05", '/a&b"/', "u")],
    ),
    "single quotes": (JSON, "[{'path':'/a'}]", 400, "invalid JSON payload", None),
    "trailing comma": (JSON, f"[{REC},]", 400, "invalid JSON payload", None),
    "raw control character": (JSON, f"[{rec(path='\"/a\tb\"')}]", 400, "invalid JSON payload", None),
    "csv quoting": (
        CSV,
        f'{T0},"/a,b","say ""hi"""\n\n\n{T0}, "two\nlines" ,x',
        400,
        "invalid CSV payload",
        None,
    ),
    "csv quoted": (
        CSV,
        f'{T0},"/a,b","say ""hi"""\r\n\r\n\n{T0}, "two\r\nlines",x\n',
        202,
        "",
        [("2023-01-02 03:04:05", "/a,b", 'say "hi"'), ("2023-01-02 03:04:05", "two\nlines", "x")],
    ),
    "csv bare quote": (CSV, f'{T0},/a"b,u', 400, "invalid CSV payload", None),
    "csv open quote": (CSV, f'{T0},/a,"u\n{T0},/b,v', 400, "invalid CSV payload", None),
    "csv uneven": (CSV, f"{T0},/a,u\n{T0},/b,v,w", 400, "invalid CSV payload", None),
    "csv uneven quoted": (CSV, f'{T0},"/a",u\n{T0},/b', 400, "invalid CSV payload", None),
    "csv extra columns": (CSV, f"{T0},/a,u,more,{T0}", 202, "", 1),
    "csv header only": (CSV, "Timestamp,path,userAgent\n", 400, "no log records provided", None),
    "csv no header": (CSV, f"{T0},/a,u\r\n{T0},/b,v\r", 202, "", 2),
    "csv padded header": (CSV, f"timestamp ,path,userAgent\n{T0},/a,u", 400, "row 1 has invalid timestamp", None),
    "csv led header": (CSV, f"  TIMESTAMP,path,userAgent\n{T0},/a,u", 202, "", 1),
    "csv empty": (CSV, "", 400, "empty CSV payload", None),
    "csv blank lines": (CSV, "\n\r\n\n", 400, "empty CSV payload", None),
    "csv bad time": (CSV, f"timestamp,path,userAgent\n\n{T0},/a,u\nnow,/b,v", 400, "row 3 has invalid timestamp", None),
    "csv blank agent": (CSV, f"{T0},/a,u\n{T0},/b,　 ", 400, "record 1 missing userAgent", None),
    "csv short hour": (CSV, "2023-01-02T3:04:05Z,/a,u", 202, "", [("2023-01-02 03:04:05", "/a", "u")]),
    "csv leading empty field": (CSV, ",/a,u", 400, "row 1 has invalid timestamp", None),
}


@pytest.fixture(scope="module")
def outcomes(spark):
    rows = [(name, case[0], case[1]) for name, case in CASES.items()]
    frame = batch_outcomes(spark.createDataFrame(rows, RAW_BATCH))
    return {row["batch_id"]: row for row in frame.collect()}


@pytest.mark.parametrize("name", CASES)
def test_outcome(outcomes, name):
    _, _, status, reason, records = CASES[name]
    row = outcomes[name]
    assert (row["status"], row["reason"][: len(reason)]) == (status, reason)
    assert bool(row["reason"]) == (status != 202)
    if records is None:
        assert row["records"] is None
    elif isinstance(records, int):
        assert len(row["records"]) == records
    else:
        got = [(str(r["timestamp"]), r["path"], r["userAgent"]) for r in row["records"]]
        assert got == records


def test_records_rejects_and_counters_agree(spark):
    rows = [(name, case[0], case[1]) for name, case in CASES.items()]
    outcome = batch_outcomes(spark.createDataFrame(rows, RAW_BATCH))
    accepted = [name for name, case in CASES.items() if case[2] == 202]
    records = validated_records(outcome).collect()
    assert {r["batch_id"] for r in records} == set(accepted)
    rejects = rejected_batches(outcome).collect()
    assert {r["batch_id"] for r in rejects} == set(CASES) - set(accepted)
    totals = {r["metric"]: r["value"] for r in ingest_counters(outcome, F.col("batch_id") == "escapes").collect()}
    assert totals == {
        "log_batches_received_total": len(accepted) - 1,
        "invalid_requests_total": len(CASES) - len(accepted),
        "logs_ingested_total": len(records) - 1,
        "ingest_errors_total": 1,
    }


def test_decode_runs_once_per_batch(spark):
    """No filter may repeat the decode, and nothing is shuffled."""
    raw = spark.createDataFrame([("1", JSON, f"[{REC}]")], RAW_BATCH)
    for frame in (rejected_batches(batch_outcomes(raw)), validated_records(batch_outcomes(raw))):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        assert plan.count("from_json(ArrayType(VariantType") == 1
        assert plan.count("regexp_extract_all(regexp_replace") == 1


TIMES = {
    "2023-01-02T03:04:05Z": "2023-01-02 03:04:05",
    "2023-01-02T03:04:05.5Z": "2023-01-02 03:04:05.500000",
    "2023-01-02T03:04:05.123456789-01:30": "2023-01-02 04:34:05.123456",
    "2023-01-02T3:04:05Z": "2023-01-02 03:04:05",
    "2023-01-02T03:04:05,25Z": "2023-01-02 03:04:05.250000",
    "2023-01-02T03:04:05+23:00": "2023-01-01 04:04:05",
    "2023-01-02T03:04:05+25:00": None,
    "2023-01-02 03:04:05Z": None,
    "2023-01-02T03:04:05": None,
    "2023-01-02T03:04:05.Z": None,
    "2023-01-02T03:04:05z": None,
    "2023-01-02T24:00:00Z": None,
    "2023-01-02T03:60:00Z": None,
    "2023-02-30T00:00:00Z": None,
    "2023-1-02T00:00:00Z": None,
    "2023-01-02T03:04:05+0200": None,
    "2023-01-02T03:04:05Z\n": "2023-01-02 03:04:05",
    "": None,
}


def test_normalize(spark):
    rows = [(text, " \t/p\u0085", "　a b\n") for text in TIMES]
    frame = spark.createDataFrame(rows, "timestamp string, path string, userAgent string")
    frame = frame.withColumn("text", F.col("timestamp")).withColumn("timestamp", F.btrim("timestamp", F.lit("\n")))
    for row in normalize_records(frame).collect():
        want = TIMES[row["text"]]
        assert row["timestamp"] == (want and datetime.fromisoformat(want)), row["text"]
        assert (row["path"], row["userAgent"]) == ("/p", "a b")


def test_bodies_near_the_limit(spark):
    """Patterns must pass over large bodies once and without a deep stack."""
    size = 1_900_000
    many = ",".join([rec()] * (size // len(rec())))
    odd = many.replace('{"timestamp"', '{"n":0,"timestamp"', 1)
    rows = [
        ("many", JSON, f"[{many}]"),
        ("many odd", JSON, f"[{odd}]"),
        ("escapes", JSON, f"[{rec(path='\"' + '/' * 9 + chr(92) * 2 * (size // 2) + '\"')}]"),
        ("inner space", JSON, f"[{rec(path='\"/' + ' ' * size + 'x\"')}]"),
        ("open string", JSON, '[{"path":"' + "x" * size),
        ("brackets", JSON, "[" * size),
        ("csv", CSV, f"{T0},/a,u\n" * (size // 26)),
        ("csv quoted", CSV, f'{T0},"/a",u\n' * (size // 28)),
        ("csv quotes", CSV, f'{T0},"/{chr(34) * 2 * (size // 2)}",u'),
        ("csv open quote", CSV, f'{T0},/a,"' + "x" * size),
        ("csv newlines", CSV, "\n" * size + f'{T0},/a,"u"'),
        ("csv commas", CSV, f'{T0},/a,"u"' + "," * size),
    ]
    got = {
        r["batch_id"]: (r["status"], r["n"])
        for r in batch_outcomes(spark.createDataFrame(rows, RAW_BATCH))
        .select("batch_id", "status", F.coalesce(F.array_size("records"), F.lit(0)).alias("n"))
        .collect()
    }
    assert got == {
        "many": (202, size // len(rec())),
        "many odd": (202, size // len(rec())),
        "escapes": (202, 1),
        "inner space": (202, 1),
        "open string": (400, 0),
        "brackets": (400, 0),
        "csv": (202, size // 26),
        "csv quoted": (202, size // 28),
        "csv quotes": (202, 1),
        "csv open quote": (400, 0),
        "csv newlines": (202, 1),
        "csv commas": (202, 1),
    }
