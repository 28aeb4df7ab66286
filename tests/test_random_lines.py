"""Random lines and CSV bodies against plain Python, row by row."""

from __future__ import annotations

import json
import random
import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from hourtally.functions.csv_records import rows_are_even, rows_of_body
from hourtally.functions.expressions import WHITE_SPACE
from hourtally.operators.lines import decode_lines

FIELDS = ("timestamp", "path", "userAgent")
TIME = re.compile(
    r"([0-9]{4}-[0-9]{2}-[0-9]{2})T([0-9]{1,2}):([0-9]{2}):([0-9]{2})(?:[.,]([0-9]+))?(?:Z|([+-])([0-9]{2}):([0-9]{2}))"
)
TIMES = (
    "2024-02-29T23:59:59Z",
    "2024-01-01T1:02:03.5+07:00",
    "2024-01-01T01:02:03,123456789-23:59",
    "2023-02-29T00:00:00Z",
    "2024-01-01T24:00:00Z",
    "2024-01-01 01:02:03Z",
    "0001-01-01T00:00:00Z",
    "2024-01-01T01:02:03+24:61",
    "",
)


def parse_time(text):
    found = TIME.fullmatch(text)
    if not found:
        return None
    day, hour, minute, second, fraction, sign, off_hour, off_minute = found.groups()
    if off_hour and (int(off_hour) > 24 or int(off_minute) > 60):
        return None
    try:
        local = datetime.fromisoformat(f"{day}T{int(hour):02}:{minute}:{second}")
    except ValueError:
        return None
    local += timedelta(microseconds=int(((fraction or "") + "000000")[:6]))
    offset = timedelta(hours=int(off_hour or 0), minutes=int(off_minute or 0))
    return local + offset if sign == "-" else local - offset


def no_constant(_):
    raise ValueError


def expected(line):
    text = line.strip(WHITE_SPACE)
    if not text:
        return ("blank", None)
    try:
        doc = json.loads(text, object_pairs_hook=lambda pairs: ("object", pairs), parse_constant=no_constant)
    except (ValueError, RecursionError):
        return ("malformed", None)
    if doc is None:
        doc = ("object", [])
    if not isinstance(doc, tuple):
        return ("malformed", None)
    values = []
    for name in FIELDS:
        exact = [v for k, v in doc[1] if k == name]
        spelled = [v for k, v in doc[1] if k.lower() == name.lower()]
        value = (exact or spelled or [None])[-1]
        if value is not None and not isinstance(value, str):
            return ("malformed", None)
        values.append(value)
    timestamp = None if values[0] is None else parse_time(values[0])
    if timestamp is None and values[0] is not None:
        return ("malformed", None)
    return ("ok", (timestamp and str(timestamp), values[1] or "", values[2] or ""))


def random_line(rng):
    def text():
        return "".join(rng.choice(["a", "/", "&", "é", "\\n", '\\"', "\\u00e9", "\\\\", " ", "}", ",", ":", "{"]) for _ in range(rng.randrange(8)))

    def value(name):
        if rng.random() < 0.06:
            return rng.choice(["null", "1", "-0.5e3", "true", "[]", "{}", '{"a":[null]}', "01", "NaN", "nul", "'x'"])
        if name.lower() == "timestamp":
            return '"' + rng.choice(TIMES[:4] if rng.random() < 0.9 else TIMES) + '"'
        return '"' + text() + '"'

    names = list(FIELDS)
    if rng.random() < 0.3:
        rng.shuffle(names)
    if rng.random() < 0.15:
        names.insert(rng.randrange(len(names) + 1), rng.choice(["n", "PATH", "UserAgent", "path", "timestamp", ""]))
    if rng.random() < 0.1:
        names.pop(rng.randrange(len(names)))
    space = lambda: rng.choice(["", "", "", " ", "\t"]) if spaced else ""
    spaced = rng.random() < 0.4
    pairs = [f'{space()}"{n}"{space()}:{space()}{value(n)}{space()}' for n in names]
    line = "{" + ",".join(pairs) + "}"
    if rng.random() < 0.12:  # damage it
        at = rng.randrange(len(line))
        line = line[:at] + rng.choice(["", ",", "}", '"', "\\", "\x01", " x"]) + line[at + rng.randrange(2) :]
    if rng.random() < 0.1:
        line = rng.choice(["", " ", "　", "\t"]) + line + rng.choice(["\r", " ", "{}", "x", " "])
    return line


def test_random_lines(spark):
    rng = random.Random(7)
    lines = [random_line(rng) for _ in range(6000)]
    lines += ["", " \t", "null", "{}", "[]", "3", '"x"', "{", "true"]
    frame = spark.createDataFrame(list(enumerate(lines)), "id int, value string").repartition(4)
    states = {"ok": 0, "malformed": 0, "blank": 0}
    as_text = F.col("record").withField("timestamp", F.col("record.timestamp").cast("string"))
    for row in decode_lines(frame).withColumn("record", as_text).collect():
        want = expected(lines[row["id"]])
        if want[1] and want[1][0] and "." in want[1][0]:
            want = (want[0], (want[1][0].rstrip("0"), *want[1][1:]))
        record = row["record"] and tuple(row["record"])
        assert (row["line_state"], record) == want, lines[row["id"]]
        states[want[0]] += 1
    assert states["ok"] > 3000 and states["malformed"] > 500


def csv_rows(body):
    """Rows of a body, character by character; None where the quoting is wrong."""
    text = body.replace("\r\n", "\n")
    text = text[:-1] if text.endswith("\r") else text
    rows, at = [], 0
    while at < len(text):
        if text[at] == "\n":
            at += 1
            continue
        row = []
        while True:
            start = at
            while at < len(text) and text[at] != "\n" and text[at] in WHITE_SPACE:
                at += 1
            if at < len(text) and text[at] == '"':
                at, field = at + 1, ""
                while True:
                    close = text.find('"', at)
                    if close < 0:
                        return None
                    field, at = field + text[at:close], close + 1
                    if text[at : at + 1] != '"':
                        break
                    field, at = field + '"', at + 1
                if at < len(text) and text[at] not in ",\n":
                    return None
            else:
                at = start
                while at < len(text) and text[at] not in ",\n":
                    at += 1
                field = text[start:at].lstrip(WHITE_SPACE)
                if '"' in field:
                    return None
            row.append(field)
            if at >= len(text) or text[at] == "\n":
                at += 1
                break
            at += 1
        rows.append(row)
    return rows


def test_random_csv(spark):
    rng = random.Random(11)
    pieces = ["a", "b", ",", ",", "\n", "\r\n", '"', '""', " ", '"x"', ',"y,z"', '"p\nq"', "\r", "　", '\n"r""s"']
    bodies = ["".join(rng.choice(pieces) for _ in range(rng.randrange(14))) for _ in range(6000)]
    frame = spark.createDataFrame(list(enumerate(bodies)), "id int, body string").repartition(4)
    decoded = frame.withColumn("rows", rows_of_body(F.col("body"))).withColumn("even", rows_are_even(F.col("rows")))
    accepted = 0
    for row in decoded.collect():
        want = csv_rows(bodies[row["id"]])
        even = want is not None and len({len(r) for r in want}) <= 1
        assert bool(row["even"]) == even, repr(bodies[row["id"]])
        if even:
            accepted += len(want) > 0
            got = [[field.strip(WHITE_SPACE) for field in r] for r in row["rows"]]
            assert got == [[field.strip(WHITE_SPACE) for field in r] for r in want], repr(bodies[row["id"]])
    assert accepted > 1000
