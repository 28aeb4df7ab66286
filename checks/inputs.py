"""Log lines, request bodies, listings and messages made from every row of ``events``.

The library reads text, so its inputs are spelled out here as text, with faults
placed by id. A fault only changes how a row is written; bodies without records
(every 41st batch) alone leave rows out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourtally import configure
from hourtally.functions.keys import flat_log_key, sanitize_writer_id, shard_log_key
from hourtally.functions.timestamps import date_token, format_rfc3339, hour_token
from hourtally.sources.files import open_file_system

RECORDS_PER_BATCH = 10
# Bodies above this are too large; the padded ones are.
BODY_LIMIT = 8 * 1024


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/events.parquet")


def log_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``timestamp, path, userAgent`` of every event; ``timestamp`` keeps its stored type,
    so that ranges on it reach the file scan."""
    return events(spark, sf_dir).select(
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("/"), "event_type").alias("path"),
        F.concat(F.lit("ua-"), (F.col("user_id") % 7).cast("string")).alias("userAgent"),
        "event_id",
        "user_id",
        "value",
    )


def _every(n: int, column: str = "event_id") -> Column:
    return F.col(column) % n == 0


def _micros(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def _json(ts: Column, path: Column, agent: Column, path_key: str = "path") -> Column:
    return F.concat(
        F.lit('{"timestamp":"'), ts, F.lit(f'","{path_key}":"'), path, F.lit('","userAgent":"'), agent, F.lit('"}')
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, hour, value``: one NDJSON line per event, some of them odd."""
    view = log_view(spark, sf_dir)
    ts = F.concat(_micros(F.col("timestamp")), F.lit("Z"))
    path, agent = F.col("path"), F.col("userAgent")
    line = (
        F.when(_every(50), F.lit("{not-json"))
        .when(_every(77), F.concat(F.lit('{"timestamp":"'), ts, F.lit('","path":7,"userAgent":"u"}')))
        .when(_every(91), F.concat(F.lit('{"timestamp":"'), ts, F.lit('","path":"'), path, F.lit('"}')))
        .when(_every(19), F.lit(" \t"))
        .when(_every(17), F.concat(F.lit("  {\"n\":[1,{}],"), F.substr(_json(ts, path, agent), F.lit(2)), F.lit("\r")))
        .when(_every(13), _json(ts, path, agent, "PATH"))
        .when(_every(11), F.concat(_json(ts, path, agent), F.lit(" {}")))
        .when(_every(7), _json(ts, F.concat(path, F.lit("\\u0026\\\"q\\\"")), agent))
        .otherwise(_json(ts, path, agent))
    )
    return view.select("event_id", F.date_trunc("hour", "timestamp").alias("hour"), line.alias("value"))


def padded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``hour, value``: valid lines whose length follows the event's value."""
    view = log_view(spark, sf_dir)
    pad = F.repeat(F.lit("x"), F.floor("value").cast("int"))
    line = F.concat(F.lit('{"path":"'), "path", F.lit('","userAgent":"'), pad, F.lit('"}'))
    return view.select(F.date_trunc("hour", "timestamp").alias("hour"), line.alias("value"))


def untidy_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text records with offsets, short hours, comma fractions and Unicode white space."""
    ts = F.col("timestamp")
    seven_hours = F.expr("INTERVAL 7 HOURS")
    text = (
        F.when(_every(5), F.concat(_micros(ts + seven_hours), F.lit("+07:00")))
        .when(_every(3), F.concat(F.replace(_micros(ts), F.lit("."), F.lit(",")), F.lit("Z")))
        .when(_every(2), F.concat(F.date_format(ts, "yyyy-MM-dd'T'H:mm:ss.SSSSSS"), F.lit("Z")))
        .when(_every(11), F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("Z")))
        .otherwise(F.concat(_micros(ts - seven_hours), F.lit("000-07:00")))
    )
    return log_view(spark, sf_dir).select(
        "event_id",
        text.alias("timestamp"),
        F.concat(F.lit(" \t　"), "path", F.lit(" x\u0085\n")).alias("path"),
        F.concat(F.lit(" "), "userAgent").alias("userAgent"),
    )


def raw_batches(spark: SparkSession, sf_dir: str, media: str = "mixed") -> DataFrame:
    """``batch_id, content_type, body``: ten neighbouring events to a body.

    ``media`` is ``json``, ``csv`` or ``mixed``. Collecting the records of a
    batch is bounded by the ten ids it can have. The shuffle that brings them
    together has a fixed number of partitions, which decoding then uses.
    """
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    batch = F.floor(F.col("event_id") / RECORDS_PER_BATCH).cast("bigint")
    view = log_view(spark, sf_dir).withColumn("batch_id", batch)
    position = F.col("event_id") % RECORDS_PER_BATCH
    as_csv = {"json": F.lit(False), "csv": F.lit(True), "mixed": F.col("batch_id") % 2 == 1}[media]
    ts = (
        F.when(_every(37, "batch_id") & (position == 2), F.lit("not a time"))
        .when(_every(5, "batch_id"), F.concat(_micros(F.col("timestamp") + F.expr("INTERVAL 7 HOURS")), F.lit("+07:00")))
        .otherwise(F.concat(_micros(F.col("timestamp")), F.lit("Z")))
    )
    path = F.when(_every(31, "batch_id") & (position == 3), F.lit("  ")).otherwise(
        F.concat(F.lit(" "), "path", F.when(_every(3), F.lit(',"q"')).otherwise(F.lit("")))
    )
    json_path = F.replace(path, F.lit('"'), F.lit('\\"'))
    csv_path = F.when(
        _every(3), F.concat(F.lit('"'), F.replace(path, F.lit('"'), F.lit('""')), F.lit('"'))
    ).otherwise(path)
    agent = F.col("userAgent")
    record = F.when(as_csv, F.concat_ws(",", ts, csv_path, agent)).otherwise(
        F.when(_every(7, "batch_id"), _json(ts, json_path, agent, "Path")).otherwise(_json(ts, json_path, agent))
    )
    bodies = (
        view.select("batch_id", "event_id", record.alias("record"))
        .repartition(partitions, "batch_id")
        .groupBy("batch_id")
        .agg(F.array_sort(F.collect_list(F.struct("event_id", "record"))).alias("rows"))
        .withColumn("rows", F.when(_every(41, "batch_id"), F.slice("rows", 1, 0)).otherwise(F.col("rows")))
    )
    records = F.transform("rows", lambda r: r["record"])
    json_body = F.concat(
        F.lit("["),
        F.array_join(records, ","),
        F.when(_every(29, "batch_id"), F.lit("")).otherwise(F.lit("]")),
    )
    csv_body = F.concat(
        F.lit("timestamp,path,userAgent\r\n"),
        F.array_join(records, "\r\n"),
        F.when(_every(29, "batch_id"), F.lit('"')).otherwise(F.lit("\n")),
    )
    padding = F.when(_every(43, "batch_id"), F.repeat(F.lit("\n"), F.lit(BODY_LIMIT))).otherwise(F.lit(""))
    return bodies.select(
        F.col("batch_id"),
        F.when(_every(23, "batch_id"), F.lit("application/xml"))
        .when(as_csv, F.lit("text/csv"))
        .otherwise(F.lit("application/json; charset=utf-8"))
        .alias("content_type"),
        F.concat(F.when(as_csv, csv_body).otherwise(json_body), padding).alias("body"),
    )


def log_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, key``: object keys of every layout, and some of none."""
    view = log_view(spark, sf_dir)
    ts, kind = F.col("timestamp"), F.col("event_id") % 6
    day = F.concat(F.lit("logs/"), date_token(ts), F.lit("/"))
    writer = F.concat(F.lit("pod-"), (F.col("user_id") % 3).cast("string"))
    key = (
        F.when(kind == 0, flat_log_key(ts, "logs"))
        .when(kind == 1, shard_log_key(ts, "logs", writer, F.col("event_id")))
        .when(kind == 2, F.concat(F.lit("x/date="), date_token(ts), F.lit("/hour="), hour_token(ts), F.lit("/part-0.txt")))
        .when(kind == 3, F.concat(day, (F.hour(ts) + 24).cast("string"), F.lit(".log.json")))
        .when(kind == 4, F.concat(F.lit("/"), day, F.hour(ts).cast("string"), F.lit(".log.json ")))
        .otherwise(F.concat(day, hour_token(ts), F.lit("/notes.txt")))
    )
    return view.select("event_id", key.alias("key"))


def shard_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``key, timestamp, path, userAgent``: records in the object that holds them.

    An hour has up to three shards and a flat file; some objects are not logs.
    """
    ts = F.col("timestamp")
    writer = sanitize_writer_id(F.concat(F.lit(" pod/"), (F.col("user_id") % 4).cast("string")))
    key = (
        F.when(F.col("user_id") % 4 == 3, flat_log_key(ts, "logs"))
        .when(F.col("user_id") % 11 == 10, F.concat(F.lit("logs/"), date_token(ts), F.lit("/notes.txt")))
        .otherwise(shard_log_key(ts, "logs", writer, F.hour(ts)))
    )
    return log_view(spark, sf_dir).select(key.alias("key"), "timestamp", "path", "userAgent")


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``key, modified, bytes`` of the objects above: newest record and summed path length."""
    return (
        shard_lines(spark, sf_dir)
        .groupBy("key")
        .agg(
            F.max("timestamp").cast("timestamp").alias("modified"),
            F.sum(F.octet_length("path")).cast("bigint").alias("bytes"),
        )
    )


def summary_times(hours: DataFrame) -> DataFrame:
    """``hour, modified`` of stored summaries: one second older than, equal to or newer
    than the newest log by turns; every fifth hour of the day has none."""
    of_day = F.hour("hour")
    shift = F.make_dt_interval(secs=(of_day % 3 - 1).cast("decimal(18,6)"))
    modified = F.when(of_day % 5 != 0, F.col("latest") + shift)
    return hours.select("hour", modified.alias("modified")).where(F.col("modified").isNotNull())


def failure_reason(id_column: str) -> Column:
    return F.element_at(
        F.array(
            F.lit("dial tcp 10.0.0.1:9092: connect: Connection Refused"),
            F.lit("disk write failed"),
            F.lit("producer queue full"),
            F.lit("Leader Not Available"),
            F.lit("record too large"),
        ),
        (F.col(id_column) % 5 + 1).cast("int"),
    )


def text_time(ts: Column) -> Column:
    return format_rfc3339(ts.cast("timestamp"))


def write_log_files(view: DataFrame, root: str, name: Column, empty: str | None = None) -> None:
    """``<root>/<date>/<HH><name>.log.json`` files of the events, one per hour and name.

    Spark's writers choose their files' names themselves, so tasks write these;
    ``root`` is on a file system that Arrow opens. ``empty`` adds an empty file
    to every hour.
    """
    key = F.concat(date_token(F.col("timestamp")), F.lit("/"), hour_token(F.col("timestamp")), name, F.lit(".log.json"))
    line = _json(format_rfc3339(F.col("timestamp")), F.col("path"), F.col("userAgent"))

    def write(batches):
        file_system, base = open_file_system(root)
        out, current = None, None
        for batch in batches:
            for key, line in zip(batch.column("key").to_pylist(), batch.column("line").to_pylist()):
                if key != current:
                    if out:
                        out.close()
                    path, current = f"{base}/{key}", key
                    file_system.create_dir(path.rpartition("/")[0])
                    out = file_system.open_output_stream(path)
                    if empty:
                        file_system.open_output_stream(re.sub("(/[0-9]{2})(/[^/]*)?$", r"\1", path.removesuffix(".log.json")) + empty + ".log.json").close()
                out.write(f"{line}\n".encode())
        if out:
            out.close()
        yield from ()

    rows = view.select(key.alias("key"), line.alias("line")).repartition("key").sortWithinPartitions("key")
    rows.mapInArrow(write, "done INT").count()


def write_bodies(batches: DataFrame, root: str) -> None:
    """A file per batch, named by its id and type; every third name is hidden from Spark's readers."""
    suffix = F.when(F.startswith("content_type", F.lit("application/json")), F.lit(".json")).otherwise(
        F.when(F.col("content_type") == "text/csv", F.lit(".csv")).otherwise(F.lit(".xml"))
    )
    hidden = F.element_at(F.array(F.lit(""), F.lit("_"), F.lit("in/")), (F.col("batch_id") % 3 + 1).cast("int"))
    name = F.concat(hidden, F.col("batch_id").cast("string"), suffix)

    def write(batches):
        file_system, base = open_file_system(root)
        file_system.create_dir(f"{base}/in", recursive=True)
        for batch in batches:
            for name, body in zip(batch.column("name").to_pylist(), batch.column("body").to_pylist()):
                with file_system.open_output_stream(f"{base}/{name}") as out:
                    out.write(body.encode())
        yield from ()

    batches.select(name.alias("name"), "body").mapInArrow(write, "done INT").count()
