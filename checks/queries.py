"""One query per operator, over the whole ``events`` table."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import inputs
from hourtally.functions import keys
from hourtally.functions.timestamps import date_token, hour_rfc3339, hour_token, utc_hour
from hourtally.operators import counting, counters, dead_letters, documents, freshness, ingest, lines
from hourtally.operators.ingest import ACCEPTED, keep_when
from hourtally.plans.compaction import compact
from hourtally.plans.ingest import publish_batches
from hourtally.plans.refresh import counts_path, refresh, refresh_current_hour, runs_path
from hourtally.plans.replay import replay_consumer_letters
from hourtally.session import ensure_checkpoint_dir, materialize
from hourtally.sinks.dead_letters import write_consumer_dead_letters
from hourtally.sinks.hourly_logs import encode_records, write_hourly
from hourtally.sinks.summaries import read_counts
from hourtally.sources.batches import bodies_of
from hourtally.sources.hourly_logs import read_lines
from hourtally.streaming.arrivals import take_arrivals
from hourtally.streaming.ingest import start_ingest, stream_counters
from hourtally.streaming.refresh import read_windowed_counts, start_windowed_counts

HOUR = datetime(2024, 1, 15, 10, 30)
LINE_LIMIT = 400


def _with_hour_text(df: DataFrame, *columns: Column | str) -> DataFrame:
    return df.select(hour_rfc3339(F.col("hour")).alias("hour"), *columns)


def requests_per_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_hour_text(counting.requests_per_path(inputs.log_view(spark, sf_dir)), "path", "requests")


def requests_per_user_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = counting.requests_per_user_agent(inputs.log_view(spark, sf_dir))
    return _with_hour_text(counts, "userAgent", "requests")


def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_hour_text(counting.hourly_counts(inputs.log_view(spark, sf_dir)), "dim", "key", "requests")


def hourly_summary_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = counting.hourly_counts(inputs.log_view(spark, sf_dir))
    return _with_hour_text(
        documents.summary_documents(counts),
        F.col("part").cast("bigint").alias("part"),
        F.col("parts").cast("bigint").alias("parts"),
        "document",
    )


def aggregate_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = counting.records_of_hour(inputs.log_view(spark, sf_dir), HOUR)
    return _with_hour_text(counting.hourly_counts(records), "dim", "key", "requests")


def utc_hour_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("timestamp")
    return inputs.log_view(spark, sf_dir).select(
        "event_id",
        hour_rfc3339(utc_hour(ts)).alias("hour"),
        date_token(ts).alias("date_token"),
        hour_token(ts).alias("hour_token"),
        keys.flat_log_key(ts, "logs").alias("flat_key"),
        keys.hour_prefix(ts, "logs").alias("shard_prefix"),
    )


def summary_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = inputs.log_view(spark, sf_dir).select(utc_hour(F.col("timestamp")).alias("hour")).distinct()
    return _with_hour_text(hours.withColumn("path", keys.summary_path(F.col("hour"), "analytics")), "path")


def tumbling_hour_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.tumbling_counts(inputs.log_view(spark, sf_dir)).select(
        hour_rfc3339(F.col("window_start")).alias("window_start"),
        hour_rfc3339(F.col("window_end")).alias("window_end"),
        "path",
        "requests",
    )


def batch_hour_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = F.floor(F.col("event_id") / inputs.RECORDS_PER_BATCH).cast("bigint").alias("batch_id")
    records = inputs.log_view(spark, sf_dir).select(batch, "timestamp")
    return counting.batch_hour_groups(records).select(
        "batch_id", hour_rfc3339(F.col("hour")).alias("hour"), "records"
    )


def ndjson_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_records(inputs.log_view(spark, sf_dir)).select("event_id", "value")


def ndjson_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = lines.decode_lines(inputs.log_lines(spark, sf_dir))
    return decoded.select(
        "event_id",
        "line_state",
        inputs.text_time(F.col("record.timestamp")).alias("timestamp"),
        F.col("record.path").alias("path"),
        F.col("record.userAgent").alias("userAgent"),
    )


def ndjson_hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = lines.decode_lines(inputs.log_lines(spark, sf_dir))
    return _with_hour_text(lines.count_decoded(decoded, "hour"), "dim", "key", "requests")


def _decoded_batches(spark: SparkSession, sf_dir: str, media: str) -> DataFrame:
    return ingest.batch_outcomes(inputs.raw_batches(spark, sf_dir, media), inputs.BODY_LIMIT)


def _record_rows(outcomes: DataFrame) -> DataFrame:
    return ingest.validated_records(outcomes).select(
        "batch_id",
        F.col("position").cast("bigint").alias("position"),
        inputs.text_time(F.col("timestamp")).alias("timestamp"),
        "path",
        "userAgent",
    )


def decode_json_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _record_rows(_decoded_batches(spark, sf_dir, "json"))


def decode_csv_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _record_rows(_decoded_batches(spark, sf_dir, "csv"))


def validated_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _record_rows(_decoded_batches(spark, sf_dir, "mixed"))


def batch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded_batches(spark, sf_dir, "mixed").select(
        "batch_id",
        F.col("status").cast("bigint").alias("status"),
        "reason",
        F.coalesce(F.array_size("records"), F.lit(0)).cast("bigint").alias("n_records"),
    )


def rejected_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejected = ingest.rejected_batches(_decoded_batches(spark, sf_dir, "mixed"))
    return rejected.select("batch_id", F.col("status").cast("bigint").alias("status"), "reason")


def ingest_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.ingest_counters(_decoded_batches(spark, sf_dir, "mixed"), F.col("batch_id") % 53 == 0)


def normalize_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    tidy = ingest.normalize_records(inputs.untidy_records(spark, sf_dir))
    return tidy.withColumn("timestamp", inputs.text_time(F.col("timestamp")))


def parse_hour_from_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = hour_rfc3339(keys.hour_from_key(F.col("key")))
    return inputs.log_keys(spark, sf_dir).select("event_id", "key", F.coalesce(hour, F.lit("")).alias("hour"))


def list_log_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    located = freshness.log_objects(inputs.listing(spark, sf_dir))
    return located.orderBy("key").select(
        "key",
        hour_rfc3339(F.col("hour")).alias("hour"),
        inputs.text_time(F.col("modified")).alias("modified"),
        "bytes",
    )


def _hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freshness.objects_per_hour(freshness.log_objects(inputs.listing(spark, sf_dir)))


def objects_per_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_hour_text(_hours(spark, sf_dir).orderBy("hour"), "objects", "bytes")


def latest_object_per_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_hour_text(_hours(spark, sf_dir), inputs.text_time(F.col("latest")).alias("latest"))


def merge_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = inputs.shard_lines(spark, sf_dir).where(F.endswith("key", F.lit(keys.LOG_SUFFIX)))
    # The hour of a record is that of the object it lies in.
    located = shards.withColumn("timestamp", keys.hour_from_key(F.col("key")))
    return _with_hour_text(counting.hourly_counts(located), "dim", "key", "requests")


def _stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = _hours(spark, sf_dir)
    return freshness.stale_hours(hours, inputs.summary_times(hours))


def stale_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_hour_text(_stale(spark, sf_dir), inputs.text_time(F.col("latest")).alias("latest"))


def incremental_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    stale = materialize(_stale(spark, sf_dir).select("hour"))
    view = inputs.log_view(spark, sf_dir).withColumn("hour", utc_hour(F.col("timestamp")))
    return _with_hour_text(
        counting.hourly_counts(view.join(stale.select("hour").distinct(), "hour", "left_semi")), "dim", "key", "requests"
    )


def oversized_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = lines.decode_lines(inputs.padded_lines(spark, sf_dir), LINE_LIMIT)
    return _with_hour_text(freshness.oversized_hours(lines.count_decoded(decoded, "hour")), "oversized_lines")


def sanitize_writer_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("\t-"), "event_type", F.lit(" /é_"), F.col("user_id").cast("string"), F.lit(".x*\n"))
    return inputs.events(spark, sf_dir).select("event_id", keys.sanitize_writer_id(raw).alias("writer_id"))


def _consumer_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = lines.decode_lines(inputs.log_lines(spark, sf_dir)).withColumns(
        {"partition": (F.col("event_id") % 3).cast("int"), "offset": F.col("event_id")}
    )
    good = keep_when(decoded, F.col("line_state") == "ok", "record", "partition", "offset")
    return dead_letters.consumer_dead_letters(good, inputs.failure_reason("offset"))


def dlq_consumer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consumer_letters(spark, sf_dir).select(
        F.col("partition").cast("bigint").alias("partition"),
        "offset",
        inputs.text_time(F.col("record.timestamp")).alias("timestamp"),
        F.col("record.path").alias("path"),
        F.col("record.userAgent").alias("userAgent"),
        "reason",
    )


def dlq_producer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted = keep_when(
        _decoded_batches(spark, sf_dir, "mixed"), F.col("status") == ACCEPTED, "batch_id", "records"
    )
    newest = F.array_max(F.transform("records", lambda r: r["timestamp"]))
    letters = dead_letters.producer_dead_letters(accepted, inputs.failure_reason("batch_id"), newest)
    return letters.select(
        "batch_id",
        F.size("records").cast("bigint").alias("n_records"),
        "reason",
        inputs.text_time(F.col("time")).alias("time"),
    )


def dlq_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dead_letters.triage(_consumer_letters(spark, sf_dir))


def _fresh_folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/check-{uuid.uuid4().hex}"


def stored_hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through the files: write the hourly logs, list them, refresh, read the counts."""
    folder = _fresh_folder(spark)
    write_hourly(inputs.log_view(spark, sf_dir), f"{folder}/logs")
    refresh(spark, f"{folder}/logs", f"{folder}/analytics")
    counts = read_counts(spark, counts_path(f"{folder}/analytics"))
    return _with_hour_text(counts.where(F.col("dim") != "listed"), "dim", "key", "requests")


def streamed_hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through the stream: messages in, hourly logs out, then the counts of the stored lines."""
    folder = _fresh_folder(spark)
    inputs.log_lines(spark, sf_dir).select(
        "value", (F.col("event_id") % 3).cast("int").alias("partition"), F.col("event_id").alias("offset")
    ).write.parquet(f"{folder}/topic")
    messages = (
        spark.readStream.schema("value STRING, partition INT, offset BIGINT")
        .option("maxFilesPerTrigger", 1000)
        .parquet(f"{folder}/topic")
    )
    query = start_ingest(
        messages, f"{folder}/logs", f"{folder}/dead", f"{folder}/checkpoint", None, name=f"check-{uuid.uuid4().hex}"
    )
    query.awaitTermination()
    refresh(spark, f"{folder}/logs", f"{folder}/analytics")
    counts = read_counts(spark, counts_path(f"{folder}/analytics"))
    return _with_hour_text(counts.where(F.col("dim") != "listed"), "dim", "key", "requests")


def stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of two streams that share the messages; the store of the second fails always."""
    folder = _fresh_folder(spark)
    messages = inputs.log_lines(spark, sf_dir).select(
        "value", (F.col("event_id") % 3).cast("int").alias("partition"), F.col("event_id").alias("offset")
    )

    def fails(records: DataFrame, root: str) -> None:
        raise OSError("dial tcp: connection refused")

    found = []
    for number, store in enumerate((write_hourly, fails)):
        topic, counters_root = f"{folder}/topic-{number}", f"{folder}/counters-{number}"
        messages.where(F.col("offset") % 2 == number).write.parquet(topic)
        stream = spark.readStream.schema("value STRING, partition INT, offset BIGINT").option("maxFilesPerTrigger", 3).parquet(topic)
        places = [f"{folder}/{name}-{number}" for name in ("logs", "dead", "checkpoint")]
        query = start_ingest(stream, *places, None, store, f"totals-{uuid.uuid4().hex}", counters_root)
        query.awaitTermination()
        found.append(stream_counters(spark, counters_root))
    return found[0].unionByName(found[1]).groupBy("metric").agg(F.sum("value").alias("value"))


def windowed_stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a stream in two deliveries; the second is late for nearly all windows of the first and corrects them."""
    folder = _fresh_folder(spark)
    view = inputs.log_view(spark, sf_dir).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    for number in range(2):
        view.where(F.col("event_id") % 2 == number).select("timestamp", "path").write.mode("append").parquet(f"{folder}/source")
        stream = spark.readStream.schema("timestamp TIMESTAMP, path STRING").parquet(f"{folder}/source")
        query = start_windowed_counts(stream, f"{folder}/windows", f"{folder}/checkpoint", timedelta(days=36_500), None)
        query.awaitTermination()
    return read_windowed_counts(spark, f"{folder}/windows").select(
        hour_rfc3339(F.col("window_start")).alias("window_start"), hour_rfc3339(F.col("window_end")).alias("window_end"), "path", "requests"
    )


def _listed_counts(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Refresh what lies below ``folder`` and read the counts back."""
    refresh(spark, f"{folder}/logs", f"{folder}/analytics", **options)
    counts = read_counts(spark, counts_path(f"{folder}/analytics"))
    return _with_hour_text(counts.where(F.col("dim") != "listed"), "dim", "key", "requests")


def oddly_named_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards with hidden names and empty shards, below a folder whose name looks like a pattern."""
    folder = _fresh_folder(spark) + "-[1] {x}*"
    name = F.element_at(F.array(*map(F.lit, ("pod", "_pod", ".pod"))), (F.col("event_id") % 3 + 1).cast("int"))
    inputs.write_log_files(inputs.log_view(spark, sf_dir), f"{folder}/logs", F.concat(F.lit("/"), name), empty="/none")
    return _listed_counts(spark, folder)


def flat_refresh_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat files alone, where the same hours have shards too."""
    folder = _fresh_folder(spark)
    shard = F.when(F.col("event_id") % 2 == 0, F.lit("")).otherwise(F.lit("/pod"))
    inputs.write_log_files(inputs.log_view(spark, sf_dir), f"{folder}/logs", shard)
    return _listed_counts(spark, folder, layout="flat", paths_per_scan=100)


def twice_written_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two deliveries with a refresh after each; the second adds to hours that are summarised already."""
    folder = _fresh_folder(spark)
    late = F.col("event_id") % 7 == 3
    for number, delivery in enumerate((~late, late)):
        name = F.lit(f"/pod-{number}")
        inputs.write_log_files(inputs.log_view(spark, sf_dir).where(delivery), f"{folder}/logs", name)
        counts = _listed_counts(spark, folder)
    return counts


def compacted_hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of four shards become hours of one file, and are then counted from the start."""
    folder = _fresh_folder(spark)
    shard = F.concat(F.lit("/pod-"), (F.col("event_id") % 4).cast("string"))
    inputs.write_log_files(inputs.log_view(spark, sf_dir), f"{folder}/logs", shard)
    compact(spark, f"{folder}/logs", before=datetime(2100, 1, 1))
    return _listed_counts(spark, folder)


def current_hour_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hour of a given clock alone is refreshed, out of the logs of all hours."""
    folder = _fresh_folder(spark)
    inputs.write_log_files(inputs.log_view(spark, sf_dir), f"{folder}/logs", F.lit("/pod"))
    refresh_current_hour(spark, f"{folder}/logs", f"{folder}/analytics", now=HOUR)
    counts = read_counts(spark, counts_path(f"{folder}/analytics"))
    return _with_hour_text(counts.where(F.col("dim") != "listed"), "dim", "key", "requests")


def arriving_batch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies that arrive as files in two deliveries, every third one hidden, and what becomes of each."""
    folder = _fresh_folder(spark)
    batches = inputs.raw_batches(spark, sf_dir, "mixed")
    outcomes = []

    def handle(files: DataFrame, number: int) -> None:
        bodies = bodies_of(files, inputs.BODY_LIMIT)
        decoded = ingest.batch_outcomes(bodies, inputs.BODY_LIMIT).select("batch_id", "status", "reason", "records")
        outcomes.append(materialize(decoded))

    for number in range(2):
        inputs.write_bodies(batches.where(F.col("batch_id") % 2 == number), f"{folder}/bodies")
        take_arrivals(spark, f"{folder}/bodies", f"{folder}/state", handle)
    found = outcomes[0].unionByName(outcomes[1])
    return found.select(
        F.regexp_extract("batch_id", r"([0-9]+)\.[a-z]+\z", 1).cast("bigint").alias("batch_id"),
        F.col("status").cast("bigint").alias("status"),
        "reason",
        F.coalesce(F.array_size("records"), F.lit(0)).cast("bigint").alias("n_records"),
    )


def replayed_hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead letters of every record, replayed into a store that fails by turns; those of passing failures are counted."""
    folder = _fresh_folder(spark)
    write_consumer_dead_letters(_consumer_letters(spark, sf_dir), f"{folder}/dead")
    calls = []

    def store(records: DataFrame, staged: str) -> None:
        write_hourly(records, staged)
        calls.append(staged)
        if len(calls) % 2:
            raise OSError("dial tcp: connection refused")

    for _ in range(3):
        try:
            replay_consumer_letters(spark, f"{folder}/dead", f"{folder}/logs", f"{folder}/ledger", store)
        except OSError:
            pass  # stored by the next call
    decoded = lines.decode_lines(read_lines(spark, f"{folder}/logs"))
    counted = lines.count_decoded(decoded, "token").withColumn("hour", keys.hour_of_token(F.col("token")))
    return _with_hour_text(counted, "dim", "key", "requests")


def compressed_hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly logs as gzip files, counted without a refresh."""
    folder = _fresh_folder(spark)
    write_hourly(inputs.log_view(spark, sf_dir), f"{folder}/logs", "gzip")
    decoded = lines.decode_lines(read_lines(spark, f"{folder}/logs"))
    counted = lines.count_decoded(decoded, "token").withColumn("hour", keys.hour_of_token(F.col("token")))
    return _with_hour_text(counted, "dim", "key", "requests")


def pipeline_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five counters: batches published to the hourly logs, then one refresh of them."""
    folder = _fresh_folder(spark)
    totals = publish_batches(
        inputs.raw_batches(spark, sf_dir, "mixed").withColumn("batch_id", F.col("batch_id").cast("string")),
        lambda records: write_hourly(records, f"{folder}/logs"),
        f"{folder}/dead",
        inputs.BODY_LIMIT,
    )
    refresh(spark, f"{folder}/logs", f"{folder}/analytics")
    runs = counters.run_counters(spark.read.json(runs_path(f"{folder}/analytics")))
    return spark.createDataFrame(list(totals.items()), "metric STRING, value BIGINT").unionByName(runs)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        requests_per_path,
        requests_per_user_agent,
        hourly_counts,
        hourly_summary_json,
        aggregate_hour,
        utc_hour_bucket,
        summary_paths,
        tumbling_hour_counts,
        batch_hour_groups,
        ndjson_encode,
        ndjson_decode,
        ndjson_hourly_counts,
        decode_json_batches,
        decode_csv_batches,
        validated_records,
        batch_outcomes,
        rejected_batches,
        ingest_counters,
        normalize_records,
        parse_hour_from_key,
        list_log_objects,
        objects_per_hour,
        latest_object_per_hour,
        merge_shards,
        stale_hours,
        incremental_refresh,
        oversized_hours,
        sanitize_writer_id,
        dlq_consumer_rows,
        dlq_producer_rows,
        dlq_triage,
        stored_hourly_counts,
        streamed_hourly_counts,
        oddly_named_counts,
        flat_refresh_counts,
        twice_written_counts,
        compacted_hourly_counts,
        current_hour_counts,
        arriving_batch_outcomes,
        replayed_hourly_counts,
        stream_totals,
        windowed_stream_counts,
        compressed_hourly_counts,
        pipeline_counters,
    )
}
