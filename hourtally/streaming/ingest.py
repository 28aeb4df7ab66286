"""A topic into the hourly logs, at least once, with dead letters for failed writes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hourtally.operators.dead_letters import consumer_dead_letters
from hourtally.operators.ingest import UNSTORABLE, is_storable, keep_when
from hourtally.plans.ingest import WRITE_ERRORS, short_reason
from hourtally.sinks.dead_letters import write_consumer_dead_letters
from hourtally.sinks.hourly_logs import write_hourly
from hourtally.sources.listing import literal_path
from hourtally.sources.topic import decode_messages

# A minute makes one file per hour and minute; a shorter delay makes more files.
FLUSH_INTERVAL = "1 minute"


# What a micro-batch counts; a message that is neither malformed nor stored is a store error.
MESSAGES = "messages_total"
MALFORMED = "malformed_messages_total"
STORED = "logs_ingested_total"
STORE_ERRORS = "ingest_errors_total"


def _write_totals(spark: SparkSession, root: str, batch_id: int, totals: dict[str, int]) -> None:
    """The totals of a micro-batch in a folder of its own, so that a repetition replaces them."""
    rows = spark.createDataFrame(list(totals.items()), "metric STRING, value BIGINT").coalesce(1)
    rows.write.mode("overwrite").parquet(f"{root.rstrip('/')}/batch={batch_id}")


def stream_counters(spark: SparkSession, root: str) -> DataFrame:
    """``metric, value`` over all finished micro-batches of the stream that writes below ``root``."""
    stored = spark.read.schema("metric STRING, value BIGINT, batch BIGINT").parquet(literal_path(root))
    return stored.groupBy("metric").agg(F.sum("value").alias("value"))


def start_ingest(
    messages: DataFrame,
    logs_root: str,
    dead_letter_root: str,
    checkpoint: str,
    interval: str | None = FLUSH_INTERVAL,
    store: Callable[[DataFrame, str], None] = write_hourly,
    name: str = "ingest",
    counters_root: str | None = None,
) -> StreamingQuery:
    """Store every well-formed message under its hour; drop the malformed ones.

    The source's batch option bounds a micro-batch and ``interval`` its delay;
    ``interval=None`` drains what is there and stops. The checkpoint moves on
    only after a batch is stored, so a crash stores a batch again rather than
    losing it. When the store itself fails, the batch goes to the dead letters
    and the stream goes on, as does a record whose time cannot be stored; any
    other error, of the source or of decoding, stops the query. The progress of
    the query carries the observed counts. With ``counters_root`` the totals of
    each micro-batch, what was stored and what was not among them, are written
    there when it is done (see ``stream_counters``).
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        seen = Observation()
        ok = F.col("line_state") == "ok"
        counted = batch.observe(seen, F.count(F.lit(1)).alias(MESSAGES), F.count_if(~ok).alias(MALFORMED))
        decoded = keep_when(counted, ok, "record", "partition", "offset").persist()
        try:
            # Reads the source and decodes, outside of what counts as a failure of the store.
            storable = is_storable(F.col("record.timestamp"))
            bad = decoded.where(~storable)
            fits, unfit = decoded.agg(F.count_if(storable), F.count_if(~storable)).first()
            failed = False
            if unfit:
                reason = F.lit(UNSTORABLE)
                write_consumer_dead_letters(consumer_dead_letters(bad, reason), dead_letter_root)
            good = decoded.where(storable)
            try:
                store(good.select("record.*"), logs_root)
            except WRITE_ERRORS as error:
                failed = True
                letters = consumer_dead_letters(good, F.lit(short_reason(error)))
                write_consumer_dead_letters(letters, dead_letter_root)
            if counters_root:
                totals = {**seen.get, STORED: 0 if failed else fits, STORE_ERRORS: unfit + (fits if failed else 0)}
                _write_totals(batch.sparkSession, counters_root, batch_id, totals)
        finally:
            decoded.unpersist()

    state = F.col("line_state")
    observed = decode_messages(messages).observe(
        name,
        F.count(F.lit(1)).alias("messages"),
        F.count_if(state == "ok").alias("decoded"),
        F.count_if(state != "ok").alias("malformed"),
    )
    trigger = {"availableNow": True} if interval is None else {"processingTime": interval}
    return (
        observed.writeStream.queryName(name)
        .foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )
