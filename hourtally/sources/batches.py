"""Request bodies kept as files, one body per file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourtally.operators.ingest import MAX_BODY_BYTES
from hourtally.sources.files import is_hidden_below, read_hidden_texts
from hourtally.sources.listing import list_objects, literal_path, path_exists, qualified_path

# Media types by file suffix; another suffix has no known type.
MEDIA_TYPES = {".json": "application/json", ".csv": "text/csv"}


def media_type(file_path: Column) -> Column:
    kind = F.lit("application/octet-stream")
    for suffix, media in MEDIA_TYPES.items():
        kind = F.when(F.endswith(F.lower(file_path), F.lit(suffix)), F.lit(media)).otherwise(kind)
    return kind


def _unread(files: DataFrame, body) -> DataFrame:
    """Outcomes need these bodies' sizes, and no more of them than ``body``."""
    kind = media_type(F.col("batch_id"))
    return files.select("batch_id", kind.alias("content_type"), body.cast("string").alias("body"), "body_bytes")


def _bodies(reader, folder: str, max_body_bytes: int) -> DataFrame:
    path, size = F.col("_metadata.file_path"), F.col("_metadata.file_size")
    files = reader.option("recursiveFileLookup", "true").text(literal_path(folder), wholetext=True)
    return files.where(size <= max_body_bytes).select(
        path.alias("batch_id"), media_type(path).alias("content_type"), F.col("value").alias("body"), size.alias("body_bytes")
    )


def read_body_files(spark: SparkSession, folder: str, max_body_bytes: int = MAX_BODY_BYTES) -> DataFrame:
    """``batch_id, content_type, body, body_bytes`` of every file below ``folder``.

    A file above the limit is never read: it is known by its size alone and
    has a NULL body. Its size still makes it a too large batch. Empty files have
    an empty body, and hidden ones, or those in hidden folders, are read by the tasks that list them.
    """
    listed = list_objects(spark, folder).withColumnsRenamed({"key": "batch_id", "bytes": "body_bytes"})
    size, hidden = F.col("body_bytes"), is_hidden_below(F.col("batch_id"), qualified_path(spark, folder))
    empty = _unread(listed.where(size == 0), F.lit(""))
    large = _unread(listed.where(size > max_body_bytes), F.lit(None))
    unseen = listed.where(hidden & (size > 0) & (size <= max_body_bytes))
    texts = read_hidden_texts(unseen.select(F.col("batch_id").alias("key")))
    known = texts.select(F.col("key").alias("batch_id"), "body", F.octet_length("body").cast("long").alias("body_bytes"))
    parts = [empty, large, _unread(known, F.col("body"))]
    if path_exists(spark, folder):
        parts.append(_bodies(spark.read, folder, max_body_bytes))
    return reduce(DataFrame.unionByName, parts)


def bodies_of(files: DataFrame, max_body_bytes: int = MAX_BODY_BYTES) -> DataFrame:
    """``batch_id, content_type, body, body_bytes`` of listed files ``key, bytes``, each read in a task.

    As ``read_body_files``, for the files of a listing: too large ones are not read.
    """
    size = F.col("bytes")
    unread = files.where((size == 0) | (size > max_body_bytes)).select(F.col("key").alias("batch_id"), size.alias("body_bytes"))
    empty = F.when(F.col("body_bytes") == 0, F.lit(""))
    tasks = 4 * files.sparkSession.sparkContext.defaultParallelism
    texts = read_hidden_texts(files.where((size > 0) & (size <= max_body_bytes)).select("key").repartition(tasks, "key"))
    known = texts.select(F.col("key").alias("batch_id"), "body", F.octet_length("body").cast("long").alias("body_bytes"))
    return _unread(unread, empty).unionByName(_unread(known, F.col("body")))


def stream_body_files(
    spark: SparkSession, folder: str, files_per_batch: int = 1000, max_body_bytes: int = MAX_BODY_BYTES
) -> DataFrame:
    """The same as a stream of arriving files, too large ones included.

    Spark's streams of files show neither empty nor hidden ones;
    ``hourtally.streaming.arrivals`` takes those as well.
    """
    bodies = _bodies(spark.readStream.option("maxFilesPerTrigger", files_per_batch), folder, max_body_bytes)
    listed = (
        spark.readStream.format("binaryFile")
        .schema("path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY")
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(literal_path(folder))
        .select(F.col("path").alias("batch_id"), F.col("length").alias("body_bytes"))
    )
    return bodies.unionByName(_unread(listed.where(F.col("body_bytes") > max_body_bytes), F.lit(None)))
