"""Listings of stored objects: key, modification time and size, never the content."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourtally.functions.keys import LOG_SUFFIX, hour_from_flat_path
from hourtally.sources.files import list_files

LISTING = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("modified", T.TimestampType()),
        T.StructField("bytes", T.LongType()),
    ]
)


def _on_file_system(spark: SparkSession, path: str):
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path, file_system = _on_file_system(spark, path)
    return file_system.exists(hadoop_path)


def child_folders(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders directly below ``path``, which are few."""
    hadoop_path, file_system = _on_file_system(spark, path)
    if not file_system.exists(hadoop_path):
        return []
    return sorted(s.getPath().getName() for s in file_system.listStatus(hadoop_path) if s.isDirectory())


def delete_folder(spark: SparkSession, path: str) -> None:
    hadoop_path, file_system = _on_file_system(spark, path)
    file_system.delete(hadoop_path, True)


def literal_path(path: str) -> str:
    """A path as Spark's readers take it, which read most marks as patterns."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def qualified_path(spark: SparkSession, path: str) -> str:
    """The path the way listings spell it, with its scheme."""
    hadoop_path, file_system = _on_file_system(spark, path)
    return file_system.makeQualified(hadoop_path).toString()


def list_objects(spark: SparkSession, root: str, dates: list[str] | None = None, folder: str | None = None) -> DataFrame:
    """``key, modified, bytes`` of every file below ``root``, hidden and empty ones included.

    ``dates`` limits the walk to the folders of those days. A missing root is an
    empty listing. File contents are not read. The listing is a table in ``folder``,
    by default in the checkpoint folder. Where Arrow cannot open the file
    system, Spark lists it and leaves hidden and empty files out.
    """
    days = None if dates is None else {prefix + day for day in dates for prefix in ("", "date=")}
    try:
        return list_files(spark, qualified_path(spark, root), days, folder=folder)
    except ValueError:
        return _listed_by_spark(spark, root, days)


def _listed_by_spark(spark: SparkSession, root: str, days: set[str] | None) -> DataFrame:
    if not path_exists(spark, root):
        return spark.createDataFrame([], LISTING)
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(literal_path(root))
        .select(
            F.col("path").alias("key"),
            F.col("modificationTime").alias("modified"),
            F.col("length").alias("bytes"),
        )
    )
    if days is None:
        return listed
    below = F.substring("key", len(qualified_path(spark, root).rstrip("/")) + 2, 2**30)
    return listed.where(F.substring_index(below, "/", 1).isin(sorted(days)))


def list_log_objects(spark: SparkSession, root: str, dates: list[str] | None = None) -> DataFrame:
    """The ``.log.json`` files of a listing, sorted by key."""
    return list_objects(spark, root, dates).where(F.endswith("key", F.lit(LOG_SUFFIX))).orderBy("key")


def flat_objects(listing: DataFrame, root: str) -> DataFrame:
    """Log files that lie exactly at ``<root>/<date>/<HH>.log.json``, with their hour."""
    return listing.withColumn("hour", hour_from_flat_path(F.col("key"), root)).where(
        F.col("hour").isNotNull()
    )
