"""Line-by-line scans of hourly log files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourtally.functions.keys import LOG_SUFFIX, token_of_file_path


def object_of(path: Column) -> Column:
    """One spelling for a log object: that of listings, from a listed key or from a scanned file's path.

    Scans spell paths as escaped URIs; meant for the groups of a scan, not for its lines.
    """
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return plain_key(decoded)


def plain_key(key: Column) -> Column:
    """A listed key with its scheme spelled in one way."""
    return F.regexp_replace(key, r"\Afile:/+", "file:/")


def _is_log() -> Column:
    return F.endswith("_metadata.file_name", F.lit(LOG_SUFFIX)) | F.contains(F.col("_metadata.file_path"), F.lit("/hour="))


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Every line of log files below the paths; lines end at a newline only.

    Files that vanish between listing and reading are passed over; other read
    errors fail the job.
    """
    return (
        spark.read.option("lineSep", "\n")
        .option("recursiveFileLookup", "true")
        .option("ignoreMissingFiles", "true")
        .text(paths)
        .where(_is_log())
    )


def read_object_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``value, path``: every line below the paths and its file, as an escaped URI."""
    return _lines(spark, paths).select("value", F.col("_metadata.file_path").alias("path"))


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``value, token``: every line below the paths and its ``<date>/<hour>`` text.

    The token comes from the file's path, whichever layout it follows, and is
    checked only after grouping, when a handful are left.
    """
    return _lines(spark, paths).select("value", token_of_file_path(F.col("_metadata.file_path")).alias("token"))
