"""Log objects as readers should see them: compacted files in place of what they replace.

``<logs>/_compacted/data/run=<run>`` holds the files of a compaction,
``manifest/run=<run>`` what they replace, and ``commits/run=<run>`` is written last.
A run without a commit does not exist for readers. Objects that a committed run
replaced are passed over from then on, whether they have been deleted or not;
the compacted files carry the newest time of the objects of their hour, so that
no summary looks older than before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourtally.functions.keys import hour_from_key
from hourtally.session import materialize
from hourtally.sources.listing import list_objects, literal_path, path_exists

FOLDER = "_compacted"
MANIFEST = "hour TIMESTAMP, key STRING, modified TIMESTAMP, bytes BIGINT"


def compacted_path(logs_root: str, table: str) -> str:
    return f"{logs_root.rstrip('/')}/{FOLDER}/{table}"


def replaced_objects(spark: SparkSession, logs_root: str) -> DataFrame:
    """``hour, key, modified, bytes, run`` of the objects that committed runs replaced."""
    commits = compacted_path(logs_root, "commits")
    if not path_exists(spark, commits):
        return spark.createDataFrame([], f"{MANIFEST}, run STRING")
    done = spark.read.schema("hours BIGINT, run STRING").parquet(literal_path(commits)).select("run").distinct()
    return spark.read.schema(f"{MANIFEST}, run STRING").parquet(literal_path(compacted_path(logs_root, "manifest"))).join(done, "run")


def visible_objects(spark: SparkSession, logs_root: str, dates: list[str] | None = None, folder: str | None = None) -> DataFrame:
    """``key, modified, bytes`` of every object that counts, as ``list_objects`` lists them."""
    listed = list_objects(spark, logs_root, None if dates is None else [*dates, FOLDER], folder)
    inside = F.contains(F.col("key"), F.lit(f"/{FOLDER}/"))
    if not path_exists(spark, compacted_path(logs_root, "commits")):
        return listed.where(~inside)
    replaced = materialize(replaced_objects(spark, logs_root), folder)
    newest = replaced.groupBy("run", "hour").agg(F.max("modified").alias("newest"))
    run = F.regexp_extract("key", f"/{FOLDER}/data/run=([^/]+)/", 1)
    compacted = (
        listed.where(inside & (run != ""))
        .select("key", "bytes", run.alias("run"), hour_from_key(F.col("key")).alias("hour"))
        .join(newest, ["run", "hour"])
        .select("key", F.col("newest").alias("modified"), "bytes")
    )
    if dates is not None:
        compacted = compacted.where(F.regexp_extract("key", "/date=([^/]+)/", 1).isin(dates))
    both = listed.where(~inside).unionByName(compacted)
    return both.join(replaced.select("key", "modified", "bytes"), ["key", "modified", "bytes"], "left_anti")
