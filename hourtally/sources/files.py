"""Files as they are stored, hidden and empty ones included.

Spark's readers pass over files and folders whose names begin with ``_`` or ``.``
and over empty files, and have no option for it. Listings therefore ask the file
system, in tasks: folders are rows, a task walks those it got until it has seen
``ENTRIES`` entries and hands the folders it has not reached to the next round,
which deals them over all cores. A small tree takes one round and a large one
few. One folder is listed by one task, as file systems list folders. File
systems that Arrow cannot open are listed by Spark, which sees neither kind.
"""

from __future__ import annotations

import io
import re
from collections import deque
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourtally.session import materialize

LISTING_SCHEMA = "key STRING, modified TIMESTAMP, bytes BIGINT"
ENTRIES = 20_000  # files and folders that a task lists before it hands folders on
RANGE_BYTES = 64 << 20
_LISTED_AT_ONCE = 10_000
# What writers leave beside their files: checksums, and folders of unfinished jobs.
_LEFTOVERS = re.compile(r"(?:\A|/)(?:\.[^/]*\.crc\Z|_temporary/|_spark_metadata/|\.spark-staging[^/]*/)")

# Names that Spark's readers pass over; ``_k=1`` is a partition and is read.
_PASSED_OVER = r"(?:\.[^/]*|_[^/=]*|[^/]*\._COPYING_)"


def is_hidden(key: Column) -> Column:
    """Whether Spark's readers would pass over a file for its name."""
    return F.substring_index(key, "/", -1).rlike(rf"\A{_PASSED_OVER}\z")


def is_hidden_below(key: Column, root: str) -> Column:
    """Whether a recursive read of ``root``, a qualified path, would pass over a file for its name or a folder's."""
    below = F.substring(key, len(root.rstrip("/")) + 1, 2**30)
    return is_hidden(key) | below.rlike(rf"/(?!_metadata|_common_metadata){_PASSED_OVER}/")


def open_file_system(uri: str):
    """An Arrow file system and the path in it; ``ValueError`` where Arrow has none for the scheme."""
    from pyarrow import fs

    if uri.startswith(("/", "file:")):
        return fs.LocalFileSystem(), re.sub(r"\Afile:(//)?", "", uri)
    try:
        return fs.FileSystem.from_uri(re.sub(r"\As3[an]://", "s3://", uri))
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError) as problem:
        raise ValueError(f"no file system for {uri}") from problem


def _rows(root: str, base: str, infos: Iterable, folders: Iterable[str] = ()) -> pa.RecordBatch:
    """Files as rows, whose keys are spelled like ``root``, and folders that are still to be listed."""
    from pyarrow import fs

    files = [i for i in infos if i.type == fs.FileType.File and not _LEFTOVERS.search(i.path[len(base) :])]
    folders = list(folders)
    none = [None] * len(folders)
    keys = [root.rstrip("/") + i.path[len(base.rstrip("/")) :] for i in files]
    times = [(i.mtime_ns or 0) // 1000 for i in files]
    columns = {
        "key": pa.array(keys + none, pa.string()),
        "modified": pa.array(times + none, pa.int64()).cast(pa.timestamp("us", "UTC")),
        "bytes": pa.array([i.size for i in files] + none, pa.int64()),
        "folder": pa.array([None] * len(files) + folders, pa.string()),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def list_files(spark: SparkSession, root: str, folders: set[str] | None = None, entries: int = ENTRIES, folder: str | None = None) -> DataFrame:
    """``key, modified, bytes`` of every file below ``root``; ``folders`` limits it to these children.

    ``root`` is a qualified path. Raises ``ValueError`` where Arrow cannot open it.
    The driver learns how many folders a round has left, and no name.
    """
    from pyarrow import fs

    _, base = open_file_system(root)
    base = base.rstrip("/") or "/"

    def walk(batches):
        file_system, _ = open_file_system(root)
        waiting = deque(path for batch in batches for path in batch.column("folder").to_pylist())
        seen = 0
        while waiting and seen < entries:
            path = waiting.popleft()
            infos = file_system.get_file_info(fs.FileSelector(path, allow_not_found=True))
            if folders is not None and path == base:
                infos = [i for i in infos if i.base_name in folders]
            seen += 1 + len(infos)
            waiting.extend(i.path for i in infos if i.type == fs.FileType.Directory and not _LEFTOVERS.search(i.path[len(base) :] + "/"))
            for start in range(0, len(infos), _LISTED_AT_ONCE):
                yield _rows(root, base, infos[start : start + _LISTED_AT_ONCE])
        yield _rows(root, base, (), waiting)

    found, left = [], spark.createDataFrame([(base,)], "folder STRING").coalesce(1)
    while True:
        listed = materialize(left.mapInArrow(walk, f"{LISTING_SCHEMA}, folder STRING"), folder)
        found.append(listed.where("key is not null").drop("folder"))
        left = listed.where("folder is not null").select("folder")
        many = left.count()
        if not many:
            return reduce(DataFrame.unionByName, found)
        left = left.repartition(min(many, 4 * spark.sparkContext.defaultParallelism))


def _chunks(lines: Iterable[str], size: int = 4096) -> Iterator[list[str]]:
    chunk: list[str] = []
    for line in lines:
        chunk.append(line)
        if len(chunk) >= size:
            yield chunk
            chunk = []
    if chunk:
        yield chunk


def read_hidden_lines(listed: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``value, path``: the lines of listed files ``key, bytes`` that Spark's readers pass over.

    A file is read in ranges, each by a task that may be any. A line belongs to
    the range that its first byte lies in and is read to its end.
    """

    def read(batches):
        for batch in batches:
            for key, start in zip(batch.column("key").to_pylist(), batch.column("start").to_pylist()):
                file_system, path = open_file_system(key)
                with io.BufferedReader(file_system.open_input_file(path), 1 << 20) as stream:
                    for chunk in _chunks(_lines_of_range(stream, start, start + range_bytes)):
                        yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.string()), pa.array([key] * len(chunk), pa.string())], names=["value", "path"])

    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long")))
    ranges = listed.where("bytes > 0").select("key", starts.alias("start"))
    # A number of its own, as the rows are too small for Spark to see the work in them.
    tasks = 4 * listed.sparkSession.sparkContext.defaultParallelism
    return ranges.repartition(tasks, "key", "start").mapInArrow(read, "value STRING, path STRING")


def _lines_of_range(stream, start: int, end: int) -> Iterator[str]:
    if start:
        stream.seek(start - 1)
        stream.readline()  # the rest of a line that began before
    at = stream.tell()
    while at < end:
        raw = stream.readline()
        if not raw:
            return
        at += len(raw)
        yield raw.removesuffix(b"\n").decode("utf-8", "replace")


def read_hidden_texts(listed: DataFrame) -> DataFrame:
    """``key, body`` of listed files that Spark's readers pass over, each read whole in a task."""

    def read(batches):
        for batch in batches:
            keys = batch.column("key").to_pylist()
            for key in keys:
                file_system, path = open_file_system(key)
                with file_system.open_input_stream(path) as stream:
                    body = stream.read().decode("utf-8", "replace")
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([body], pa.string())], names=["key", "body"])

    return listed.select("key").mapInArrow(read, "key STRING, body STRING")
