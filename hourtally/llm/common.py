"""What several of the text operators share: tables, folds, word hashes and array columns."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a run of anything but these white-space characters. On UTF-8 bytes
# ``split()`` cuts at exactly these, and ``lower()`` changes exactly A-Z.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
KEPT_BYTES = 64  # longest word that caches keep


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """The fold of a document: crc32 of its id written as text. Null ids have none."""
    return F.crc32(doc_id.cast("string")) % folds


class Shared:
    """A broadcast value. It travels as bytes that carry its classes along, so executors need no copy of this package.

    ``value`` is unpacked once per Python worker and is one object in all its tasks.
    """

    def __init__(self, spark: SparkSession, value):
        self.packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        if not hasattr(self.packed, "unpacked"):
            self.packed.unpacked = pickle.loads(self.packed.value)
        return self.packed.unpacked


class Memo(dict):
    """A bounded cache of ``make(key)``: two generations of ``limit`` entries each.

    A key that is used again moves to the young generation, so frequent keys
    survive. Words of more than ``KEPT_BYTES`` bytes, as texts without spaces
    have, are not kept, so the cache is bounded in bytes as well. The bounds
    change speed and never a result.
    """

    def __init__(self, make=None, limit: int = 200_000):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if type(key) is not bytes or len(key) <= KEPT_BYTES:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value


def hash64(word: bytes) -> int:
    """A 64-bit hash of a word that is the same in every process."""
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges whose sizes add up to ``most``, or hold one item."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def text_slices(
    batch: pa.RecordBatch, column: str = "text", most: int = 2_000_000, per_row: int = 0
) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in pieces of about ``most`` bytes of text, so that memory stays bounded.

    Every row counts ``per_row`` bytes more, for work that needs memory even for empty texts.
    """
    sizes = [(n or 0) + per_row for n in pa.compute.binary_length(batch.column(column)).to_pylist()]
    for start, stop in slices(sizes, most):
        yield batch.slice(start, stop - start)


def utf8_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 texts of a batch; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def map_batches(rows: DataFrame, schema: str, work, most: int = 2_000_000, per_row: int = 0) -> DataFrame:
    """``work(batch) -> record batch`` over pieces of the rows of about ``most`` bytes of ``text``.

    A batch is let go before the next one is read, and its memory goes back to the
    system: a Python worker lives on between tasks, beside those of later stages.
    """

    def run(batches):
        for batch in batches:
            yield from map(work, text_slices(batch, most=most, per_row=per_row))
            del batch
            pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, schema)


def list_array(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
