"""Word shingles of documents as sets of 64-bit hashes, and their minhash signatures."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hourtally.llm.common import Memo, hash64, list_array, map_batches, utf8_of

_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _MIX[1]
    x ^= x >> np.uint64(29)
    x *= _MIX[2]
    x ^= x >> np.uint64(32)
    return x


def shingle_sets(texts: list[bytes], length: int, memo: Memo) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text.

    A-Z is lower-cased. A text with fewer than ``length`` words is one shingle,
    a text without words has none.
    """
    split = [text.lower().split() for text in texts]
    ends = np.cumsum([len(w) for w in split])
    hashes = np.fromiter((memo[w] for ws in split for w in ws), dtype=np.uint64, count=int(ends[-1]) if len(ends) else 0)
    if len(hashes) >= length:
        n = len(hashes) - length + 1
        rolled = hashes[:n].copy()
        for i in range(1, length):
            rolled = _mixed(rolled) + hashes[i : n + i]
        rolled = _mixed(rolled)
    else:
        rolled = hashes[:0]
    sets, start = [], 0
    for end in ends.tolist():
        if end - start >= length:
            sets.append(np.unique(rolled[start : end - length + 1]))
        elif end > start:
            whole = np.uint64([end - start])
            for h in hashes[start:end]:
                whole = _mixed(whole) + h
            sets.append(_mixed(whole))
        else:
            sets.append(hashes[:0])
        start = end
    return sets


def signatures_of(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """A row of 32-bit minima for every set that is not empty."""
    full = [s for s in sets if len(s)]
    found = np.empty((len(full), coordinates), dtype=np.int32)
    if full:
        every = np.concatenate(full)
        starts = np.cumsum([0, *(len(s) for s in full[:-1])])
        for j in range(coordinates):
            seed = _mixed(np.uint64([j + 1]) * _MIX[0])
            values = (_mixed(every ^ seed) >> np.uint64(32)).astype(np.uint32)
            found[:, j] = np.minimum.reduceat(values, starts).view(np.int32)
    return found


def set_signatures(docs: DataFrame, length: int, coordinates: int) -> DataFrame:
    """``doc_id, n_shingles, digest, signature``; digest and signature of empty sets are null.

    The digest names the set, so documents with equal sets share it.
    """
    memo = Memo(hash64)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(utf8_of(batch), length, memo)
        digests = [_digest(s) if len(s) else None for s in sets]
        rows = iter(signatures_of(sets, coordinates).tolist())
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").cast(pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array([next(rows) if d else None for d in digests], pa.list_(pa.int32())),
            ],
            names=["doc_id", "n_shingles", "digest", "signature"],
        )

    schema = "doc_id long, n_shingles long, digest binary, signature array<int>"
    return map_batches(docs.select("doc_id", "text"), schema, work)


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def full_sets(docs: DataFrame, length: int) -> DataFrame:
    """``digest, shingles``: the whole set of every document, named as by ``set_signatures``."""
    memo = Memo(hash64)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(utf8_of(batch), length, memo)
        offsets = np.cumsum([0, *(len(s) for s in sets)])
        values = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(map(_digest, sets), pa.binary()), list_array(values, offsets)], names=["digest", "shingles"]
        )

    return map_batches(docs.select("doc_id", "text"), "digest binary, shingles array<long>", work)
