"""Language identification by nearest centroids.

A text is the TF-IDF vector, of length 1, of the byte trigrams of its lower-cased
letters, hashed into ``DIMENSIONS``. Every language has a few centroids, found by
spherical k-means, and a text has the language of the centroid with the largest
cosine. Below the cosine that nearly all training texts of that language reach,
the text is marked as rejected: nearest to this language, but far from it.

Document frequencies are counted over all training texts, centroids fitted on the
driver to a bounded sample; prediction is one pass over the table without a shuffle.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as
is every text where nothing could be learned. Equal cosines go to the language
that comes first by name. Documents without a language are not learned from.
Rows repeated with one ``doc_id`` are predicted each; columns other than
``doc_id``, ``text`` and, for learning, ``lang`` are not looked at.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourtally.llm.common import Shared, fold, list_array, map_batches, read_table, text_slices

MAX_TRAINING_ROWS = 6_000  # in expectation and over all languages, drawn by a hash of their ids
CENTROIDS = 4
ROUNDS = 12
DIMENSIONS = 1 << 13
REJECTED_SHARE = 0.01
PER_ROW = 1_000  # so that at most some 500 rows of counts are held at once
UNKNOWN = "und"
HELD_OUT = 2  # of four folds
_LETTER = re.compile(r"[^\W\d_]")
# Bytes that stand for themselves: a-z and all of multi-byte letters. Others separate words.
_KEEP = np.full(256, 32, dtype=np.uint32)
_KEEP[97:123] = range(97, 123)
_KEEP[128:] = range(128, 256)


def gram_counts(texts: list[str]) -> np.ndarray:
    """A row of trigram counts for every text."""
    joined = [(" " + text.lower() + " ").encode("utf-8", "replace") for text in texts]
    data = _KEEP[np.frombuffer(b"".join(joined), np.uint8)]
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), [len(t) for t in joined])
    code = data[:-2] * np.uint32(0x10001) + data[1:-1] * np.uint32(0x101) + data[2:]
    code = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - DIMENSIONS.bit_length() + 1)
    inside = (owner[:-2] == owner[2:]) & ~((data[:-2] == 32) & (data[1:-1] == 32))
    places = owner[:-2][inside] * DIMENSIONS + code[inside]
    return np.bincount(places, minlength=len(texts) * DIMENSIONS).reshape(len(texts), DIMENSIONS)


@dataclass
class Centroids:
    """``languages[of[i]]`` is the language of ``centroids[i]``."""

    idf: np.ndarray
    centroids: np.ndarray
    of: np.ndarray
    languages: list[str]
    least: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and whether the text is rejected."""
        letters = np.array([bool(_LETTER.search(text)) for text in texts], dtype=bool)
        if not len(self.of) or not len(texts):
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        cosine = weighted(gram_counts(texts), self.idf) @ self.centroids.T
        nearest = cosine.argmax(axis=1)
        best = np.clip(cosine[np.arange(len(texts)), nearest].astype(np.float64), 0.0, 1.0)
        names = [self.languages[self.of[i]] if ok else UNKNOWN for i, ok in zip(nearest, letters)]
        return names, np.where(letters, best, 0.0), ~letters | (best < self.least[self.of[nearest]])


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    vectors = np.log1p(counts.astype(np.float32)) * idf
    return vectors / np.maximum(np.sqrt(np.einsum("ij,ij->i", vectors, vectors)), 1e-12)[:, None]


def spherical_kmeans(vectors: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """At most ``k`` centroids of length 1; the first is the mean, each further one starts at the farthest text."""
    start = [vectors.mean(axis=0)]
    while len(start) < min(k, len(vectors)):
        unit = np.array([c / max(np.linalg.norm(c), 1e-12) for c in start])
        start.append(vectors[(vectors @ unit.T).max(axis=1).argmin()])
    centroids = np.array([c / max(np.linalg.norm(c), 1e-12) for c in start])
    for _ in range(rounds):
        nearest = (vectors @ centroids.T).argmax(axis=1)
        sums = np.array([vectors[nearest == i].sum(axis=0) for i in range(len(centroids))])
        length = np.linalg.norm(sums, axis=1)
        centroids = np.where(length[:, None] > 0, sums / np.maximum(length, 1e-12)[:, None], centroids)
    return centroids.astype(np.float32)


def fit(docs: DataFrame, max_rows: int = MAX_TRAINING_ROWS, k: int = CENTROIDS) -> Centroids:
    """Centroids of the languages of documents outside the held-out fold."""
    known = docs.select("doc_id", "lang", "text").where("lang is not null and text is not null and doc_id is not null")
    known = known.where(fold(F.col("doc_id"), 4) != HELD_OUT)
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return Centroids(np.ones(DIMENSIONS, np.float32), np.empty((0, DIMENSIONS), np.float32), np.empty(0, int), [], np.empty(0))
    each = max_rows / len(sizes)
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30))
    limits = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1.0, each / n) * (1 << 30)))])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        counts = gram_counts(texts) if texts else np.empty((0, DIMENSIONS))
        rows, grams = np.nonzero(counts)
        ends = np.searchsorted(rows, np.arange(1, len(texts) + 1))
        offsets = np.concatenate([[0], ends])
        columns = [list_array(grams.astype(np.int32), offsets), list_array(counts[rows, grams].astype(np.int32), offsets)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), *columns], names=["doc_id", "lang", "grams", "counts"])

    sample = known.where((drawn < limits[F.col("lang")]) & F.col("text").rlike(r"\p{L}"))
    schema = "doc_id long, lang string, grams array<int>, counts array<int>"
    picked = sample.select(F.col("doc_id").cast("long"), "lang", "text")
    table = map_batches(picked, schema, work, most=500_000, per_row=PER_ROW).toArrow().sort_by([("lang", "ascending"), ("doc_id", "ascending")])
    return centroids_of(table, inverse_frequencies(known, sum(sizes.values())), k)


def inverse_frequencies(docs: DataFrame, many: int) -> np.ndarray:
    """The weight of every trigram by the share of all training texts that hold it."""

    def run(batches):
        held = np.zeros(DIMENSIONS, dtype=np.int64)
        for batch in batches:
            for piece in text_slices(batch, most=500_000, per_row=PER_ROW):
                held += (gram_counts([x or "" for x in piece.column("text").to_pylist()]) > 0).sum(axis=0)
        found = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(held[found])], names=["gram", "n"])

    counts = docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    texts_with = np.zeros(DIMENSIONS)
    for row in counts.collect():
        texts_with[row["gram"]] = row["n"]
    return (np.log((1 + many) / (1 + texts_with)) + 1.0).astype(np.float32)


def centroids_of(table: pa.Table, idf: np.ndarray, k: int) -> Centroids:
    """Centroids of a table ``lang, grams, counts``, one language after the other."""
    names = table["lang"].to_pylist()
    languages = sorted(set(names))
    found, of, least = [], [], []
    for i, language in enumerate(languages):
        part = table.slice(names.index(language), names.count(language))
        counts = np.zeros((len(part), DIMENSIONS), dtype=np.float32)
        for row, (grams, n) in enumerate(zip(part["grams"], part["counts"])):
            counts[row, np.asarray(grams.values)] = np.asarray(n.values)
        vectors = weighted(counts, idf)
        own = spherical_kmeans(vectors, k, ROUNDS)
        found.append(own)
        of += [i] * len(own)
        least.append(np.quantile((vectors @ own.T).max(axis=1), REJECTED_SHARE))
    centroids = np.concatenate(found) if found else np.empty((0, DIMENSIONS), np.float32)
    return Centroids(idf, centroids, np.array(of, dtype=int), languages, np.array(least))


def languages_of(docs: DataFrame, model: Centroids) -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` for every row of ``doc_id, text``."""
    shared = Shared(docs.sparkSession, model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, score, rejected = shared.value.predict([x or "" for x in batch.column("text").to_pylist()])
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)],
            names=["doc_id", "lang_pred", "score", "rejected"],
        )

    schema = "doc_id long, lang_pred string, score double, rejected boolean"
    return map_batches(docs.select("doc_id", "text"), schema, work, most=500_000, per_row=PER_ROW)


def op4_language_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return languages_of(docs, fit(docs)).select(
        "doc_id", (fold(F.col("doc_id"), 4) == HELD_OUT).alias("held_out"), "lang_pred", "score", "rejected"
    )
