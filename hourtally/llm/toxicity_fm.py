"""Toxicity by a factorization machine over hashed terms.

The score of a text is a bias, a weight per term and the inner products of the
factor vectors of its terms, so that two terms together can say more than the
sum of both. Terms are lower-cased words without punctuation around them, hashed
to 24 bits; a term counts once per text. Every term of several training texts has
parameters, whatever its own labels say: a term can matter beside another one alone.
A penalty keeps terms near zero whose labels are as expected. Where there are
too many terms, the rarest share rows by their hash.

The model is fitted on the driver to a bounded sample of labelled texts; scoring
is one pass over the table without a shuffle.

Defined results: a null or empty text has the score of the bias alone. Of several
labels of a document the largest counts, null labels are not used; of equal
training texts one is used. Without labels of both kinds every score is the share
of toxic labels, 0.5 where there are none. Rows repeated with one ``doc_id`` are
scored each; columns other than ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourtally.llm.common import Memo, Shared, fold, hash64, list_array, map_batches, read_table, utf8_of

MAX_TRAINING_ROWS = 20_000  # labelled texts in expectation, drawn by a hash of their ids
MAX_TERMS = 1 << 17  # rows of parameters
SHARED_ROWS = 1 << 14  # of these, for the rarest terms where there are more
LEAST_TEXTS = 4  # training texts a term needs to get parameters
PENALTY = 50.0  # of half the square of a parameter against the sum of the losses; less the more surprising the labels
FACTORS = 8
EPOCHS = 40
TERM_BITS = 24
THRESHOLD = 0.7
HELD_OUT = 1  # of three folds
_MARKS = b".,;:!?\"'()[]{}|*#$%&<>-_/\\~`^+="


def term_id(word: bytes) -> int:
    """The hashed term of a lower-case word; -1 for punctuation."""
    term = word.strip(_MARKS)
    return hash64(term) >> (64 - TERM_BITS) if term else -1


@dataclass
class Machine:
    """Parameters of the terms ``ids`` (ascending), whose rows are ``places``; at most ``MAX_TERMS`` rows."""

    ids: np.ndarray
    places: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, rows: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Scores before the logistic function; text i has the terms ``rows[ends[i-1]:ends[i]]``."""
        starts = np.concatenate([[0], ends[:-1]])
        picked = np.concatenate([self.factors[rows], self.weights[rows, None]], axis=1)
        squares = np.einsum("ij,ij->i", picked[:, :-1], picked[:, :-1])
        sums = _sums(picked, starts, ends)
        own = _sums(squares[:, None], starts, ends)[:, 0]
        return self.bias + sums[:, -1] + 0.5 * ((sums[:, :-1] ** 2).sum(axis=1) - own)


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Column sums of consecutive rows, zero where there are none."""
    out = np.zeros((len(ends), values.shape[1]))
    full = ends > starts
    if full.any():
        out[full] = np.add.reduceat(values, starts[full], axis=0, dtype=np.float64)
    return out


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def distinct_terms(texts: list[bytes], memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """The distinct terms (memo's numbers, from 0) of every text one after the other, and where each text ends."""
    split = [text.lower().split() for text in texts]
    lengths = np.array([len(words) for words in split], dtype=np.int64)
    terms = np.fromiter((memo[w] for words in split for w in words), dtype=np.int64, count=int(lengths.sum()))
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), lengths)
    known = terms >= 0
    pairs = np.unique((owner[known] << 32) | terms[known])
    return pairs & 0xFFFFFFFF, np.searchsorted(pairs, np.arange(1, len(texts) + 1, dtype=np.int64) << 32)


def training_sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """``label, digest, terms`` of about ``max_rows`` labelled documents outside the held-out fold.

    The sampled ids, bounded by ``max_rows``, are broadcast to pick their texts.
    """
    known = (
        labels.where("toxic is not null and doc_id is not null")
        .where(fold(F.col("doc_id"), 3) != HELD_OUT)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("label"))
    )
    share = min(1.0, max_rows / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)))
    memo = Memo(term_id)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = utf8_of(batch)
        terms, ends = distinct_terms(texts, memo)
        digests = [hashlib.blake2b(t, digest_size=16).digest() for t in texts]
        return pa.RecordBatch.from_arrays(
            [batch.column("label").cast(pa.int32()), pa.array(digests), list_array(terms.astype(np.int32), np.concatenate([[0], ends]))],
            names=["label", "digest", "terms"],
        )

    chosen = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("label", "text")
    return map_batches(chosen, "label int, digest binary, terms array<int>", work)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    max_rows: int = MAX_TRAINING_ROWS,
    factors: int = FACTORS,
    epochs: int = EPOCHS,
    seed: int = 7,
) -> Machine:
    """A machine trained on the labelled documents outside the held-out fold."""
    table = training_sample(docs, labels, max_rows).toArrow().combine_chunks()
    digests = table["digest"].to_pylist()
    order = sorted(range(len(digests)), key=lambda i: digests[i])
    first = np.array([i for j, i in enumerate(order) if j == 0 or digests[i] != digests[order[j - 1]]], dtype=np.int64)
    table = table.take(first)
    y = table["label"].to_numpy().astype(np.float64)
    lists = table["terms"].combine_chunks() if len(table) else pa.array([], pa.list_(pa.int32()))
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return train(np.asarray(lists.flatten()).astype(np.int64), np.asarray(lists.value_lengths()).astype(np.int64), y, factors, epochs, seed)


def train(terms: np.ndarray, lengths: np.ndarray, y: np.ndarray, factors: int, epochs: int, seed: int) -> Machine:
    """Logistic loss, minimised by AdaGrad over seeded batches."""
    random = np.random.default_rng(seed)
    positive = int((y > 0).sum())
    prior = (positive + 0.5) / (len(y) + 1.0)
    ids, texts = np.unique(terms, return_counts=True)
    keep = texts >= LEAST_TEXTS
    ids, texts = ids[keep], texts[keep]
    toxic = np.bincount(np.searchsorted(ids, terms[(own := np.isin(terms, ids))]), np.repeat(y > 0, lengths)[own], len(ids))
    places = _places(ids, texts)
    rows = int(places.max()) + 1 if len(ids) else 0
    machine = Machine(ids, places, float(np.log(prior / (1 - prior))), np.zeros(rows), random.normal(0, 0.02, (rows, factors)))
    texts, toxic = (np.maximum(1e-9, np.bincount(places, each, rows)) for each in (texts, toxic))
    surprise = (toxic - texts * prior) ** 2 / np.maximum(texts * prior * (1 - prior), 1e-9)
    penalty = PENALTY / (1 + (surprise / 4) ** 2) / texts
    if positive in (0, len(y)) or not len(ids):
        machine.factors[:] = 0.0
        return machine
    owner = np.repeat(np.arange(len(y)), lengths)
    row = np.minimum(np.searchsorted(ids, terms), len(ids) - 1)
    known = ids[row] == terms
    owner, row = owner[known], places[row[known]]
    ends = np.searchsorted(owner, np.arange(len(y)), side="right")
    starts = np.concatenate([[0], ends[:-1]])
    weight = np.where(y > 0, (len(y) - positive) / positive, 1.0) ** 0.5
    seen = np.full((rows, factors + 1), 1e-2)
    seen_bias = 1e-2
    for _ in range(epochs):
        order = random.permutation(len(y))
        for at in range(0, len(order), 128):
            batch = order[at : at + 128]
            of_batch = np.concatenate([row[starts[i] : ends[i]] for i in batch])
            counts = ends[batch] - starts[batch]
            last = np.cumsum(counts)
            error = (_logistic(machine.raw(of_batch, last)) - (y[batch] > 0)) * weight[batch] / len(batch)
            sums = _sums(machine.factors[of_batch], last - counts, last)
            each = np.repeat(np.arange(len(batch)), counts)
            order_of = np.argsort(of_batch, kind="stable")
            first = np.flatnonzero(np.diff(of_batch[order_of], prepend=-1))
            used = of_batch[order_of[first]]
            parts = np.column_stack([error[:, None] * sums, error])
            gradient = np.add.reduceat(parts[each[order_of]], first, axis=0)
            gradient[:, :-1] -= gradient[:, -1:] * machine.factors[used]
            shrink = penalty[used] * np.diff(first, append=len(of_batch)) / len(batch)
            gradient[:, :-1] += shrink[:, None] * machine.factors[used]
            gradient[:, -1] += shrink * machine.weights[used]
            seen[used] += gradient**2
            step = 0.3 * gradient / np.sqrt(seen[used])
            machine.weights[used] -= step[:, -1]
            machine.factors[used] -= 0.3 * step[:, :-1]
            seen_bias += error.sum() ** 2
            machine.bias -= 0.3 * error.sum() / seen_bias**0.5
    return machine


def _places(ids: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """The row of every term: its own, or one by its hash for the rarest of too many."""
    if len(ids) <= MAX_TERMS:
        return np.arange(len(ids))
    own = MAX_TERMS - SHARED_ROWS
    places = own + ids % SHARED_ROWS
    places[np.argsort(-texts, kind="stable")[:own]] = np.arange(own)
    return places


def _scorer(spark: SparkSession, machine: Machine):
    shared = Shared(spark, machine)
    state = {}

    def score(texts: list[bytes]) -> np.ndarray:
        if not state:
            known = set(shared.value.ids.tolist())
            state["memo"] = Memo(lambda word: term if (term := term_id(word)) in known else -1)
        terms, ends = distinct_terms(texts, state["memo"])
        return _logistic(shared.value.raw(shared.value.places[np.searchsorted(shared.value.ids, terms)], ends))

    return score


def toxicity_scores(docs: DataFrame, machine: Machine) -> DataFrame:
    """``doc_id, score`` for every row; score is between 0 and 1."""
    score = _scorer(docs.sparkSession, machine)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array(score(utf8_of(batch)))], names=["doc_id", "score"]
        )

    return map_batches(docs.select("doc_id", "text"), "doc_id long, score double", work)


def drop_toxic(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below the threshold."""
    score = _scorer(docs.sparkSession, machine)
    return map_batches(docs, docs.schema, lambda batch: batch.filter(pa.array(score(utf8_of(batch)) < threshold)))


def op1_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = toxicity_scores(docs, fit(docs, read_table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id"), 3) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
