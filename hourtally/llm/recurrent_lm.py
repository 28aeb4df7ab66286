"""Document log-likelihoods of a gated recurrent language model.

All training documents are counted: the counts give the base score, the model's
vocabulary (the most frequent words, an end and an unknown token) and what an
unknown word costs. The network is trained by truncated backpropagation on all
training documents, at every size of the table: shards are trained in parallel from
common parameters, whose average, weighted by tokens, starts the next round. Every
document is then read whole, with its state carried from window to window.

A word outside the vocabulary has the probability of the unknown token times its
own add-half share among all words outside, so probabilities of all words, one
never seen included, add up to 1. The counts of the most frequent words are
broadcast, a bounded number; those of other words are joined.

Defined results: a null or empty text is its end token. Null ids are in no fold
and not learned from. Where nothing can be learned from, every token has the base
probability. Rows repeated with one ``doc_id`` are scored each; columns other
than ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from itertools import repeat
from math import isqrt, log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourtally.llm import gru
from hourtally.llm.common import Shared, fold, map_batches, read_table, utf8_of
from hourtally.session import materialize

FOLDS, HELD_OUT = 5, 1
VOCABULARY = 4096
END, UNKNOWN = 0, 1
MAX_BROADCAST_WORDS = 1 << 18  # counts kept beside the vocabulary, some 10 MB
SHARD_TOKENS = 400_000
MAX_SHARDS = 4096
ROUNDS = 2


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` over all rows of ``text``; counted in tasks before the shuffle."""

    def run(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in utf8_of(batch):
                seen.update(text.lower().split())
            if len(seen) > 400_000:
                yield _count_batch(seen)
                seen = Counter()
        yield _count_batch(seen)

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _count_batch(seen: Counter) -> pa.RecordBatch:
    words = pa.array(list(seen.keys()), pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([words, pa.array(list(seen.values()), pa.int64())], names=["word", "n"])


@dataclass
class Counts:
    """What the training tokens say: totals, and the counts of the most frequent words by rank."""

    tokens: int
    distinct: int
    ends: int
    words: list[bytes]
    n: list[int]
    vocabulary: int = VOCABULARY
    state: dict = field(default_factory=dict)

    def base(self, count) -> float:
        """The base log10 probability of a token seen ``count`` times."""
        return np.log10((np.asarray(count) + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))

    @property
    def size(self) -> int:
        """Words that have a number in the model, beside the end and the unknown token."""
        return min(len(self.words), self.vocabulary - 2)

    @property
    def outside(self) -> float:
        """The weight, in half counts, of all words outside the vocabulary, an unseen one included."""
        known = self.ends + 0.5 * (self.ends > 0) + sum(self.n[: self.size]) + 0.5 * self.size
        return max(self.tokens + 0.5 * (self.distinct + 1) - known, 0.5)

    def probabilities(self) -> np.ndarray:
        """Starting probabilities of the model's tokens; unused numbers have next to none."""
        weights = np.zeros(self.vocabulary)
        weights[END], weights[UNKNOWN] = self.ends + 0.5, self.outside
        weights[2 : 2 + self.size] = np.array(self.n[: self.size]) + 0.5
        return weights / weights.sum()

    def numbers(self) -> dict[bytes, int]:
        """Word to rank; kept with the broadcast counts of a Python worker."""
        if "numbers" not in self.state:
            self.state["numbers"] = {word: i for i, word in enumerate(self.words)}
        return self.state["numbers"]

    def model_numbers(self) -> dict[bytes, int]:
        """Word to the model's token, without words outside the vocabulary: few entries are found faster."""
        if "model" not in self.state:
            self.state["model"] = {word: i + 2 for i, word in enumerate(self.words[: self.size])}
        return self.state["model"]


def gather(counted: DataFrame, documents: int, vocabulary: int, kept: int) -> Counts:
    """Totals of a materialized table of word counts and its most frequent words."""
    total, distinct = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    top = counted.orderBy(F.desc("n"), "word").limit(kept).toArrow()
    words = top["word"].cast(pa.binary()).to_pylist()
    return Counts(total + documents, distinct + (documents > 0), documents, words, top["n"].to_pylist(), vocabulary)


def looked_up(words: list[bytes], numbers: dict[bytes, int], other: int, kind=np.int64) -> np.ndarray:
    return np.fromiter(map(numbers.get, words, repeat(other)), kind, len(words))


def model_ids(text: bytes, numbers: dict[bytes, int]) -> np.ndarray:
    """The model's tokens of a text, the end included."""
    return np.append(looked_up(text.lower().split(), numbers, UNKNOWN, "<u2"), np.array([END], "<u2"))


def training_ids(docs: DataFrame, shared) -> DataFrame:
    """``ids``: token numbers, two bytes each, of every document."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        numbers = shared.value.model_numbers()
        ids = [model_ids(t, numbers).tobytes() for t in utf8_of(batch)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return map_batches(docs.select("doc_id", "text"), "doc_id long, ids binary", work)


def merged(rows: DataFrame) -> DataFrame:
    """The sum of the weighted parameters of each partition: ``tokens, params``."""

    def run(batches):
        total, tokens = None, 0
        for batch in batches:
            for n, data in zip(batch.column("tokens").to_pylist(), batch.column("params")):
                flat = np.frombuffer(data.as_buffer(), np.float32)
                total, tokens = (flat if total is None else total + flat), tokens + n
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([tokens], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["tokens", "params"])

    return rows.mapInArrow(run, "tokens long, params binary")


def fit(training: DataFrame, counts: Counts, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """The network's parameters; a shard's and then some merged ones come to the driver, never the ids."""
    spark = training.sparkSession
    params = gru.fresh(counts.probabilities())
    if not counts.ends:
        return params
    shared = Shared(spark, counts)
    read = materialize(training_ids(training, shared))
    tokens = (read.agg(F.sum(F.length("ids"))).first()[0] or 0) // 2
    shards = int(min(MAX_SHARDS, max(1, tokens // SHARD_TOKENS)))
    for _ in range(rounds):
        start = Shared(spark, params)

        def run(batches, start=start):
            documents = [np.frombuffer(i.as_buffer(), "<u2") for b in batches for i in b.column("ids")]
            if documents:
                after, _ = gru.train(documents, start.value, END)
                n = sum(map(len, documents))
                flat = gru.packed(after) * np.float32(n / tokens)
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([flat.tobytes()], pa.binary())], names=["tokens", "params"])

        trained = read.select("ids").repartition(shards).mapInArrow(run, "tokens long, params binary")
        rows = merged(trained.repartition(max(1, isqrt(shards)))).collect()
        n = sum(row["tokens"] for row in rows)
        if n:
            params = gru.unpacked(sum(np.frombuffer(row["params"], np.float32) for row in rows) * (tokens / n), params)
    return params


def partial_scores(docs: DataFrame, counts: Counts, params: dict[str, np.ndarray]) -> DataFrame:
    """``doc_id, n_tokens, n_known, base, model, rare``: scores without the rare words, and these.

    ``base`` and ``model`` are log10; ``rare`` holds the words whose counts are not broadcast.
    """
    shared = Shared(docs.sparkSession, (counts, params))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, params = shared.value
        numbers = counts.numbers()
        base_of = np.append(counts.base(counts.n), 0.0)
        outside_of = np.append(np.log10((np.array(counts.n) + 0.5) / counts.outside), 0.0)
        outside_of[: counts.size] = 0.0
        end_base, none = float(counts.base(counts.ends)), len(counts.n)
        ids, known, base, model, rare = [], [], [], [], []
        for text in utf8_of(batch):
            words = text.lower().split()
            ranks = looked_up(words, numbers, none)
            ids.append(np.append(np.where(ranks < counts.size, ranks + 2, UNKNOWN), END))
            known.append(int((ranks < none).sum()) + (counts.ends > 0))
            base.append(float(base_of[ranks].sum()) + end_base)
            model.append(float(outside_of[ranks].sum()))
            rare.append([words[i] for i in np.flatnonzero(ranks == none)])
        if counts.ends:
            scores = gru.score_documents(ids, params, END) / np.log(10) + np.array(model)
        else:
            scores = np.array(base)
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").cast(pa.int64()),
                pa.array([len(i) for i in ids], pa.int64()),
                pa.array(known, pa.int64()),
                pa.array(base, pa.float64()),
                pa.array(scores, pa.float64()),
                pa.array(rare, pa.list_(pa.binary())).cast(pa.list_(pa.string())),
            ],
            names=["doc_id", "n_tokens", "n_known", "base", "model", "rare"],
        )

    schema = "doc_id long, n_tokens long, n_known long, base double, model double, rare array<string>"
    return map_batches(docs.select("doc_id", "text"), schema, work, most=12_000_000)


def scored(docs: DataFrame, vocabulary: int = VOCABULARY, kept: int = MAX_BROADCAST_WORDS) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``doc_id, text``.

    ``vocabulary`` is a multiple of the network's class size and ``kept``, the
    number of words whose counts are broadcast, at least as large.
    """
    training = docs.select("doc_id", "text").where(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    counted = materialize(word_counts(training))
    counts = gather(counted, training.count(), vocabulary, kept)
    params = fit(training, counts)
    partial = materialize(partial_scores(docs, counts, params).withColumn("row", F.monotonically_increasing_id()))
    rare = partial.select("row", F.explode("rare").alias("word")).join(counted, "word", "left")
    half = F.log10(F.coalesce("n", F.lit(0)) + 0.5)
    sums = rare.groupBy("row").agg(
        F.sum(half).alias("half"), F.count(F.lit(1)).alias("words"), F.count("n").alias("found")
    )
    zero = F.lit(0)
    half, words = F.coalesce("half", F.lit(0.0)), F.coalesce("words", zero)
    base = half - words * log10(counts.tokens + 0.5 * (counts.distinct + 1))
    outside = half - words * log10(counts.outside) if counts.ends else base
    return partial.join(sums, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("found", zero)).alias("n_known"),
        F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + base).alias("base_score"),
        (F.col("model") + outside).alias("score"),
    )


def op7_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scored(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), *found.columns[1:])
