"""Quality rules: a decision list learned by sequential covering.

Statistics of every whole text are computed once. A list of rules for low
quality is learned from those of a bounded sample of labelled documents: a rule,
a conjunction of thresholds, is grown on two thirds of the sample until it covers
no good document, pruned on the other third, and kept if it is precise there; the
documents it covers are set aside and the next rule is sought. The list becomes
one ordered Spark conditional expression, which no Python takes part in.

Defined results: null and empty texts have zero statistics and fail the base
rule. Of several labels of a document the smallest counts, null labels are not
used. Without labels of both kinds the list is empty and the base rule decides.
Rows repeated with one ``doc_id`` are judged each; columns other than ``doc_id``
and ``text`` are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourtally.llm.common import Memo, hash64, map_batches, read_table, utf8_of
from hourtally.session import materialize

MAX_TRAINING_ROWS = 20_000  # labelled documents in expectation, drawn by a hash of their ids
MAX_RULES = 16
MAX_CONDITIONS = 4
LEAST_PRECISION = 0.9  # on all documents a rule covers; half of it on those it was not grown on
LEAST_COVERED = 3
STATISTICS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_digits", "n_exclaims", "n_distinct",
)
# What rules test, as shares of a text's words, lines or characters.
FEATURES = {
    "word_length": "word_chars / n_words",
    "symbol_share": "n_symbols / word_chars",
    "symbols_per_word": "n_symbols / n_words",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / n_words",
    "distinct_share": "n_distinct / n_words",
    "upper_share": "n_upper / word_chars",
    "digit_share": "n_digits / word_chars",
    "exclaims_per_word": "n_exclaims / n_words",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "words": "cast(n_words AS double)",
}
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"

# Classes of bytes to count: bit 0 starts a code point, 1 white space, 2 symbol, 3 A-Z, 4 digit, 5 exclamation mark.
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[b for b in range(256) if b & 0xC0 != 0x80]] |= 1
for _bit, _chars in ((2, b"\x20\t\n\v\f\r"), (4, b"#*$%&|<>"), (8, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (16, b"0123456789"), (32, b"!")):
    _CLASS[list(_chars)] |= _bit


def text_statistics(text: bytes, memo: Memo) -> tuple[int, ...]:
    """The ``STATISTICS`` of a text, in their order."""
    words = text.split()
    kinds = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=64)
    of = {bit: int(kinds[(np.arange(64) & bit) > 0].sum()) for bit in (1, 2, 4, 8, 16, 32)}
    lines = [line for line in text.split(b"\n") if line.strip()]
    hashes = np.fromiter((memo[w] for w in words), dtype=np.uint64, count=len(words))
    repeated = 0
    if len(hashes) > 3:
        windows = (hashes[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ hashes[1:-1]) * np.uint64(0xBF58476D1CE4E5B9) ^ hashes[2:]
        _, place, counts = np.unique(windows, return_inverse=True, return_counts=True)
        again = counts[place] > 1
        inside = np.zeros(len(hashes), dtype=bool)
        for shift in range(3):
            inside[shift : shift + len(again)] |= again
        repeated = int(inside.sum())
    return (
        len(words), of[1] - of[2], of[4], len(lines) - len(set(lines)), repeated,
        len(lines), of[8], of[16], of[32], len(set(words)),
    )


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the ``STATISTICS`` of every row of ``doc_id, text``."""
    memo = Memo(hash64)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = np.array([text_statistics(t, memo) for t in utf8_of(batch)], dtype=np.int64).reshape(-1, len(STATISTICS))
        columns = [pa.array(rows[:, i]) for i in range(rows.shape[1])]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns], names=["doc_id", *STATISTICS])

    schema = ", ".join(f"{c} long" for c in ("doc_id", *STATISTICS))
    return map_batches(docs.select("doc_id", "text"), schema, work)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] <= self.threshold

    def sql(self) -> str:
        return f"{FEATURES[self.feature]} {'>=' if self.above else '<='} {self.threshold!r}D"


Rule = tuple[Condition, ...]


def covered(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), dtype=bool)
    for condition in rule:
        out &= condition.holds(x)
    return out


def _best_condition(x: dict[str, np.ndarray], bad: np.ndarray, inside: np.ndarray) -> Condition | None:
    """The condition of the highest information gain among those that narrow ``inside``."""
    p, n = (inside & bad).sum(), (inside & ~bad).sum()
    best, best_gain = None, 1e-9
    for name, values in x.items():
        mine = values[inside]
        for threshold in np.unique(np.quantile(mine[bad[inside]], np.linspace(0, 1, 41))):
            for above in (True, False):
                hit = mine >= threshold if above else mine <= threshold
                pos = (hit & bad[inside]).sum()
                neg = hit.sum() - pos
                if pos == 0 or (pos, neg) == (p, n):
                    continue
                gain = pos * (np.log2(pos / (pos + neg)) - np.log2(p / (p + n)))
                if gain > best_gain:
                    best, best_gain = Condition(name, above, float(threshold)), gain
    return best


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, seed: int = 11) -> list[Rule]:
    """An ordered list of rules that find the bad rows."""
    rules: list[Rule] = []
    random = np.random.default_rng(seed)
    left = np.ones(len(bad), dtype=bool)
    growing = random.random(len(bad)) < 2 / 3
    while len(rules) < MAX_RULES and (left & growing & bad).sum() >= LEAST_COVERED:
        inside, rule = left & growing, ()
        while len(rule) < MAX_CONDITIONS and (inside & ~bad).any():
            condition = _best_condition(x, bad, inside)
            if condition is None:
                break
            rule += (condition,)
            inside &= condition.holds(x)
        held = left & ~growing

        def worth(candidate):
            hit = held & covered(candidate, x)
            pos, total = (hit & bad).sum(), hit.sum()
            return (pos + 1) / (total + 2)

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=())
        hit = left & covered(rule, x) if rule else np.zeros(len(bad), dtype=bool)
        found = (hit & bad).sum()
        if found < LEAST_COVERED or found < LEAST_PRECISION * hit.sum() or worth(rule) < LEAST_PRECISION / 2:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def fit(stats: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> list[Rule]:
    """Rules for low quality among the documents that pass the base rule."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = min(1.0, max_rows / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit("rules")), F.lit(1 << 30)) < int(share * (1 << 30)))
    features = [F.expr(e).alias(c) for c, e in FEATURES.items()]
    rows = stats.where(f"NOT ({BASE_FAILED})").join(F.broadcast(drawn), "doc_id").select("quality", "doc_id", *features)
    table = rows.toPandas().sort_values(["doc_id", "quality"], kind="stable")
    bad = (table["quality"] == 0).to_numpy()
    if not bad.any() or bad.all():
        return []
    return learn_rules({c: table[c].to_numpy(dtype=np.float64) for c in FEATURES}, bad)


def rule_number(rules: list[Rule]) -> Column:
    """The number, from 1, of the first rule that a row meets; null where none does."""
    out = F.lit(None).cast("int")
    for number, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(F.expr(" AND ".join(c.sql() for c in rule)), F.lit(number)).otherwise(out)
    return out


def judged(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """The statistics with ``base_failed``, ``rule`` and ``kept``."""
    failed = F.expr(BASE_FAILED)
    rows = stats.withColumn("base_failed", failed).withColumn("rule", F.when(~failed, rule_number(rules)))
    return rows.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def op6_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialize(statistics(read_table(spark, sf_dir, "documents")))
    return judged(stats, fit(stats, read_table(spark, sf_dir, "labels"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )
