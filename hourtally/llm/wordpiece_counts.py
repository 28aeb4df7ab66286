"""Token counts of greedy longest-match word pieces by a linear automaton.

The vocabulary is a trie with failure links. A state stands for the part of the
word read since the last popped piece. Where a state has no transition for the
next byte, the longest-match pieces of that part are popped and the link leads to
the state of what remains; how many pieces a link pops is stored, so the number of
pieces of a word comes from one pass over its bytes and no piece is built.

A word is a run of ``[^\\x20\\x09-\\x0D]``. Its pieces are those of the greedy
longest match over the vocabulary, the first one from a marker byte on that words
begin with (the vocabulary's space). Where no piece matches, the word is one
unknown token.

Defined results: null and empty texts have no words and no tokens. Rows repeated
with one ``doc_id`` are counted each; columns other than ``doc_id`` and ``text``
are not looked at.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from hourtally.llm.bpe_trie import byte_of_letter, tokenizer_path
from hourtally.llm.common import Memo, Shared, map_batches, read_table, utf8_of

VOCABULARY = "byte_bpe_50k.json"
MARKER = b" "


@dataclass
class Automaton:
    """``step[state][byte]`` is a transition; ``link`` and ``pops`` belong to a state without one."""

    step: list[dict[int, int]]
    link: list[int]  # -1: nothing of the vocabulary matches
    pops: list[int]
    state: dict = field(default_factory=dict)

    @classmethod
    def build(cls, pieces: set[bytes]) -> Automaton:
        step: list[dict[int, int]] = [{}]
        whole = [False]
        for piece in sorted(pieces):
            at = 0
            for byte in piece:
                if byte not in step[at]:
                    step[at][byte] = len(step)
                    step.append({})
                    whole.append(False)
                at = step[at][byte]
            whole[at] = True
        automaton = cls(step, [-1] * len(step), [0] * len(step))
        level = [(0, byte, child) for byte, child in step[0].items()]
        while level:
            deeper = []
            for parent, byte, node in level:
                if whole[node]:
                    # All of it is one piece; reading goes on at the root.
                    automaton.link[node], automaton.pops[node] = 0, 1
                else:
                    automaton._follow(parent, byte, node)
                deeper += [(node, b, child) for b, child in step[node].items()]
            level = deeper
        return automaton

    def _follow(self, parent: int, byte: int, node: int) -> None:
        """The link of a node that is no piece: what its parent pops, then the byte read from there."""
        at, popped = self.link[parent], self.pops[parent]
        while at >= 0 and byte not in self.step[at]:
            popped += self.pops[at]
            at = self.link[at]
        if at >= 0:
            self.link[node], self.pops[node] = self.step[at][byte], popped

    def count(self, word: bytes) -> int:
        """The number of pieces of a word; -1 where it cannot be divided into pieces."""
        step, link, pops = self.step, self.link, self.pops
        at = total = 0
        for byte in word:
            while True:
                after = step[at].get(byte)
                if after is not None:
                    at = after
                    break
                total += pops[at]
                at = link[at]
                if at < 0:
                    return -1
        while at > 0:
            total += pops[at]
            at = link[at]
        return total if at == 0 else -1


def load_pieces(path: str) -> set[bytes]:
    """The pieces of a byte-level vocabulary file as bytes."""
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    letters = byte_of_letter()
    return {bytes(letters[c] for c in piece) for piece in vocabulary}


def piece_counts(docs: DataFrame, pieces: set[bytes], marker: bytes = MARKER) -> DataFrame:
    """``doc_id, n_words, n_tokens, n_unknown`` of every row; an unknown word is one token."""
    shared = Shared(docs.sparkSession, Automaton.build(pieces))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        automaton = shared.value  # one object in all tasks of a Python worker
        if "memo" not in automaton.state:
            automaton.state["memo"] = Memo(lambda word: automaton.count(marker + word), 300_000)
        find = automaton.state["memo"].__getitem__
        split = [text.split() for text in utf8_of(batch)]
        counts = [list(map(find, words)) for words in split]
        unknown = [c.count(-1) for c in counts]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").cast(pa.int64()),
                pa.array(map(len, split), pa.int64()),
                pa.array([sum(c) + 2 * u for c, u in zip(counts, unknown)], pa.int64()),
                pa.array(unknown, pa.int64()),
            ],
            names=["doc_id", "n_words", "n_tokens", "n_unknown"],
        )

    return map_batches(docs.select("doc_id", "text"), "doc_id long, n_words long, n_tokens long, n_unknown long", work)


def op9_wordpiece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_counts(read_table(spark, sf_dir, "documents"), load_pieces(tokenizer_path(VOCABULARY)))
