"""Byte-level BPE by last-token states along a trie of distinct words.

The BPE encoding of a prefix is the encoding of a shorter prefix and one last
token, and a sequence of tokens is an encoding exactly if every two neighbours
are (both follow from merges being applied in one fixed order). So a word is
encoded by finding, for each of its prefixes, the one token that ends there and
goes with the last token of what precedes it. The distinct words of a batch form
a trie that is walked depth first, in sorted order: the states of the path from
the root are kept, and a prefix that words share is solved once.

Defined results: null text is empty, encodes to no ids and decodes to an empty
text. Every row of the input has one row in the output, repeated rows too; other
columns than ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourtally.llm.common import KEPT_BYTES, Memo, Shared, map_batches, read_table

# Fixed value: the pattern that cuts a text into the words of this tokenizer.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "byte_bpe_50k.json"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_of_letter() -> dict[str, int]:
    """Vocabulary files write a byte as a letter: printable ones as themselves, the others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass
class Bpe:
    """Tables of a byte-level BPE vocabulary; a few MB, whatever the corpus."""

    token_of: dict[bytes, int]
    bytes_of: dict[int, bytes]
    rank: dict[tuple[int, int], tuple[int, int]]
    special: dict[str, int]
    parts: dict[int, tuple[int, int, int]]  # turn and sides of the merge that makes a token; -1 for bytes
    # Suffixes: a trie of the tokens with the longest token that ends at each node, and the
    # next shorter token that ends a token.
    step: list[dict[int, int]] = field(default_factory=list)
    back: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    shorter: dict[int, int] = field(default_factory=dict)
    state: dict = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Bpe:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_of_letter()
        raw = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        rank, parts = {}, {i: (-1, i, i) for i in raw.values()}
        for turn, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            x, y = (bytes(letters[c] for c in side) for side in (left, right))
            rank[raw[x], raw[y]] = (turn, raw[x + y])
            if parts[raw[x + y]][0] < 0:
                parts[raw[x + y]] = (turn, raw[x], raw[y])
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        bytes_of = {i: b for b, i in raw.items()} | {i: t.encode() for t, i in special.items()}
        bpe = cls(raw, bytes_of, rank, special, parts)
        # A token that merging would never produce ends no encoding.
        bpe.token_of = {b: i for b, i in raw.items() if len(b) == 1 or bpe.merged(b) == [i]}
        bpe._link_suffixes()
        return bpe

    def _link_suffixes(self) -> None:
        self.step, self.ends, token_at = [{}], [-1], {}
        for token, i in self.token_of.items():
            at = 0
            for byte in token:
                if byte not in self.step[at]:
                    self.step[at][byte] = len(self.step)
                    self.step.append({})
                    self.ends.append(-1)
                at = self.step[at][byte]
            self.ends[at], token_at[at] = i, i
        self.back = [0] * len(self.step)
        level = list(self.step[0].values())
        for node in level:
            for byte, child in self.step[node].items():
                at = self.back[node]
                while at and byte not in self.step[at]:
                    at = self.back[at]
                self.back[child] = self.step[at].get(byte, 0)
                level.append(child)
            suffix = self.ends[self.back[node]]
            if node in token_at:
                self.shorter[token_at[node]] = suffix
            else:
                self.ends[node] = suffix

    def after(self, key: int) -> int:
        """The node for the longest suffix of what node ``key >> 8`` stands for and byte ``key & 255``."""
        node, byte = key >> 8, key & 255
        while node and byte not in self.step[node]:
            node = self.back[node]
        return self.step[node].get(byte, 0)

    def merged(self, piece: bytes) -> list[int]:
        """The definition of BPE: apply the earliest merge, leftmost first, until none applies."""
        ids = [self.token_of[piece[i : i + 1]] for i in range(len(piece))]
        while len(ids) > 1:
            turn, at = min((self.rank.get(pair, (len(self.rank), 0))[0], i) for i, pair in enumerate(zip(ids, ids[1:])))
            if turn == len(self.rank):
                break
            ids[at : at + 2] = [self.rank[ids[at], ids[at + 1]][1]]
        return ids

    def goes_with(self, pair: tuple[int, int]) -> bool:
        """Whether merging keeps the two tokens apart.

        Their merges are undone from the latest on, which shows every pair of
        neighbours that met at the boundary. One that could merge before the
        next step of either side would have crossed it; at equal turns the
        leftmost merge comes first.
        """
        left, right = pair
        parts, rank = self.parts, self.rank
        if pair in rank:
            return False
        while True:
            turn, other = parts[left][0], parts[right][0]
            if turn < 0 and other < 0:
                return True
            if turn > other:
                left, most = parts[left][2], turn - 1
            else:
                right, most = parts[right][1], other
            met = rank.get((left, right))
            if met is not None and met[0] <= most:
                return False

    def encode_words(self, words: list[bytes], pairs: Memo, nodes: Memo) -> dict[bytes, tuple[int, ...]]:
        """The encodings of distinct words, by one depth-first walk over their trie.

        ``pairs`` and ``nodes`` remember ``goes_with`` and ``after``.
        """
        encoded: dict[bytes, tuple[int, ...]] = {}
        path, states = [-1], [0]  # last token and node for each prefix of the current word
        before = b""
        ends, shorter = self.ends, self.shorter
        length = self.state.setdefault("length", {})
        if not length:
            length.update((i, len(b)) for b, i in self.token_of.items())
        for word in sorted(words):
            shared = 0
            for x, y in zip(word, before):
                if x != y:
                    break
                shared += 1
            del path[shared + 1 :], states[shared + 1 :]
            node = states[shared]
            for end in range(shared, len(word)):
                node = nodes[node << 8 | word[end]]
                token = ends[node]
                start = end + 1 - length[token]
                while start and not pairs[path[start] << 20 | token]:
                    token = shorter[token]
                    start = end + 1 - length[token]
                path.append(token)
                states.append(node)
            before = word
            ids, end = [], len(word)
            while end:
                ids.append(path[end])
                end -= length[path[end]]
            encoded[word] = tuple(reversed(ids))
        return encoded


# A space that no other white space follows begins a word of its own, so texts
# without any other kind of space can be cut at spaces before the pattern is used.
_LOOSE_SPACE = re.compile(r" (?!\S)")


class Encoder:
    """Encodes batches of texts; what it remembers is bounded and serves speed alone."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe
        self.pattern = regex.compile(WORDS)
        self.special = regex.compile("|".join(map(regex.escape, bpe.special))) if bpe.special else None
        self.pairs = Memo(lambda key: bpe.goes_with((key >> 20, key & 0xFFFFF)), 500_000)
        self.nodes = Memo(bpe.after, 300_000)
        tokens = [bpe.bytes_of.get(i, b"") for i in range(max(bpe.bytes_of) + 1)]
        self.table = np.frombuffer(b"".join(tokens), np.uint8)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        # Words and pieces are kept until there are more than this many.
        self.most = 400_000
        # Values are the ids as they are written, with commas: one small string an entry.
        self.words: dict[str, str] = {}
        self.pieces: dict = {}
        self.long: list = []  # pieces and words too long to be kept beyond a batch

    def cut(self, text: str) -> list:
        """Keys of a text's pieces: a string, preceded by a space where its flag is set, or a special token."""
        keys, at = [], 0
        for found in self.special.finditer(text) if self.special else ():
            keys += self.cut_plain(text[at : found.start()])
            keys.append((found[0], None))
            at = found.end()
        return keys + self.cut_plain(text[at:])

    def cut_plain(self, text: str) -> list:
        if not text:
            return []
        if _LOOSE_SPACE.search(text):
            return [(word, False) for word in self.pattern.findall(text)]
        first, *rest = text.split(" ")
        return [(first, False), *rest] if first else rest

    def learn(self, keys: set) -> None:
        """Adds the written ids of new pieces.

        A word of letters after a space is the piece of these letters and kept as such
        alone, so most words are kept once.
        """
        if len(self.words) > self.most:
            self.words.clear()
        words, pieces, findall = self.words, self.pieces, self.pattern.findall
        cuts, missing = {}, {}
        for key in keys:
            if type(key) is str:
                if key.isalpha():
                    missing[" " + key] = key
                    continue
                cuts[key] = findall(" " + key)
            elif key[1] is None:
                pieces[key] = str(self.bpe.special[key[0]])
            else:
                cuts[key] = findall(key[0])
        for word in chain.from_iterable(cuts.values()):
            letters = word[1:]
            if word[0] == " " and letters.isalpha():
                if letters not in pieces:
                    missing[word] = letters
            elif word not in words:
                missing[word] = None
        raw = {word: word.encode() for word in missing}
        encoded = self.bpe.encode_words(list(raw.values()), self.pairs, self.nodes)
        for word, letters in missing.items():
            kept, key = (words, word) if letters is None else (pieces, letters)
            kept[key] = ",".join(map(str, encoded[raw[word]]))
            if len(raw[word]) > KEPT_BYTES:
                self.long.append((kept, key))
        for key, key_words in cuts.items():
            if len(key if type(key) is str else key[0]) > KEPT_BYTES:
                self.long.append((pieces, key))
            pieces[key] = ",".join([pieces[w[1:]] if w[0] == " " and w[1:].isalpha() else words[w] for w in key_words])

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, str]]:
        """The ids of each text, and the same ids written with commas."""
        cuts = [self.cut(text) for text in texts]
        if len(self.pieces) > self.most:
            self.pieces.clear()
        self.learn(set(filterfalse(self.pieces.__contains__, chain.from_iterable(cuts))))
        out, find = [], self.pieces.__getitem__
        for cut in cuts:
            written = ",".join(map(find, cut))
            out.append((np.fromstring(written, np.int32, sep=",") if written else np.empty(0, np.int32), written))
        for kept, key in self.long:
            kept.pop(key, None)
        self.long.clear()
        return out

    def decode(self, ids) -> str:
        """The bytes of all tokens one after the other, gathered from one table."""
        ids = np.asarray(ids, np.int32)
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        places = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[ids] - (ends - lengths), lengths)
        return self.table[places].tobytes().decode("utf-8", "replace")


def encoder_of(shared) -> Encoder:
    """The encoder of this Python worker: the broadcast tables are one object in all its tasks."""
    bpe = shared.value
    if "encoder" not in bpe.state:
        bpe.state["encoder"] = Encoder(bpe)
    return bpe.state["encoder"]


def bpe_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: ids by the trie, the text decoded from them."""
    shared = Shared(docs.sparkSession, Bpe.load(vocabulary))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = encoder_of(shared)
        encoded = encoder.encode([x or "" for x in batch.column("text").to_pylist()])
        sha = [hashlib.sha256(written.encode()).hexdigest() for _, written in encoded]
        back = [hashlib.sha256(encoder.decode(ids).encode()).hexdigest() for ids, _ in encoded]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array([len(i) for i, _ in encoded], pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_batches(docs.select("doc_id", "text"), schema, work, most=1_000_000)


def encode_texts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, ids`` with the token ids of every text."""
    shared = Shared(docs.sparkSession, Bpe.load(vocabulary))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoded = encoder_of(shared).encode([x or "" for x in batch.column("text").to_pylist()])
        ids = pa.array([i for i, _ in encoded], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), ids], names=["doc_id", "ids"])

    return map_batches(docs.select("doc_id", "text"), "doc_id long, ids array<int>", work, most=1_000_000)


def decode_ids(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``; null ids give an empty text."""
    shared = Shared(encoded.sparkSession, Bpe.load(vocabulary))

    def run(batches):
        encoder = encoder_of(shared)
        for batch in batches:
            texts = [encoder.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"]
            )

    return encoded.select("doc_id", F.col("ids")).mapInArrow(run, "doc_id long, text string")


def op10_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(read_table(spark, sf_dir, "documents"), tokenizer_path(VOCABULARY))
