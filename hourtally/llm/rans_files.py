"""Token ids in files of range asymmetric numeral systems (rANS) blocks.

Ids are coded with one static frequency table for the whole corpus. A block
holds the ids of consecutive documents in ascending ``doc_id`` order and decodes
without any other block. Its ids are dealt over ``LANES`` interleaved coders, so
a step codes many ids at once; every ``CHECKPOINT`` steps the coders' states and
the place in the block's words are noted, and a decoder can start from each of
them, which it does for all at once. A checksum covers every block.

A block is one binary value of a Parquet table that Spark writes, so that its
commit protocol covers lost executors, with the headers needed to find documents
beside it:

    part, block        the range partition, and the block's turn in it
    first_id, offset   its first document, and the ids before it in the partition
    n_docs, n_ids      its documents and ids
    data               its bytes

A ``header`` table of one row beside the blocks, written last, names the vocabulary
and holds the counts that the frequency table is made of, with a checksum, so the
files can be read in another session.

``data`` is little-endian: the magic, n_docs, n_ids, number of checkpoints and
number of words; doc ids and lengths; each checkpoint's place and states; the
words; crc32 of all this.

Defined results: a null text is empty and holds the end id alone. Rows repeated
with one ``doc_id`` are stored one after the other. A null ``doc_id`` comes first
and reads back as null. Other columns than ``doc_id`` and ``text`` are not stored.
"""

from __future__ import annotations

import json
import re
import unicodedata
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hourtally.llm.bpe_trie import byte_of_letter, tokenizer_path
from hourtally.llm.common import KEPT_BYTES, Shared, list_array, map_batches, read_table, utf8_of
from hourtally.session import ensure_checkpoint_dir, materialize

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
MAGIC = b"RNS1"
SCALE_BITS = 20
LANES = 1024
CHECKPOINT = 256  # steps, so LANES times as many ids
BLOCK_IDS = 1 << 20  # at least, as documents are not divided
# Range partitions: about this many bytes of ids each, and a bound on their number.
PART_BYTES = 256_000_000
MAX_PARTS = 200_000
NULL_ID = -(2**63)
BLOCK_SCHEMA = pa.schema(
    [(c, pa.int64()) for c in ("part", "block", "first_id", "offset", "n_docs", "n_ids")] + [("data", pa.binary())]
)
BLOCKS = "part long, block long, first_id long, offset long, n_docs long, n_ids long, data binary"
HEADER = "magic string, vocabulary string, end_id int, counts binary, crc32 long"
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)


class Tables:
    """Frequencies that add up to ``1 << SCALE_BITS``, their sums, and the id of every slot."""

    def __init__(self, counts: np.ndarray):
        self.freq = quantised(counts, 1 << SCALE_BITS)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.id_of = np.repeat(np.arange(len(counts), dtype=np.uint32), self.freq)
        self.freq = self.freq.astype(np.uint64)


def quantised(counts: np.ndarray, total: int) -> np.ndarray:
    """Whole frequencies in proportion to the counts, at least 1 each, with the given sum."""
    counts = np.asarray(counts, dtype=np.float64)
    free = total - len(counts)
    share = counts * (free / max(counts.sum(), 1.0))
    whole = np.floor(share).astype(np.int64)
    left = free - int(whole.sum())
    if counts.sum() == 0:
        whole[:] = free // len(counts)
        left = free - int(whole.sum())
    order = np.argsort(-(share - whole), kind="stable")
    whole[order[:left]] += 1
    return whole + 1


def encode_block(ids: np.ndarray, docs: np.ndarray, lengths: np.ndarray, tables: Tables) -> bytes:
    steps = -(-len(ids) // LANES)
    padded = np.zeros(steps * LANES, dtype=np.int64)
    padded[: len(ids)] = ids
    used = np.zeros(steps * LANES, dtype=bool)
    used[: len(ids)] = True
    freq, start = tables.freq[padded].reshape(-1, LANES), tables.start[padded].reshape(-1, LANES)
    used = used.reshape(-1, LANES)
    state = np.full(LANES, _LOW, dtype=np.uint64)
    words: list[np.ndarray] = []  # from the last to the first
    places, states, n = [], [], 0
    for step in range(steps - 1, -1, -1):
        f, live = freq[step], used[step]
        full = live & (state >= (f << np.uint64(63 - SCALE_BITS)))
        if full.any():
            words.append(state[full].astype(np.uint32)[::-1])
            n += len(words[-1])
            state[full] >>= _WORD
        quotient = state // f
        after = (quotient << np.uint64(SCALE_BITS)) + (state - quotient * f) + start[step]
        state = np.where(live, after, state)
        if step % CHECKPOINT == 0:
            places.append(n)
            states.append(state.copy())
    stream = np.concatenate(words)[::-1] if words else np.empty(0, np.uint32)
    head = np.array([len(docs), len(ids), len(places), n], dtype="<u8")
    body = b"".join(
        [
            MAGIC,
            head.tobytes(),
            docs.astype("<i8").tobytes(),
            lengths.astype("<u8").tobytes(),
            (n - np.array(places[::-1], dtype="<u8")).tobytes() if places else b"",
            b"".join(s.astype("<u8").tobytes() for s in states[::-1]),
            stream.astype("<u4").tobytes(),
        ]
    )
    return body + zlib.crc32(body).to_bytes(4, "little")


def decode_block(data: bytes, tables: Tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Doc ids, lengths and ids of a block; all its checkpoints are decoded side by side."""
    if data[:4] != MAGIC or zlib.crc32(data[:-4]) != int.from_bytes(data[-4:], "little"):
        raise ValueError("damaged block of token ids")
    n_docs, n_ids, marks, n_words = np.frombuffer(data, "<u8", 4, 4).tolist()
    at = 36
    docs = np.frombuffer(data, "<i8", n_docs, at)
    lengths = np.frombuffer(data, "<u8", n_docs, at + 8 * n_docs).astype(np.int64)
    at += 16 * n_docs
    places = np.frombuffer(data, "<u8", marks, at).astype(np.int64)
    at += 8 * marks
    state = np.frombuffer(data, "<u8", marks * LANES, at).reshape(marks, LANES).copy()
    words = np.frombuffer(data, "<u4", n_words, at + 8 * marks * LANES).astype(np.uint64)
    out = np.zeros((marks, CHECKPOINT, LANES), dtype=np.uint32)
    left = n_ids - np.arange(marks) * CHECKPOINT * LANES  # ids from each checkpoint on
    mask, lane = np.uint64((1 << SCALE_BITS) - 1), np.arange(LANES)
    for step in range(CHECKPOINT):
        live = lane[None, :] < (left - step * LANES)[:, None]
        if not live.any():
            break
        slot = state & mask
        found = tables.id_of[slot]
        out[:, step] = np.where(live, found, 0)
        after = tables.freq[found] * (state >> np.uint64(SCALE_BITS)) + slot - tables.start[found]
        state = np.where(live, after, state)
        low = live & (state < _LOW)
        turn = np.cumsum(low, axis=1)
        source = places[:, None] + turn - 1
        state[low] = (state[low] << _WORD) | words[source[low]]
        places = places + turn[:, -1]
    return docs, lengths, out.reshape(-1)[:n_ids]


# The words of the tokenizer's pattern in lower-cased text whose bytes above 127 are all of letters.
_PLAIN_WORDS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\x80-\xff]+|[0-9]|[^\sa-z0-9\x80-\xff]+")
_ASCII = bytes(range(128))


class TokenEncoder(dict):
    """Encodes texts with the tokenizers library, each distinct word once: word to packed ids.

    White space separates words for this tokenizer and never belongs to one, and
    its normalisation does not reach over white space, so what stands between
    white space encodes alike alone and in its text. Texts whose characters
    beyond ASCII are letters in normal form are cut into the pattern's words,
    others at white space. Words of letters and marks go straight to the model,
    all else through the whole tokenizer. What is remembered is bounded and
    serves speed alone.
    """

    def __init__(self, spec: str, end_id: int, most: int = 500_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.letters = {b: c for c, b in byte_of_letter().items()}
        self.code = "H" if id_type(self.tokenizer.get_vocab_size()).itemsize == 2 else "I"
        self.end = self.packed([end_id])
        self.most = most

    def packed(self, ids) -> bytes:
        return array(self.code, ids).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.most:
            self.clear()
        text = word.decode()
        # The library lower-cases letter by letter, so a sigma does not look at its neighbours.
        lower = text.lower() if "Σ" not in text else ""
        if text.isascii() and text.isalpha():
            ids = [t.id for t in self.model.tokenize(lower)]
        elif text.isalpha() and lower.isalpha() and unicodedata.is_normalized("NFC", text):
            ids = [t.id for t in self.model.tokenize("".join([self.letters[b] for b in lower.encode()]))]
        else:
            ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        packed = self.packed(ids)
        if len(word) <= KEPT_BYTES:
            self[word] = packed
        return packed

    def words(self, text: bytes) -> list[bytes]:
        if b"<|" in text:  # perhaps a special token, which lower case could make or hide
            return text.split()
        lower = text.lower()
        beyond = lower.translate(None, _ASCII).decode()
        if beyond and not (beyond.isalpha() and unicodedata.is_normalized("NFC", beyond)):
            return lower.split()
        return _PLAIN_WORDS.findall(lower)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The packed ids of every text, the end id after them."""
        find = self.__getitem__
        return [b"".join(map(find, self.words(text))) + self.end for text in texts]


def id_type(n: int) -> np.dtype:
    return np.dtype("<u2" if n <= 1 << 16 else "<u4")


def read_spec(vocabulary: str) -> tuple[str, int]:
    """A vocabulary file and the number of its ids."""
    with open(vocabulary, encoding="utf-8") as file:
        spec = file.read()
    parsed = json.loads(spec)
    return spec, 1 + max(max(parsed["model"]["vocab"].values()), *(t["id"] for t in parsed["added_tokens"]))


def token_table(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """``doc_id, ids`` with the ids of a text and the end id as little-endian integers."""
    spec, _ = read_spec(vocabulary)
    shared = Shared(docs.sparkSession, {"spec": spec})

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        tables = shared.value  # one object in all tasks of a Python worker
        if "encoder" not in tables:
            tables["encoder"] = TokenEncoder(tables["spec"], end_id)
        ids = tables["encoder"].encode(utf8_of(batch))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "ids"]
        )

    return map_batches(docs.select("doc_id", "text"), "doc_id long, ids binary", work, most=1_000_000)


def id_counts(tokens: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in the whole table: one row per id comes to the driver."""
    dtype = id_type(size)

    def run(batches):
        seen = np.zeros(size, dtype=np.int64)
        for batch in batches:
            ids = np.frombuffer(b"".join(batch.column("ids").to_pylist()), dtype)
            seen += np.bincount(ids, minlength=size)
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(seen[found])], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(size, dtype=np.int64)
    for row in rows:
        counts[row["id"]] = row["n"]
    return counts


def encode_files(tokens: DataFrame, tables: Tables, size: int) -> DataFrame:
    """The blocks of the ids in ascending ``doc_id`` order."""
    spark = tokens.sparkSession
    stored = tokens.agg(F.sum(F.length("ids"))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = min(MAX_PARTS, max(parts, -(-stored // PART_BYTES)))
    shared = Shared(spark, tables)
    dtype = id_type(size)

    def block(part: int, turn: int, offset: int, docs: list[int], ids: list[np.ndarray]) -> pa.RecordBatch:
        lengths = np.array([len(i) for i in ids], dtype=np.int64)
        data = encode_block(np.concatenate(ids), np.array(docs, dtype=np.int64), lengths, shared.value)
        row = {"part": part, "block": turn, "first_id": docs[0], "offset": offset}
        row |= {"n_docs": len(docs), "n_ids": int(lengths.sum()), "data": data}
        return pa.RecordBatch.from_pylist([row], schema=BLOCK_SCHEMA)

    def run(batches):
        part, turn, offset, held = TaskContext.get().partitionId(), 0, 0, 0
        docs, ids = [], []
        for batch in batches:
            for doc_id, data in zip(batch.column("doc_id"), batch.column("ids")):
                docs.append(NULL_ID if doc_id.as_py() is None else doc_id.as_py())
                ids.append(np.frombuffer(data.as_py(), dtype))
                held += len(ids[-1])
                if held >= BLOCK_IDS:
                    yield block(part, turn, offset, docs, ids)
                    turn, offset, held, docs, ids = turn + 1, offset + held, 0, [], []
        if docs:
            yield block(part, turn, offset, docs, ids)

    ordered = tokens.select("doc_id", "ids").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    return ordered.mapInArrow(run, BLOCKS)


def placed_blocks(blocks: DataFrame) -> DataFrame:
    """``start, data``: the blocks, and the ids of all documents before each.

    One row per range partition, at most ``MAX_PARTS``, is added up and broadcast.
    """
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"), F.min("first_id").alias("first_id"))
    before = Window.orderBy("first_id").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    return blocks.join(F.broadcast(starts), "part").select((F.col("part_start") + F.col("offset")).alias("start"), "data")


def decoded(blocks: DataFrame, tables: Tables, schema: str, columns) -> DataFrame:
    """Rows of ``columns(docs, starts, lengths, ids)`` for the documents of every block."""
    shared = Shared(blocks.sparkSession, tables)

    def run(batches):
        for batch in batches:
            for start, data in zip(batch.column("start").to_pylist(), batch.column("data")):
                docs, lengths, ids = decode_block(data.as_py(), shared.value)
                ends = np.cumsum(lengths)
                doc_ids = pa.array(docs, pa.int64(), mask=docs == NULL_ID)
                rest = columns(start + ends - lengths, lengths, ends, ids)
                yield pa.RecordBatch.from_arrays([doc_ids, *rest], names=[c.split()[0] for c in schema.split(", ")])

    return placed_blocks(blocks).mapInArrow(run, schema)


def read_ids(blocks: DataFrame, tables: Tables) -> DataFrame:
    """``doc_id, start, ids`` of every stored document."""

    def columns(starts, lengths, ends, ids):
        return [pa.array(starts), list_array(ids.astype(np.int32), np.concatenate([[0], ends]))]

    return decoded(blocks, tables, "doc_id long, start long, ids array<int>", columns)


def read_checksums(blocks: DataFrame, tables: Tables) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every stored document."""

    def columns(starts, lengths, ends, ids):
        data = ids.astype("<u4").tobytes()
        sums = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
        return [pa.array(starts), pa.array(lengths), pa.array(sums, pa.int64())]

    return decoded(blocks, tables, "doc_id long, start long, n_tokens long, ids_crc32 long", columns)


def write_token_files(docs: DataFrame, vocabulary: str, path: str, end_id: int = END_ID) -> None:
    """Store the ids of ``docs`` below ``path``: ``blocks``, and last a ``header`` with all that reading needs."""
    spark = docs.sparkSession
    _, size = read_spec(vocabulary)
    tokens = materialize(token_table(docs, vocabulary, end_id))
    counts = id_counts(tokens, size).astype("<i8").tobytes()
    encode_files(tokens, Tables(np.frombuffer(counts, "<i8")), size).write.parquet(f"{path}/blocks")
    row = (MAGIC.decode(), vocabulary.rpartition("/")[2], end_id, counts, zlib.crc32(counts))
    spark.createDataFrame([row], HEADER).coalesce(1).write.parquet(f"{path}/header")


def read_token_files(spark: SparkSession, path: str) -> tuple[DataFrame, Tables]:
    """The blocks below ``path`` and the frequency tables to read them with; ``ValueError`` if the header is damaged."""
    header = spark.read.schema(HEADER).parquet(f"{path}/header").first()
    counts = bytes(header["counts"])
    if header["magic"] != MAGIC.decode() or zlib.crc32(counts) != header["crc32"]:
        raise ValueError(f"damaged header below {path}")
    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks"), Tables(np.frombuffer(counts, "<i8"))


def write_ids(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> tuple[DataFrame, Tables]:
    """The ids of ``docs`` written to the checkpoint folder, and opened for reading."""
    path = f"{ensure_checkpoint_dir(docs.sparkSession).rstrip('/')}/ids-{uuid.uuid4().hex}"
    write_token_files(docs, vocabulary, path, end_id)
    return read_token_files(docs.sparkSession, path)


def op3_rans_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, tables = write_ids(read_table(spark, sf_dir, "documents"), tokenizer_path(VOCABULARY))
    return read_checksums(blocks, tables)
