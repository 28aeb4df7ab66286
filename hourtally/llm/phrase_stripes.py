"""Collocations of two to four words by stripes.

A stripe is a counter of next words under a prefix. A task builds the stripes
of a few megabytes of text with numpy and sends them on; equal entries are then
added up. A stripe is merged entry by entry and lies spread over tasks, since
that of a frequent prefix, and of the empty one, is as large as a vocabulary.
Everything is read off the merged stripes: an entry is the count of an
extension and the total of the prefix one word longer, the largest entry of a
stripe is what may subsume its prefix from the right, the same by suffix from
the left. (A longer phrase contains one that is a single word longer and no
rarer, so these two decide subsumption by phrases of any length.)

The text is scanned twice. The first scan counts words and pairs. A phrase is
frequent only if all its pairs are, so the second scan counts phrases of three
and more words where every pair passes a filter of the frequent pairs: a bit
field of ``FILTER_BITS`` bits, whatever the size of the corpus. A wrong pass
costs a row in the shuffle and never changes a count.

Words travel as 64-bit hashes of language and word and are resolved for the
phrases that remain. Two of a hundred million distinct words share a hash with
probability 3e-4.

Defined results: null texts are empty, texts without words add nothing, a null
language is ``und``. Repeated rows count each time. Long texts are counted in
chunks that carry the words a phrase can reach back to. Columns other than
``lang`` and ``text`` are not looked at. Without documents or without phrases
there are no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hourtally.llm.common import Shared, hash64, list_array, read_table, slices, text_slices, utf8_of
from hourtally.session import materialize

LEAST = 30
LONGEST = 4
PERCENT = 80
TOP = 2_000
NO_LANGUAGE = "und"
FILTER_BITS = 1 << 26
CHUNK = 2_000_000
SALTS = 64

_SPACE, _BREAK = 32, 10
_TABLE = bytes.maketrans(b"\t.,;:!?\x0b\x0c\r" + bytes(range(65, 91)), b" " + b"\n" * 9 + bytes(range(97, 123)))
_SEPARATOR = re.compile(rb"[ \n]")
_STRIPES = "lang STRING, word BINARY, prefix ARRAY<BIGINT>, next ARRAY<BIGINT>, n ARRAY<BIGINT>"


class Words:
    """The words of a chunk: codes of (language, word), the piece of each, hashes and texts of the codes."""

    def __init__(self, texts: list[bytes], langs: list[bytes], seen: int = 0):
        data = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
        inside = (data != _SPACE) & (data != _BREAK)
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        starts, ends = edges[::2], edges[1::2]
        self.piece = np.searchsorted(np.flatnonzero(data == _BREAK), starts)
        self.seen = seen  # leading words that an earlier chunk has counted
        offsets = np.concatenate([[0], np.cumsum(ends - starts)])
        words = pa.Array.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[inside])]
        ).dictionary_encode()
        names = pa.array(langs, pa.binary()).dictionary_encode()
        firsts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        document = np.searchsorted(firsts, starts, side="right") - 1
        lang = names.indices.to_numpy()[document].astype(np.int64)
        distinct = max(1, len(words.dictionary))
        found, self.codes = np.unique(lang * distinct + words.indices.to_numpy(), return_inverse=True)
        self.langs = [names.dictionary[i].as_py() for i in range(len(names.dictionary))]
        self.lang_of = found // distinct
        self.texts = words.dictionary.take(pa.array(found % distinct)).cast(pa.binary()).to_pylist()
        prefixes = [b"%d:%s" % (len(name), name) for name in self.langs]
        self.ids = np.fromiter(
            (hash64(prefixes[at] + text) or 1 for at, text in zip(self.lang_of.tolist(), self.texts)),
            dtype=np.uint64,
            count=len(self.texts),
        ).view(np.int64)
        self.fresh = np.arange(len(self.codes)) >= seen

    def together(self, length: int) -> np.ndarray:
        """Whether the ``length`` words that end at each word are of one piece."""
        found = np.zeros(len(self.codes), dtype=bool)
        found[length - 1 :] = self.piece[length - 1 :] == self.piece[: len(self.piece) - length + 1]
        return found


def chunked(texts: list[bytes], langs: list[bytes], most: int = CHUNK) -> Iterator[Words]:
    """The words of documents in chunks of about ``most`` bytes; longer texts are cut between words."""
    for start, stop in slices([len(t) for t in texts], most):
        part = [t.translate(_TABLE) for t in texts[start:stop]]
        if len(part) > 1 or len(part[0]) <= most:
            yield Words(part, langs[start:stop])
            continue
        at = 0
        while at < len(part[0]):
            cut = _SEPARATOR.search(part[0], at + most)
            end = cut.start() if cut else len(part[0])
            before = _last_words(part[0], at)
            yield Words([part[0][at - len(before) : end]], langs[start:stop], len(before.split()))
            at = end


def _last_words(text: bytes, end: int) -> bytes:
    """The end of ``text[:end]`` with at least the words that a phrase can reach back to."""
    step = 1024
    while step < end:
        part = text[end - step : end]
        cut = _SEPARATOR.search(part)
        if cut and len(part[cut.start() :].split()) >= LONGEST - 1:
            return part[cut.start() :]
        step *= 2
    return text[:end]


def _striped(prefixes: list[np.ndarray], following: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Stripe rows of entries that are sorted by their prefix."""
    if not len(n):
        return _rows()
    new = np.zeros(len(n), dtype=bool)
    new[0] = True
    for column in prefixes:
        new[1:] |= column[1:] != column[:-1]
    firsts = np.flatnonzero(new)
    offsets = np.append(firsts, len(n))
    flat = np.stack([p[firsts] for p in prefixes], axis=1).ravel() if prefixes else np.empty(0, np.int64)
    width = len(prefixes)
    return _rows(
        prefix=list_array(flat, np.arange(len(firsts) + 1) * width),
        next=list_array(following, offsets),
        n=list_array(n.astype(np.int64), offsets),
    )


def _rows(**columns) -> pa.RecordBatch:
    rows = len(next(iter(columns.values()))) if columns else 0
    types = {"lang": pa.string(), "word": pa.binary(), **dict.fromkeys(("prefix", "next", "n"), pa.list_(pa.int64()))}
    arrays = [columns[c] if c in columns else pa.nulls(rows, t) for c, t in types.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(types))


def _of_languages(words: Words, langs, following: np.ndarray, n: np.ndarray, **columns) -> pa.RecordBatch:
    """Rows of one entry that name a language: its total, or the text of a word."""
    each = np.arange(len(n) + 1)
    names = pa.array([words.langs[i].decode() for i in langs])
    return _rows(lang=names, next=list_array(following, each), n=list_array(n, each), **columns)


def short_stripes(words: Words) -> Iterator[pa.RecordBatch]:
    """The empty prefix's stripe, the total of each language and the stripes of single words."""
    codes, ids = words.codes, words.ids
    counts = np.bincount(codes[words.fresh], minlength=len(ids))
    held = np.flatnonzero(counts)
    if len(held):
        yield _striped([], ids[held], counts[held])
        totals = np.bincount(words.lang_of, weights=counts, minlength=len(words.langs)).astype(np.int64)
        yield _of_languages(words, range(len(totals)), np.zeros_like(totals), totals)
    ends = np.flatnonzero(words.together(2) & words.fresh)
    pairs, n = np.unique(codes[ends - 1] * len(ids) + codes[ends], return_counts=True)
    yield _striped([ids[pairs // max(1, len(ids))]], ids[pairs % max(1, len(ids))], n)


def filter_places(first: np.ndarray, second: np.ndarray, bits: int) -> np.ndarray:
    """The bit of every pair in the filter."""
    x = first.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + second.view(np.uint64)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(33)) % np.uint64(bits)


def long_stripes(words: Words, passes: np.ndarray, bits: int, longest: int) -> Iterator[pa.RecordBatch]:
    """Stripes of prefixes of two and more words all of whose pairs pass, and the texts of the words in them."""
    codes, ids = words.codes, words.ids
    ends = np.flatnonzero(words.together(2))
    places = filter_places(ids[codes[ends - 1]], ids[codes[ends]], bits)
    ends = ends[(passes[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1 == 1]
    good = np.zeros(len(codes), dtype=bool)
    good[ends] = True
    used = np.unique(np.concatenate([codes[ends - 1], codes[ends]]))
    if len(used):
        named = pa.array([words.texts[i] for i in used.tolist()], pa.binary())
        yield _of_languages(words, words.lang_of[used].tolist(), ids[used], np.zeros(len(used), np.int64), word=named)
    # Phrases that end at a word are numbered by the phrase one word shorter and the word.
    number = np.zeros(len(codes), dtype=np.int64)
    found, number[ends] = np.unique(codes[ends - 1] * len(ids) + codes[ends], return_inverse=True)
    members = [found // max(1, len(ids)), found % max(1, len(ids))]
    for length in range(3, longest + 1):
        ends = ends[(ends > 0) & good[ends - 1]] if length == 3 else ends[reached[ends - 1]]
        reached = np.zeros(len(codes), dtype=bool)
        reached[ends] = True
        keys = number[ends - 1] * len(ids) + codes[ends]
        found, inverse = np.unique(keys, return_inverse=True)
        n = np.bincount(inverse, weights=words.fresh[ends], minlength=len(found)).astype(np.int64)
        heads = [m[found // max(1, len(ids))] for m in members]
        members = [*heads, found % max(1, len(ids))]
        counted = n > 0
        yield _striped([ids[h[counted]] for h in heads], ids[members[-1][counted]], n[counted])
        number = np.zeros(len(codes), dtype=np.int64)
        number[ends] = inverse


def _scan(docs: DataFrame, stripes, chunk: int) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE))

    def run(batches):
        for batch in batches:
            for piece in text_slices(batch, most=chunk):
                for words in chunked(utf8_of(piece), utf8_of(piece, "lang"), chunk):
                    yield from (rows for rows in stripes(words) if rows.num_rows)

    return docs.select("text", lang.alias("lang")).mapInArrow(run, _STRIPES)


def merged(stripes: DataFrame, least: int) -> DataFrame:
    """``lang, word, prefix, next, n`` of the entries of merged stripes with ``least`` occurrences.

    Rows with a language are totals of it, or texts of words, and all stay.
    """
    entries = stripes.select("lang", "word", "prefix", F.inline(F.arrays_zip("next", "n")))
    return (
        entries.groupBy("lang", "word", "prefix", "next")
        .agg(F.sum("n").alias("n"))
        .where(F.col("lang").isNotNull() | (F.col("n") >= least))
    )


def pair_filter(pairs: DataFrame, bits: int) -> np.ndarray:
    """A bit field that holds every pair ``prefix, next``; its size depends on ``bits`` alone."""

    def places(batches):
        for batch in batches:
            first = batch.column("first").to_numpy(zero_copy_only=False)
            second = batch.column("second").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(filter_places(first, second, bits).astype(np.int64))], names=["at"])

    at = pairs.select(F.col("prefix")[0].alias("first"), F.col("next").alias("second")).mapInArrow(places, "at BIGINT")
    cells = at.groupBy(F.shiftright("at", 5).alias("cell")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(at & 31 AS INT))")).alias("set")
    )
    found = cells.toArrow()
    passes = np.zeros(bits // 32, dtype=np.uint32)
    passes[found.column("cell").to_numpy()] = found.column("set").to_numpy().astype(np.uint32)
    return passes.view(np.uint8)


def frequent_phrases(docs: DataFrame, least: int, longest: int, bits: int, chunk: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``words, n`` of all phrases, ``id, lang, word`` of their words, and ``lang, n`` of the languages."""
    short = materialize(merged(_scan(docs, short_stripes, chunk), least))
    totals = short.where("lang is not null").select("lang", "n")
    single = short.where("lang is null").select("prefix", "next", "n")
    passes = Shared(docs.sparkSession, pair_filter(single.where(F.size("prefix") == 1), bits))

    def stripes(words):
        return long_stripes(words, passes.value, bits, longest)

    long = materialize(merged(_scan(docs, stripes, chunk), least))
    phrases = single.unionByName(long.where("lang is null").select("prefix", "next", "n"))
    texts = long.where("lang is not null").select(F.col("next").alias("id"), "lang", F.decode("word", "utf-8").alias("word"))
    return phrases.select(F.concat("prefix", F.array("next")).alias("words"), "n"), texts, totals


def lowest_cuts(phrases: DataFrame) -> DataFrame:
    """``words, a, l, r, score`` of every phrase of two and more words at its lowest-scoring cut."""
    size = F.size("words")
    cuts = phrases.where(size > 1).select(
        "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k")
    )
    ends = cuts.select("*", F.slice("words", F.lit(1), F.col("k")).alias("head"), F.slice("words", F.col("k") + 1, size).alias("rest"))
    left = phrases.select(F.col("words").alias("head"), F.col("n").alias("l"))
    right = phrases.select(F.col("words").alias("rest"), F.col("n").alias("r"))
    score = F.expr("(2000000 * CAST(a AS DECIMAL(20, 0))) div (CAST(l AS DECIMAL(20, 0)) + r)")
    scored = ends.join(left, "head").join(right, "rest").withColumn("score", score)
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    return scored.groupBy("words", "a").agg(lowest).select("words", "a", "cut.l", "cut.r", "cut.score")


def subsuming(phrases: DataFrame) -> DataFrame:
    """``words, most``: the largest count of a phrase that is one word longer on either side."""
    size = F.size("words")
    longer = phrases.where(size > 2).select(
        F.explode(F.array(F.slice("words", F.lit(1), size - 1), F.slice("words", F.lit(2), size - 1))).alias("words"), "n"
    )
    return longer.groupBy("words").agg(F.max("n").alias("most"))


def collocations(
    docs: DataFrame,
    least: int = LEAST,
    longest: int = LONGEST,
    percent: int = PERCENT,
    top: int = TOP,
    bits: int = FILTER_BITS,
    chunk: int = CHUNK,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language of ``text, lang``.

    A phrase has at least ``least`` occurrences. It is dropped if a longer one
    around it has ``percent`` of its occurrences. ``longest`` is at most 4.
    """
    phrases, texts, totals = frequent_phrases(docs, least, longest, bits, chunk)
    scored = lowest_cuts(phrases)
    most = subsuming(phrases)
    covered = 100 * F.col("most").cast("decimal(38,0)") >= percent * F.col("a").cast("decimal(38,0)")
    kept = scored.join(most, "words", "left").where(~F.coalesce(covered, F.lit(False))).drop("most")
    named = (
        kept.select("*", F.posexplode("words").alias("at", "id"))
        .join(texts, "id")
        .groupBy("words", "lang", "a", "l", "r", "score")
        .agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("named"))
        .withColumn("phrase", F.array_join(F.col("named.word"), " "))
    )
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salted = named.withColumn("salt", F.pmod(F.xxhash64("words"), F.lit(SALTS)))
    firsts = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    ranked = firsts.withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrase_stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), split AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), starts AS (
    SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split
), grams AS (
    SELECT lang, w[i:i + size - 1] AS words FROM starts, (SELECT unnest([1, 2, 3, 4]) AS size)
    WHERE i + size - 1 <= len(w)
), f AS (
    SELECT lang, words, count(*) AS n FROM grams GROUP BY ALL
), totals AS (
    SELECT lang, sum(n)::BIGINT AS n FROM f WHERE len(words) = 1 GROUP BY lang
), candidates AS (
    SELECT lang, words, n AS a FROM f WHERE len(words) > 1 AND n >= 30
), cuts AS (
    SELECT lang, words, a, unnest(range(1, len(words))) AS k FROM candidates
), scored AS (
    SELECT c.lang, c.words, c.a, c.k, x.n AS l, y.n AS r,
        (2000000::HUGEINT * c.a) // (x.n::HUGEINT + y.n) AS score
    FROM cuts c
    JOIN f x ON x.lang = c.lang AND x.words = c.words[1:c.k]
    JOIN f y ON y.lang = c.lang AND y.words = c.words[c.k + 1:]
), lowest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1
), parts AS (
    SELECT c.lang, c.words, c.a, unnest(range(1, len(c.words))) AS size FROM candidates c
), inner_parts AS (
    SELECT lang, a, size, words, unnest(range(1, len(words) - size + 2)) AS i FROM parts WHERE size > 1
), covers AS (
    SELECT lang, words[i:i + size - 1] AS words, max(a) AS most FROM inner_parts GROUP BY ALL
), kept AS (
    SELECT l.* FROM lowest l LEFT JOIN covers c ON c.lang = l.lang AND c.words = l.words
    WHERE c.most IS NULL OR 100::HUGEINT * c.most < 80::HUGEINT * l.a
), ranked AS (
    SELECT *, array_to_string(words, ' ') AS phrase FROM kept
)
SELECT r.lang, row_number() OVER (PARTITION BY r.lang ORDER BY r.score DESC, r.a DESC, r.phrase) AS rank,
    r.phrase, r.a, r.l, r.r, t.n, r.score::BIGINT AS score
FROM ranked r JOIN totals t USING (lang)
QUALIFY rank <= 2000
"""
