"""Personal data in text: patterns for four kinds, and what a character tagger adds.

The patterns find e-mail addresses, IP addresses, card and telephone numbers.
Their spans, right or wrong ones told apart by checks such as Luhn's, label the
windows that train a bidirectional LSTM under a CRF (``bilstm_crf``); the model
then tags every window of every text. Its spans are added where they do not
touch a pattern's, so variants that the patterns miss are found as well.

A span holds a digit or an ``@``, so only windows with one are tagged: all other
windows cannot hold a span. Windows overlap by half. Their spans are reconciled
over the whole text: pieces of one kind that two windows cut at their borders
are joined, equal spans keep the surer reading, and of spans that overlap the
choice with the largest sum of probability times length stays.

The fit uses at most ``samples`` windows of each kind and as many without a
span, those with the least hashes of all windows of the corpus. Its labels come
from the patterns alone; the table of labels is not read.

Defined results: null texts are empty, texts without words have no spans. Rows
with equal ids are rows of their own. Offsets are code points, ends exclusive.
Texts of any length are tagged in batches of windows; a span longer than
a window is none. Without any span in the corpus there is no model and the patterns
stand alone. Further columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hourtally.llm.bilstm_crf import Tagger, train
from hourtally.llm.common import Shared, hash64, read_table, text_slices

KINDS = ("email", "ip", "card", "phone")
WINDOW = 96
SAMPLES = 700  # windows of each kind in the fit
HIDDEN = 24
ROUNDS = 6
SURE = 0.95  # least probability of every character of a span that is added
BATCH = 256  # windows tagged at once

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")

# Classes of characters: 0 pads, other letters and signs share one, as do digits and each case.
_CLASSES = np.arange(1, 130)
_CLASSES[ord("0") : ord("9") + 1] = _CLASSES[ord("0")]
_CLASSES[ord("A") : ord("Z") + 1] = _CLASSES[ord("A")]
_CLASSES[ord("a") : ord("z") + 1] = _CLASSES[ord("a")]

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the address pattern, found from their ``@`` so that no run is read twice."""
    end, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                end = domain.end()
                yield start, end
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(map(int, reversed(digits))):
        total += digit if i % 2 == 0 else 2 * digit - 9 * (digit > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _is_ip(text: str) -> bool:
    return all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in text.split("."))


def _is_card(text: str) -> bool:
    if len(text) > 40:
        return False
    digits = _digits(text)
    return 12 <= len(digits) <= 19 and luhn(digits)


def _is_phone(text: str) -> bool:
    return 9 <= len(_digits(text)) <= 15


def pattern_spans(text: str) -> list[Span]:
    """The valid matches of every kind by start, then kind."""
    if not _MARK.search(text):
        return []
    found = [("email", *span) for span in _emails(text)]
    for kind, pattern, valid in (("ip", _IP, _is_ip), ("card", _CARD, _is_card), ("phone", _PHONE, _is_phone)):
        found += [(kind, *m.span()) for m in pattern.finditer(text) if valid(m[0])]
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def window_starts(text: str, width: int) -> list[int]:
    """Where windows with a digit or ``@`` begin; windows overlap by half."""
    half, starts = width // 2, []
    for mark in _MARK.finditer(text):
        for at in (mark.start() // half - 1, mark.start() // half):
            if at >= 0 and (not starts or at > starts[-1]):
                starts.append(at)
    return [at * half for at in starts]


def window_codes(texts: list[str], width: int) -> np.ndarray:
    """The character classes of windows, padded with 0."""
    points = np.frombuffer("".join(t.ljust(width, "\0") for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = _CLASSES[np.minimum(points, 128)].reshape(len(texts), width)
    for row, text in zip(codes, texts):
        row[len(text) :] = 0
    return codes


def window_tags(spans: list[Span], start: int, width: int) -> np.ndarray:
    """0, or 1 + 2 * kind at the first character of a span and 2 + 2 * kind at the others."""
    tags = np.zeros(width, dtype=np.int64)
    for kind, first, last in spans:
        inside = slice(max(first - start, 0), max(last - start, 0))
        if not tags[inside].any():
            tags[inside] = 2 + 2 * KINDS.index(kind)
            if 0 <= first - start < width:
                tags[first - start] -= 1
    return tags


def allowed_turns() -> np.ndarray:
    """A span's inner tags follow a tag of the same kind."""
    tags = 1 + 2 * len(KINDS)
    allowed = np.ones((tags, tags), dtype=bool)
    for k in range(len(KINDS)):
        allowed[:, 2 + 2 * k] = False
        allowed[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return allowed


def labelled_windows(docs: DataFrame, width: int, samples: int) -> DataFrame:
    """``kind, hash, text, tags``: for each kind, and for none, the windows with the least hashes."""

    def run(batches):
        for batch in batches:
            rows = []
            for piece in text_slices(batch):
                for text in piece.column("text").to_pylist():
                    spans = pattern_spans(text or "")
                    for start in window_starts(text or "", width):
                        # Spans of a window; a card and an address may share characters, the earlier kind labels them.
                        own = [s for s in spans if s[1] < start + width and s[2] > start]
                        part = text[start : start + width]
                        kind = min((KINDS.index(s[0]) for s in own), default=len(KINDS))
                        tags = window_tags(own, start, width).tolist()
                        rows.append((kind, hash64(part.encode("utf-8", "surrogatepass")) >> 1, part, tags))
            if rows:
                arrays = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int32())))]
                yield pa.RecordBatch.from_arrays(arrays, names=["kind", "hash", "text", "tags"])

    windows = docs.select("text").mapInArrow(run, "kind INT, hash BIGINT, text STRING, tags ARRAY<INT>")
    least = Window.partitionBy("kind").orderBy("hash", "text", "tags")
    return windows.withColumn("rank", F.row_number().over(least)).where(F.col("rank") <= samples).drop("rank")


def fit(docs: DataFrame, samples: int = SAMPLES, width: int = WINDOW, hidden: int = HIDDEN, rounds: int = ROUNDS) -> Tagger | None:
    """A tagger fitted to windows labelled by the patterns; ``None`` without any span."""
    rows = sorted(labelled_windows(docs, width, samples).collect(), key=lambda r: (r["hash"], r["text"], r["tags"]))
    if not any(row["kind"] < len(KINDS) for row in rows):
        return None
    codes = window_codes([row["text"] for row in rows], width)
    tags = np.array([row["tags"] for row in rows], dtype=np.int64)
    first = np.ones(1 + 2 * len(KINDS), dtype=bool)  # a window may begin inside a span
    tagger = Tagger.start(130, 1 + 2 * len(KINDS), hidden, allowed_turns(), first, seed=1)
    return train(tagger, codes, tags, rounds, batch=64, rate=0.02, seed=1)


def spans_of_tags(tags: np.ndarray, sure: np.ndarray) -> list[tuple[int, int, int, float]]:
    """``kind, start, end, probability`` of the spans of a window; the least sure character counts."""
    found, at = [], np.flatnonzero(tags)
    i = 0
    while i < len(at):
        start = at[i]
        kind = (tags[start] - 1) // 2
        end = start + 1
        while end < len(tags) and tags[end] == 2 + 2 * kind:
            end += 1
        found.append((int(kind), int(start), int(end), float(sure[start:end].min())))
        i += end - start
    return found


def reconciled(pieces: list[tuple[int, int, int, float, bool, bool]], width: int) -> list[tuple[int, int, int, float]]:
    """One choice for a whole text from the spans of all its windows.

    Pieces have ``kind, start, end, probability`` and whether a window's border
    cut them on the left and on the right.
    """
    whole = {}
    running: dict[int, list] = {}  # by kind, a span that a border cut
    for kind, start, end, sure, cut_left, cut_right in sorted(pieces):
        known = running.get(kind)
        if cut_left and known and start <= known[1]:
            start, sure = known[0], min(known[2], sure)
        elif cut_left:
            continue  # its beginning was no span for the window that saw it
        running.pop(kind, None)
        if cut_right:
            running[kind] = [start, end, sure]
        else:
            whole[kind, start, end] = max(sure, whole.get((kind, start, end), 0.0))
    spans = sorted((end, start, kind, sure) for (kind, start, end), sure in whole.items() if end - start <= width)
    # The heaviest choice of spans that do not overlap.
    ends = np.array([s[0] for s in spans])
    value, taken = [0.0], []
    for i, (end, start, _, sure) in enumerate(spans):
        before = int(np.searchsorted(ends[:i], start, side="right"))
        with_it = value[before] + sure * (end - start)
        taken.append((with_it > value[i], before))
        value.append(max(with_it, value[i]))
    chosen, i = [], len(spans)
    while i:
        take, before = taken[i - 1]
        if take:
            end, start, kind, sure = spans[i - 1]
            chosen.append((kind, start, end, sure))
        i = before if take else i - 1
    return chosen[::-1]


def tagged(texts: list[str], tagger: Tagger, width: int) -> list[list[tuple[int, int, int, float]]]:
    """The model's spans of every text."""
    places = [(i, start) for i, text in enumerate(texts) for start in window_starts(text, width)]
    pieces: list[list] = [[] for _ in texts]
    for begin in range(0, len(places), BATCH):
        part = places[begin : begin + BATCH]
        tags, sure = tagger.decode(window_codes([texts[i][start : start + width] for i, start in part], width))
        for row in np.flatnonzero(tags.any(axis=1)).tolist():
            i, start = part[row]
            for kind, first, last, probability in spans_of_tags(tags[row], sure[row]):
                last = min(last, len(texts[i]) - start)
                cut_left = first == 0 and start > 0 and tags[row][0] == 2 + 2 * kind
                cut_right = last == width and start + width < len(texts[i])
                pieces[i].append((kind, start + first, start + last, probability, cut_left, cut_right))
    return [reconciled(p, width) for p in pieces]


def added_spans(text: str, base: list[Span], model: list[tuple[int, int, int, float]], sure: float) -> list[Span]:
    """The model's spans that are sure, hold what their kind needs and touch no pattern's span."""
    found = []
    for kind, start, end, probability in model:
        part = text[start:end]
        needs = "@" in part if KINDS[kind] == "email" else any("0" <= c <= "9" for c in part)
        if probability >= sure and needs and not any(b[1] < end and start < b[2] for b in base):
            found.append((KINDS[kind], start, end))
    return found


def text_spans(texts: list[str], tagger: Tagger | None, sure: float, width: int) -> list[tuple[list[Span], list[Span]]]:
    """The patterns' spans and the added ones of every text."""
    base = [pattern_spans(t) for t in texts]
    model = tagged(texts, tagger, width) if tagger else [[]] * len(texts)
    return [(b, added_spans(t, b, m, sure)) for t, b, m in zip(texts, base, model)]


def personal_data(docs: DataFrame, tagger: Tagger | None, sure: float = SURE, width: int = WINDOW) -> DataFrame:
    """``doc_id, base, added`` for every row of ``doc_id, text``: arrays of ``kind, start, end``."""
    model = Shared(docs.sparkSession, tagger)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        loaded = model.value
        for batch in batches:
            for piece in text_slices(batch):
                found = text_spans([t or "" for t in piece.column("text").to_pylist()], loaded, sure, width)
                columns = [
                    pa.array([[dict(zip(span.names, s)) for s in row] for row in side], pa.list_(span)) for side in zip(*found)
                ]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(pa.int64()), *columns], names=["doc_id", "base", "added"])

    spans = "ARRAY<STRUCT<kind: STRING, start: BIGINT, end: BIGINT>>"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id BIGINT, base {spans}, added {spans}")


def masked_text(text: str, spans: list[Span]) -> str:
    """A text with every span replaced by its kind in brackets; of spans that overlap the first to begin names the place."""
    parts, at = [], 0
    for kind, start, end in in_order(spans):
        if start >= at:
            parts += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(parts) + text[at:]


def mask(docs: DataFrame, tagger: Tagger | None, sure: float = SURE, width: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns, with the personal data in ``text`` masked; null stays null."""
    model = Shared(docs.sparkSession, tagger)
    at = docs.columns.index("text")

    def run(batches):
        loaded = model.value
        for batch in batches:
            for piece in text_slices(batch):
                texts = piece.column(at).to_pylist()
                found = text_spans([t or "" for t in texts], loaded, sure, width)
                new = [t and masked_text(t, [*base, *added]) for t, (base, added) in zip(texts, found)]
                yield piece.set_column(at, piece.schema.names[at], pa.array(new, piece.schema.types[at]))

    return docs.mapInArrow(run, docs.schema)


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of spans by start, then kind, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(kinds, s["kind"]).alias("at"), s["end"].alias("end"), s["kind"].alias("kind")))
    texts = F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(texts, ",")


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = personal_data(docs, fit(docs))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *map(count, KINDS),
        F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
        spans_text(F.concat("base", "added")).alias("spans"),
    )
