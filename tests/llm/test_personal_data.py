"""Personal data: patterns against plain expressions, the network against sums over all paths."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourtally.llm import personal_data as personal
from hourtally.llm.bilstm_crf import Tagger
from hourtally.llm.queries import QUERIES

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for at, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = kind == "email"
            if kind == "ip":
                good = all(int(x) <= 255 for x in m[0].split("."))
            elif kind == "card":
                doubled = [sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))]
                good = 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
            elif kind == "phone":
                good = 9 <= len(digits) <= 15
            if good:
                out.append((m.start(), at, m.end(), kind))
    return [(kind, start, end) for start, _, end, kind in sorted(out)]


def some_texts(seed, many=300):
    random.seed(seed)
    parts = [
        "a@b.c", "x.y_z@mail.example.com", "@", ".", "-", " ", "word", "é", "🙂", "1", "12", "255", "256", "1.2.3.4", "010.000001.3.4",
        "4111 1111 1111 1111", "4111111111111111", "49927398716", "+1 (319) 555-5132", "+", "(", ")", "\n", "5500-0000-0000-0004", "+49.30-1234567)", "%+", "٣",
    ]
    return ["".join(random.choices(parts, k=random.randint(0, 25))) for _ in range(many)]


def test_patterns_equal_plain_expressions():
    for text in some_texts(1, 3000):
        assert personal.pattern_spans(text) == plain_spans(text), text


def test_patterns_are_linear_on_long_runs():
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "a@" * 200_000, "+1" * 200_000, "a.b@c." * 80_000):
        personal.pattern_spans(text)


def small_tagger(seed=0):
    allowed, first = np.ones((3, 3), dtype=bool), np.array([True, True, False])
    allowed[0, 2] = False
    return Tagger.start(5, 3, 4, allowed, first, seed)


def test_loss_and_decoding_equal_sums_over_all_paths():
    tagger = small_tagger()
    tagger.parameters["turn"] += np.random.default_rng(1).normal(0, 1, (3, 3)).astype(np.float32)
    codes = np.array([[1, 2, 3, 4, 2], [3, 1, 1, 0, 0]])
    tags = np.array([[0, 1, 2, 0, 1], [1, 2, 2, 0, 0]])
    scores, _ = tagger._emissions(codes)
    turns = tagger._turns()
    best, sure = tagger.decode(codes)
    losses = []
    for w in range(2):
        value = {
            path: sum(float(scores[t, w, k]) for t, k in enumerate(path)) + sum(float(turns[a, b]) for a, b in zip(path, path[1:]))
            for path in itertools.product(range(3), repeat=5)
        }
        total = np.log(sum(np.exp(v) for v in value.values()))
        losses.append(total - value[tuple(tags[w])])
        top = max(value, key=value.get)
        assert tuple(best[w]) == top
        for t in range(5):
            share = sum(np.exp(v - total) for path, v in value.items() if path[t] == top[t])
            assert sure[w, t] == pytest.approx(share, abs=1e-4)
    assert tagger.loss(codes, tags)[0] == pytest.approx(np.mean(losses), rel=1e-4)


def test_slopes_equal_differences():
    tagger = small_tagger(3)
    tagger.parameters = {k: v.astype(np.float64) for k, v in tagger.parameters.items()}
    codes = np.array([[1, 2, 3, 4], [3, 1, 0, 0], [2, 2, 2, 2]])
    tags = np.array([[0, 1, 2, 0], [1, 2, 0, 0], [0, 0, 1, 1]])
    _, slopes = tagger.loss(codes, tags)
    for name, values in tagger.parameters.items():
        for at in random.Random(1).sample(list(np.ndindex(values.shape)), min(6, values.size)):
            if name == "turn" and not tagger.allowed[at]:
                continue
            old = values[at]
            values[at] = old + 1e-2
            up = tagger.loss(codes, tags)[0]
            values[at] = old - 1e-2
            down = tagger.loss(codes, tags)[0]
            values[at] = old
            assert slopes[name][at] == pytest.approx((up - down) / 2e-2, abs=2e-3), (name, at)


def test_reconciling_joins_cut_pieces_and_takes_the_heaviest_choice():
    pieces = [
        (0, 10, 48, 0.9, False, True), (0, 24, 60, 0.8, True, False),  # cut by a border
        (1, 30, 44, 0.99, False, False),  # overlaps, lighter
        (2, 70, 80, 0.9, False, False), (2, 70, 80, 0.95, False, False),  # seen twice
        (3, 90, 95, 0.9, True, False),  # no beginning
    ]
    assert personal.reconciled(pieces, 96) == [(0, 10, 60, 0.8), (2, 70, 80, 0.95)]
    assert personal.reconciled([], 96) == []
    random.seed(5)
    for _ in range(60):
        spans = [(0, s, s + random.randint(1, 9), random.random(), False, False) for s in random.sample(range(30), 7)]
        weight = lambda chosen: sum(s[3] * (s[2] - s[1]) for s in chosen)
        fits = [
            c for n in range(8) for c in itertools.combinations(spans, n)
            if all(a[2] <= b[1] or b[2] <= a[1] for a, b in itertools.combinations(c, 2))
        ]
        assert weight(personal.reconciled(spans, 96)) == pytest.approx(max(map(weight, fits)))


@pytest.fixture(scope="module")
def tagger(spark):
    random.seed(8)
    number = lambda n: "".join(random.choices("0123456789", k=n))
    word = lambda: "".join(random.choices(["th", "on", "er", "re", "qu", "é"], k=random.randint(1, 4)))

    def card():
        digits = "4" + number(14)
        return next(digits + d for d in "0123456789" if personal.luhn(digits + d))

    makers = [
        lambda: f"{word()}.{number(2)}@mail{number(1)}.example.com",
        lambda: ".".join(str(random.randint(1, 254)) for _ in range(4)),
        card,
        lambda: f"+1 ({number(3)}) 555-{number(4)}",
        lambda: number(random.randint(1, 4)),
    ]
    rows = [(" ".join([*(word() for _ in range(random.randint(0, 9))), random.choice(makers)(), *(word() for _ in range(9))]),) for _ in range(900)]
    return personal.fit(spark.createDataFrame(rows, "text string"), samples=150, rounds=8)


def test_model_learns_the_spans_it_was_shown(spark, tagger):
    texts = ["thor onder qwe.12@mail3.example.com reth the", "enea +1 (372) 555-8417 shon", "was in 12.44.201.9 ander", "er 4532015112830366 stion"]
    for text, spans in zip(texts, personal.tagged(texts, tagger, personal.WINDOW)):
        (expected,) = personal.pattern_spans(text)
        assert [(personal.KINDS[k], s, e) for k, s, e, _ in spans] == [expected]
    # A typing error that no pattern takes, and a number in prose that is none.
    found = personal.tagged(["tion erou 12.44.1201.9 the ander on", "onre the year 1999 was thent"], tagger, personal.WINDOW)
    assert [s[:3] for s in found[0]] == [(1, 10, 22)]
    assert found[1] == []


def test_query_equals_plain_search(spark, sf_dir, texts):
    rows = QUERIES["op12_personal_data"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for row in rows:
        base = plain_spans(texts[row["doc_id"]] or "")
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert row["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [row[f"n_{k}"] for k in personal.KINDS] == [sum(s[0] == k for s in base) for k in personal.KINDS]
        assert set(filter(None, joined.split(","))) <= set(row["spans"].split(","))


def test_odd_rows(spark, odd_docs, no_docs, tagger):
    rows = personal.personal_data(odd_docs, tagger).collect()
    assert len(rows) == odd_docs.count()
    assert personal.personal_data(no_docs, tagger).count() == 0
    assert personal.fit(no_docs) is None
    assert personal.personal_data(odd_docs, None).where("size(added) > 0").count() == 0
    masked = personal.mask(odd_docs.withColumn("text", F.concat("text", F.lit(" a@b.cd!"))), tagger)
    assert masked.columns == odd_docs.columns
    for row in masked.collect():
        assert row["text"] is None or row["text"].endswith("[email]!")
    assert personal.masked_text("xx 1.2.3.4 yy", [("ip", 3, 10), ("card", 5, 12)]) == "xx [ip]y"
