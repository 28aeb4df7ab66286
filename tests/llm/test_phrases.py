"""Collocations against a brute-force count."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from hourtally.llm import phrase_stripes as phrases


def brute_counts(rows):
    """Counts of phrases of one to four words of each language."""
    counts = Counter()
    for text, lang in rows:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    counts[(lang or "und", tuple(words[i : i + size]))] += 1
    return counts


def brute_collocations(rows, least, percent, top):
    counts = brute_counts(rows)
    totals = Counter()
    for (lang, words), n in counts.items():
        totals[lang] += n if len(words) == 1 else 0
    candidates = {key: n for key, n in counts.items() if len(key[1]) > 1 and n >= least}
    found = []
    for (lang, words), a in candidates.items():
        covered = any(
            other == lang
            and len(longer) > len(words)
            and any(longer[i : i + len(words)] == words for i in range(len(longer) - len(words) + 1))
            and 100 * n >= percent * a
            for (other, longer), n in candidates.items()
        )
        if not covered:
            cuts = []
            for k in range(1, len(words)):
                l, r = counts[lang, words[:k]], counts[lang, words[k:]]
                cuts.append((2_000_000 * a // (l + r), k, l, r))
            score, _, l, r = min(cuts)
            found.append((lang, " ".join(words), a, l, r, totals[lang], score))
    out = []
    for lang in sorted({row[0] for row in found}):
        own = sorted((r for r in found if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(r[0], i + 1, *r[1:]) for i, r in enumerate(own[:top])]
    return out


def collected(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def some_rows(seed, many=400):
    random.seed(seed)
    words = ["the", "New", "york", "times", "of", "é", "日本", "x\x0by", "a-b", "times.", "Of,", "…", "\x1c", "zz!"]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = []
    for _ in range(many):
        text = random.choice((" ", "\t", "  ")).join(random.choices(words, weights, k=random.randint(0, 40)))
        rows.append((text + random.choice(("", "\n", " New York Times", ";")), random.choice(("en", "fr", None))))
    return rows + [(None, "en"), ("", None), ("...", "de"), (" " * 50, "de"), ("alone", "xx")]


@pytest.mark.parametrize("bits", [1 << 26, 64])
def test_collocations_equal_brute_force(spark, bits):
    rows = some_rows(1)
    docs = spark.createDataFrame(rows, "text string, lang string")
    found = phrases.collocations(docs, least=8, top=40, bits=bits)
    expected = brute_collocations(rows, 8, 80, 40)
    assert len(expected) > 60
    assert collected(found) == sorted(expected)


def test_long_texts_are_cut_between_words(spark):
    rows = some_rows(2, 60)
    rows = [(" ".join(t or "" for t, _ in rows), "en"), ("word " * 3000, "en"), ("w" * 20_000 + " word word", "en"), ((" " * 1500).join("abcab" * 40), None)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    found = phrases.collocations(docs, least=3, chunk=700)
    assert collected(found) == sorted(brute_collocations(rows, 3, 80, 2000))


def test_odd_rows(odd_docs, no_docs):
    rows = [(r["text"], r["lang"]) for r in odd_docs.collect()]
    expected = sorted(brute_collocations(rows, 2, 80, 2000))
    assert collected(phrases.collocations(odd_docs, least=2)) == expected
    assert phrases.collocations(no_docs).count() == 0


def test_scores_of_counts_beyond_64_bits(spark):
    big = 9_000_000_000_000_000_000
    rows = [([1], big), ([2], big), ([1, 2], big)]
    scored = phrases.lowest_cuts(spark.createDataFrame(rows, "words array<bigint>, n bigint")).first()
    assert (scored["a"], scored["score"]) == (big, 1_000_000)


def test_filter_holds_every_pair(spark):
    pairs = spark.createDataFrame([([i * 7919 - 10**12], -i * 104729) for i in range(500)], "prefix array<bigint>, next bigint")
    passes = phrases.pair_filter(pairs, 1 << 16)
    import numpy as np

    at = phrases.filter_places(np.array([i * 7919 - 10**12 for i in range(500)]), np.array([-i * 104729 for i in range(500)]), 1 << 16)
    bits = np.unpackbits(passes, bitorder="little")
    assert bits[at.astype(int)].all() and bits.sum() == len(np.unique(at))
