"""Exact and near duplicates against brute force."""

from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from hourtally.llm import exact_dedup as exact
from hourtally.llm import minhash_join as near
from hourtally.llm.components import components
from hourtally.llm.queries import QUERIES


def brute_sets(texts, length):
    out = {}
    for i, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out[i] = {tuple(words[j : j + length]) for j in range(max(1, len(words) - length + 1))} if words else set()
    return out


def brute_components(sets):
    label = {i: i for i in sets}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                label[q] = p
    return {i: find(i) for i in ids}


def test_exact_groups_of_odd_rows(odd_docs):
    rows = exact.exact_groups(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_text = {}
    for row in odd_docs.collect():
        by_text.setdefault(row["text"] or "", []).append(row["doc_id"])
    for row in rows:
        group = next(g for t, g in by_text.items() if hashlib.sha256(t.encode()).digest() == bytes(row["digest"]) and row["doc_id"] in g)
        assert row["group_size"] == len(group)
        assert row["keep_id"] == max((i for i in group if i is not None), default=None)
    assert sum(row["kept"] for row in rows) == len(by_text)


def test_equal_digests_of_different_texts_stay_apart(odd_docs):
    weak = lambda text: F.substring(F.unhex(F.sha2(text, 256)), 1, 0)  # noqa: E731  one digest for all
    with_weak = exact.exact_groups(odd_docs.where("doc_id is not null"), weak, salts=3)
    plain = exact.exact_groups(odd_docs.where("doc_id is not null"))
    columns = ["doc_id", "keep_id", "group_size"]
    assert sorted(map(tuple, with_weak.select(columns).collect())) == sorted(map(tuple, plain.select(columns).collect()))
    assert with_weak.where("kept").count() == plain.where("kept").count()


def test_copies_of_groups_are_not_broadcast(spark):
    """Spark sees the file of the groups and not their copies, which the driver would have to hold."""
    rows = [(i, f"text {i % 60}") for i in range(180)] + [(200 + i, f"alone {i}") for i in range(20)]
    found = exact.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in found.collect()} == {
        (i, 120 + i % 60, 3, i >= 120) for i in range(180)
    } | {(200 + i, 200 + i, 1, True) for i in range(20)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") not in ("-1", "0")


def test_dropping_exact_duplicates_keeps_columns_and_nulls(odd_docs, no_docs):
    kept = exact.drop_exact_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = kept.collect()
    assert len(rows) == len({r["text"] or "" for r in odd_docs.collect()})
    assert {r["doc_id"] for r in rows} == {2, 3, 6, 7, 8, 10, 11, 12, 13}
    assert next(r for r in rows if r["doc_id"] == 2)["text"] == ""
    assert exact.drop_exact_duplicates(no_docs).count() == 0 == exact.exact_groups(no_docs).count()


def test_components_of_random_links(spark):
    random.seed(2)
    links = [(random.randrange(400), random.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1040)]
    found = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    label = {i: i for pair in links for i in pair}
    for _ in range(60):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert found == {i: x for i, x in label.items() if any(i in p and p[0] != p[1] for p in links)}


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    rows = near.near_duplicates(odd_docs, shingle_words=4).collect()
    assert len(rows) == odd_docs.count()
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is not None}
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect() if r["doc_id"] is not None}
    sets = brute_sets(texts, 4)
    want = brute_components(sets)
    assert found == {i: (len(sets[i]), want[i]) for i in texts}
    assert all(r["component_id"] is None for r in rows if r["doc_id"] is None)
    kept = near.drop_near_duplicates(odd_docs, shingle_words=4)
    assert kept.columns == odd_docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i in texts if want[i] == i} | {None}
    assert near.near_duplicates(no_docs).count() == 0


def test_near_duplicates_of_edited_copies(spark):
    """A large group of copies with ever more changes, so that many pairs lie near the threshold."""
    random.seed(9)
    base = [f"w{random.randrange(500)}" for _ in range(140)]
    texts = {}
    for i in range(160):
        words = list(base)
        for _ in range(random.randrange(0, 9)):
            at = random.randrange(len(words))
            words[at : at + 1] = random.choice(([], [f"n{random.randrange(10**6)}"], [words[at], "the"]))
        texts[i] = " ".join(words)
    for i in range(160, 200):
        texts[i] = " ".join(f"w{random.randrange(500)}" for _ in range(60)) + " " + " ".join(base[:50])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute_components(brute_sets(texts, 4))
    for hubs in (1, 3):
        found = near.near_duplicates(docs, shingle_words=4, hubs=hubs).collect()
        assert {r["doc_id"]: r["component_id"] for r in found} == want


def group_of_near_copies(many, seed=4):
    """Copies of one text with one to six words replaced: alike, and only partly linked."""
    random.seed(seed)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(many):
        words = list(base)
        for at in random.sample(range(150), random.choice((1, 1, 2, 3, 4, 5, 6))):
            words[at] = f"n{random.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    return rows


def test_pairs_of_near_copies_grow_with_their_group(spark, monkeypatch):
    pairs = []
    real = near.confirmed
    monkeypatch.setattr(near, "confirmed", lambda found, *rest: pairs.append(found.count()) or real(found, *rest))
    totals = []
    for many in (300, 600, 1200):
        pairs.clear()
        found = near.near_duplicates(spark.createDataFrame(group_of_near_copies(many), "doc_id long, text string")).collect()
        assert len(found) == many
        totals.append(sum(pairs))
    assert totals[1] < 2.6 * totals[0] and totals[2] < 2.6 * totals[1]


def test_near_copies_equal_brute_force(spark):
    rows = group_of_near_copies(250) + [(1000 + i, text + " tail of words that follows") for i, text in group_of_near_copies(60, 5)]
    want = brute_components(brute_sets(dict(rows), 5))
    for hubs in (1, 3):
        found = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), hubs=hubs).collect()
        assert {r["doc_id"]: r["component_id"] for r in found} == want


def test_one_id_with_several_texts(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(5, one), (5, two), (7, one + " end"), (8, two + " end"), (5, one), (9, "alone")]
    for order in (rows, rows[::-1]):
        found = near.near_duplicates(spark.createDataFrame(order, "doc_id long, text string").coalesce(1)).collect()
        assert sorted((r["doc_id"], r["component_id"]) for r in found) == [(5, 5), (5, 5), (5, 5), (7, 5), (8, 5), (9, 9)]


def test_queries_against_brute_force(spark, sf_dir, texts):
    sets = brute_sets(texts, 4)
    want = brute_components(sets)
    found = QUERIES["op8_minhash_near_dedup"](spark, sf_dir).collect()
    assert {tuple(r) for r in found} == {(i, len(sets[i]), want[i], want[i] == i) for i in texts}
    groups = {}
    for i, text in texts.items():
        groups.setdefault(text or "", []).append(i)
    rows = {
        (i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g
    }
    assert {tuple(r) for r in QUERIES["op5_exact_dedup"](spark, sf_dir).collect()} == rows
