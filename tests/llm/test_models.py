"""Learned operators: held-out accuracy, statistics against brute force, odd rows."""

from __future__ import annotations

import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from hourtally.llm import decision_list, gru, language_centroids, recurrent_lm, toxicity_fm
from hourtally.llm.common import Memo, text_slices
from hourtally.llm.queries import QUERIES


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_machine_learns_a_pair_that_no_weight_can():
    """Toxic exactly if one of two terms occurs without the other, which is not additive."""
    random = np.random.default_rng(1)
    texts = [[b"insult"] * a + [b"group"] * b + [b"w%d" % random.integers(50)] for a, b in random.integers(0, 2, (1200, 2))]
    y = np.array([float((b"insult" in t) == (b"group" in t) and b"insult" in t) for t in texts])
    terms, ends = toxicity_fm.distinct_terms([b" ".join(t) for t in texts], Memo(toxicity_fm.term_id))
    lengths = np.diff(ends, prepend=0)
    machine = toxicity_fm.train(terms, lengths, y, factors=4, epochs=40, seed=3)
    known = machine.ids.tolist()
    rows = np.array([known.index(t) if t in known else -1 for t in terms])
    owner = np.repeat(np.arange(len(texts)), lengths)[rows >= 0]
    raw = machine.raw(rows[rows >= 0], np.searchsorted(owner, np.arange(len(texts)), side="right"))
    assert ((raw > 0) == (y > 0)).mean() > 0.99


@pytest.mark.parametrize("pair", [lambda a, b: a != b, lambda a, b: a == b])
def test_machine_learns_pairs_of_terms_without_surprise(pair, monkeypatch):
    """Exclusive-or and its opposite: either term alone is toxic as often as any text."""
    random = np.random.default_rng(1)
    drawn = random.integers(0, 2, (2400, 2))
    texts = [b" ".join([b"insult"] * a + [b"group"] * b + [b"w%d" % w for w in random.integers(0, 50, 5)]) for a, b in drawn]
    y = np.array([float(pair(a, b)) for a, b in drawn])
    terms, ends = toxicity_fm.distinct_terms(texts, Memo(toxicity_fm.term_id))
    lengths = np.diff(ends, prepend=0)
    machine = toxicity_fm.train(terms, lengths, y, factors=8, epochs=40, seed=3)
    assert machine.ids.tolist() == sorted(set(terms.tolist()))
    raw = machine.raw(machine.places[np.searchsorted(machine.ids, terms)], ends)
    assert ((raw > 0) == (y > 0)).mean() > 0.98
    monkeypatch.setattr(toxicity_fm, "MAX_TERMS", 20)
    monkeypatch.setattr(toxicity_fm, "SHARED_ROWS", 8)
    few = toxicity_fm.train(terms, lengths, y, factors=8, epochs=1, seed=3)
    assert len(few.weights) <= 20 and few.ids.tolist() == machine.ids.tolist()


def test_scores_equal_a_plain_sum_over_pairs():
    random = np.random.default_rng(7)
    machine = toxicity_fm.Machine(np.arange(9), np.arange(9), 0.3, random.normal(size=9), random.normal(size=(9, 4)))
    texts = [[0, 3, 5], [], [8], [1, 2, 3, 4, 5, 6, 7], [2]]
    rows, ends = np.array(sum(texts, []), dtype=np.int64), np.cumsum([len(t) for t in texts])
    want = [
        0.3 + sum(machine.weights[i] for i in t) + sum(machine.factors[i] @ machine.factors[j] for i in t for j in t if i < j)
        for t in texts
    ]
    assert machine.raw(rows, ends) == pytest.approx(want)


def test_document_frequencies_and_cosines_equal_plain_ones(spark):
    texts = ["the cat", "the dog sat", "", "été", "the the", "x" * 70_000] * 3
    plain = [language_centroids.gram_counts([t])[0] for t in texts]
    held = np.sum([p > 0 for p in plain], axis=0)
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    found = language_centroids.inverse_frequencies(frame, len(texts))
    assert found == pytest.approx(np.log((1 + len(texts)) / (1 + held)) + 1, rel=1e-5)
    centroids = np.random.default_rng(3).random((3, language_centroids.DIMENSIONS)).astype(np.float32)
    centroids /= np.linalg.norm(centroids, axis=1)[:, None]
    model = language_centroids.Centroids(found, centroids, np.array([0, 1, 1]), ["a", "b"], np.zeros(3))
    names, score, _ = model.predict(texts)
    for text, counts, name, value in zip(texts, plain, names, score):
        vector = np.log1p(counts) * found
        cosines = centroids @ vector / max(np.linalg.norm(vector), 1e-12)
        assert name == (["a", "b", "b"][int(cosines.argmax())] if text else "und")
        assert value == pytest.approx(max(cosines.max(), 0) if text else 0, abs=1e-4)


def test_many_short_texts_are_cut_by_rows(spark):
    """Counts are dense, so rows are counted beside bytes."""
    rows = pa.RecordBatch.from_arrays([pa.array([""] * 10_000)], names=["text"])
    sizes = [p.num_rows for p in text_slices(rows, most=500_000, per_row=language_centroids.PER_ROW)]
    assert sum(sizes) == 10_000 and max(sizes) <= 500


def test_toxicity_on_held_out_rows(spark):
    """Insults at random places of noise; the folds are those of the query."""
    random = np.random.default_rng(2)
    docs, labels = [], []
    for i in range(1500):
        words = [f"t{random.integers(300)}" for _ in range(40)]
        toxic = int(random.random() < 0.2)
        if toxic:
            words[random.integers(40)] = f"Insult{random.integers(4)}!"
        docs.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    machine = toxicity_fm.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    score = {r["doc_id"]: r["score"] for r in toxicity_fm.toxicity_scores(docs, machine).collect()}
    held = [(score[i] >= 0.7, t) for i, _, t in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(p == t for p, t in held) / len(held) > 0.98
    kept = {r["doc_id"] for r in toxicity_fm.drop_toxic(docs, machine).collect()}
    assert kept == {i for i, s in score.items() if s < 0.7}


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs, odd_labels):
    for labels in (odd_labels, odd_labels.where("false")):
        machine = toxicity_fm.fit(odd_docs, labels)
        rows = toxicity_fm.toxicity_scores(odd_docs, machine).collect()
        assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] in (1, 2, 3)}) == 1
    machine = toxicity_fm.fit(no_docs, odd_labels)
    assert toxicity_fm.toxicity_scores(no_docs, machine).count() == 0
    assert toxicity_fm.drop_toxic(odd_docs, machine).columns == odd_docs.columns
    assert toxicity_fm.drop_toxic(odd_docs, machine).count() == odd_docs.count()


def test_toxicity_query_has_its_columns(spark, sf_dir, texts):
    rows = QUERIES["op1_toxicity_fm"](spark, sf_dir).collect()
    assert {r["doc_id"] for r in rows} == texts.keys()
    for row in rows:
        assert row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 3 == 1)
        assert row["predicted"] == int(row["score"] >= 0.7)


def test_languages_on_held_out_rows(spark, sf_dir, documents):
    want = {r["doc_id"]: r["lang"] for r in documents.collect()}
    rows = QUERIES["op4_language_centroids"](spark, sf_dir).collect()
    assert {r["doc_id"] for r in rows} == want.keys()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang_pred"] == want[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_languages_of_odd_rows(odd_docs, no_docs):
    model = language_centroids.fit(odd_docs)
    rows = language_centroids.languages_of(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    for i in (1, 2, 3, 11):
        assert (by_id[i]["lang_pred"], by_id[i]["score"]) == ("und", 0.0)
    assert by_id[4]["lang_pred"] == by_id[12]["lang_pred"] == "en"
    nothing = language_centroids.fit(no_docs)
    assert {r["lang_pred"] for r in language_centroids.languages_of(odd_docs, nothing).collect()} == {"und"}
    assert language_centroids.languages_of(no_docs, model).count() == 0


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = list(zip(words, words[1:], words[2:]))
    often, inside = Counter(windows), set()
    for i, window in enumerate(windows):
        if often[window] > 1:
            inside |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


def test_decision_list_query(spark, sf_dir, texts):
    rows = QUERIES["op6_decision_list"](spark, sf_dir).collect()
    assert {r["doc_id"] for r in rows} == texts.keys()
    for row in rows:
        stats = brute_statistics(texts[row["doc_id"]])
        assert tuple(row)[1:6] == stats
        failed = stats[0] < 50 or 100 * stats[4] > 50 * stats[0]
        assert row["base_failed"] == failed and not (failed and row["kept"])
        assert row["kept"] == (not failed and row["rule"] is None)


def test_rules_are_found_and_say_what_spark_says(spark):
    random = np.random.default_rng(5)
    x = {name: random.random(3000) for name in decision_list.FEATURES}
    bad = ((x["upper_share"] > 0.8) & (x["digit_share"] < 0.4)) | (x["symbol_share"] > 0.95)
    rules = decision_list.learn_rules(x, bad)
    found = np.zeros(len(bad), dtype=bool)
    for rule in rules:
        found |= decision_list.covered(rule, x)
    assert (found == bad).mean() > 0.97 and (found & ~bad).mean() < 0.02
    stats = [(i, *random.integers(1, 100, len(decision_list.STATISTICS)).tolist()) for i in range(200)]
    frame = spark.createDataFrame(stats, ", ".join(f"{c} long" for c in ("doc_id", *decision_list.STATISTICS)))
    rows = frame.selectExpr("doc_id", *[f"{e} AS {c}" for c, e in decision_list.FEATURES.items()]).toPandas()
    columns = {c: rows[c].to_numpy(float) for c in decision_list.FEATURES}
    first = np.full(len(rows), 0)
    for number, rule in reversed(list(enumerate(rules, 1))):
        first[decision_list.covered(rule, columns)] = number
    got = frame.select("doc_id", decision_list.rule_number(rules).alias("rule")).toPandas()
    assert got["rule"].fillna(0).astype(int).tolist() == first.tolist()


def test_decision_list_of_odd_rows(odd_docs, no_docs, odd_labels):
    stats = decision_list.statistics(odd_docs)
    assert {tuple(r)[1:6] for r in stats.collect()} == {brute_statistics(r["text"]) for r in odd_docs.collect()}
    for labels in (odd_labels, odd_labels.where("false")):
        rows = decision_list.judged(stats, decision_list.fit(stats, labels)).collect()
        assert len(rows) == odd_docs.count()
        assert all(r["base_failed"] and not r["kept"] for r in rows if r["n_words"] < 50)
    assert decision_list.judged(decision_list.statistics(no_docs), []).count() == 0


def test_gradients_of_the_network():
    random = np.random.default_rng(0)
    params = {k: v.astype(np.float64) + random.normal(0, 0.1, v.shape) for k, v in gru.fresh(np.ones(128) / 128).items()}
    inputs, targets = random.integers(0, 128, (2, 5, 3))
    resets, live = random.random((2, 5, 3)) < [[[0.2]], [[0.9]]]
    state = random.normal(0, 0.3, (3, gru.HIDDEN))
    _, grads, _ = gru.gradients(params, inputs, targets, resets, live, state)
    for name in gru.NAMES:
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        loss = []
        for sign in (1, -1):
            moved = {**params, name: params[name].copy()}
            moved[name][at] += sign * 1e-4
            loss.append(gru.gradients(moved, inputs, targets, resets, live, state)[0])
        assert grads[name][at] * live.sum() == pytest.approx((loss[0] - loss[1]) / 2e-4, rel=1e-4)


def test_probabilities_add_up_and_state_is_carried():
    random = np.random.default_rng(7)
    params = gru.fresh(np.ones(128) / 128)
    params = {k: v + random.normal(0, 0.2, v.shape).astype(np.float32) for k, v in params.items()}
    h = np.repeat(random.normal(0, 0.5, (1, gru.HIDDEN)).astype(np.float32), 128, axis=0)
    assert np.exp(gru.log_probabilities(h, np.arange(128), params)).sum() == pytest.approx(1, abs=1e-4)
    documents = [random.integers(0, 128, n) for n in (1, 200, 3, 77, 0)]
    together = gru.score_documents(documents, params, 0, window=64)
    assert together == pytest.approx(gru.score_documents(documents, params, 0, window=7), abs=1e-3)
    assert together[1] == pytest.approx(gru.score_documents(documents[1:2], params, 0, window=1000)[0], abs=1e-3)


def padded_training(documents, params, lanes, rate=0.003):
    """Plainly: all lanes to the end of the longest, and the textbook's Adam on a clipped gradient."""
    streams = [[] for _ in range(lanes)]
    for document in sorted(documents, key=len, reverse=True):
        min(streams, key=lambda s: sum(map(len, s))).append(document)
    length = max(sum(map(len, s)) for s in streams)
    inputs, targets = np.zeros((2, length, lanes), np.int64)
    resets, live = np.zeros((2, length, lanes), bool)
    for lane, stream in enumerate(streams):
        at = 0
        for d in stream:
            here = slice(at, at + len(d))
            targets[here, lane], live[here, lane], resets[at, lane] = d, True, True
            inputs[at + 1 : at + len(d), lane] = d[:-1]
            at += len(d)
    first, second = ({k: np.zeros_like(v) for k, v in params.items()} for _ in range(2))
    h, losses = np.zeros((lanes, gru.HIDDEN)), []
    for turn, at in enumerate(range(0, length, gru.WINDOW), 1):
        part = slice(at, at + gru.WINDOW)
        loss, grads, h = gru.gradients(params, inputs[part], targets[part], resets[part], live[part], h)
        losses.append(loss)
        norm = max(1.0, np.sqrt(sum((g**2).sum() for g in grads.values())))
        for k, g in grads.items():
            first[k] = 0.9 * first[k] + 0.1 * g / norm
            second[k] = 0.99 * second[k] + 0.01 * (g / norm) ** 2
            step = first[k] / (1 - 0.9**turn) / (np.sqrt(second[k] / (1 - 0.99**turn)) + 1e-6)
            params = {**params, k: params[k] - rate * step}
    return params, sum(losses) / live.sum()


def test_training_leaves_ended_lanes_out(monkeypatch):
    """One long document among short ones: what is learned stays the same, and few dead tokens are worked on."""
    random = np.random.default_rng(3)
    documents = [random.integers(0, 128, n).astype("<u2") for n in (700, *[40] * 60)]
    start = gru.fresh(random.random(128) + 0.01)
    want, want_loss = padded_training(documents, {k: v.astype(np.float64) for k, v in start.items()}, 8)
    worked, windows, plain = [], [], gru.gradients

    def counted(params, inputs, *rest):
        worked.append(inputs.size)
        windows.append(len(inputs))
        return plain(params, inputs, *rest)

    monkeypatch.setattr(gru, "gradients", counted)
    found, loss = gru.train(documents, start, 0, lanes=8)
    assert loss == pytest.approx(want_loss, rel=1e-5)
    for name in gru.NAMES:
        assert found[name] == pytest.approx(want[name], abs=2e-3)
    assert sum(windows) == 700
    assert sum(worked) < 1.1 * sum(map(len, documents))


def test_windows_use_the_same_arrays_again():
    random = np.random.default_rng(4)
    params = gru.fresh(random.random(4096) + 0.01)
    inputs, targets = random.integers(0, 4096, (2, 16, 64)).astype(np.uint16)
    resets, live = np.zeros((16, 64), bool), np.ones((16, 64), bool)
    room = gru.Room(np.float32)
    _, grads, h = gru.gradients(params, inputs, targets, resets, live, np.zeros((64, gru.HIDDEN), np.float32), room)
    first = {k: v.copy() for k, v in grads.items()}
    tracemalloc.start()
    _, _, h = gru.gradients(params, inputs[:, :5], targets[:, :5], resets[:, :5], live[:, :5], h[:5], room)
    fresh = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert fresh < 1_000_000  # the gradients alone are 1,098,368 bytes
    _, grads, _ = gru.gradients(params, inputs, targets, resets, live, np.zeros((64, gru.HIDDEN), np.float32), room)
    assert all((grads[k] == first[k]).all() for k in gru.NAMES)


def brute_base(texts):
    train = {i for i in texts if i is not None and zlib.crc32(str(i).encode()) % 5 != 1}
    counts = Counter(w for i in train for w in words_of(texts[i]))
    total, distinct = sum(counts.values()) + len(train), len(counts) + bool(train)

    def log(c):
        return math.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))

    out = {}
    for i, text in texts.items():
        words = words_of(text)
        known = sum(w in counts for w in words) + bool(train)
        out[i] = len(words) + 1, known, total, sum(log(counts[w]) for w in words) + log(len(train))
    return out


def test_language_model_with_most_counts_joined(documents, texts):
    want = brute_base(texts)
    for row in recurrent_lm.scored(documents, vocabulary=512, kept=600).collect():
        n, known, total, base = want[row["doc_id"]]
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (n, known, total)
        assert row["base_score"] == pytest.approx(base, rel=1e-9)
        assert row["score"] < 0


def test_language_model_query(spark, sf_dir, texts):
    rows = QUERIES["op7_recurrent_lm"](spark, sf_dir).collect()
    want = brute_base(texts)
    assert {r["doc_id"] for r in rows} == texts.keys()
    for row in rows:
        n, known, total, base = want[row["doc_id"]]
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (n, known, total)
        assert row["base_score"] == pytest.approx(base, rel=1e-9)
        assert row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 5 == 1)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_language_model_learns_from_every_training_document(spark, monkeypatch):
    """No share of a larger table: what is kept for training holds all documents and all their tokens."""
    docs = spark.range(120).selectExpr("id doc_id", "repeat(concat('w', id, ' '), 20000) text")
    kept = []
    write = recurrent_lm.materialize
    monkeypatch.setattr(recurrent_lm, "materialize", lambda df: kept.append(write(df)) or kept[-1])
    counts = recurrent_lm.gather(write(recurrent_lm.word_counts(docs)), 120, 512, 600)
    recurrent_lm.fit(docs, counts, rounds=0)
    sizes = {r["doc_id"]: len(r["ids"]) // 2 for r in kept[0].collect()}
    assert sizes == dict.fromkeys(range(120), 20001)
    assert sum(sizes.values()) == counts.tokens


def test_language_model_of_odd_rows(odd_docs, no_docs):
    rows = recurrent_lm.scored(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    assert recurrent_lm.scored(no_docs).count() == 0
    alone = recurrent_lm.scored(odd_docs.where("doc_id is null")).collect()
    assert all(r["score"] == pytest.approx(r["base_score"]) and r["train_tokens"] == 0 for r in alone)
