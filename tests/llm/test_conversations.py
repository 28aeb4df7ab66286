"""The conversation trie against a brute-force one."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from hourtally.llm import burst_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            said = (role or "", text or "")
            digest = hashlib.sha256(f"{len(said[0])}:{said[0]}{said[1]}".encode()).digest()[:16]
            own[conv].append((turn is not None, turn or 0, digest, said))
    own = {c: [t[3] for t in sorted(turns)] for c, turns in own.items()}
    members = defaultdict(list)
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 6
        donor = own.get(conv - (abs(conv) % 100 if conv >= 0 else -(abs(conv) % 100)), [])
        built = tuple(donor[:h] + turns[h:])
        for d in range(len(built) + 1):
            members[built[:d]].append((conv, len(built)))
    out = []
    for path, inside in members.items():
        below = [p for p in members if p[: len(path)] == path]
        ends = sorted(c for c, size in inside if size == len(path))
        out.append((
            min(inside)[0],
            len(path),
            min(members[path[:-1]])[0] if path else None,
            len(inside),
            sum(len(p) == len(path) + 1 for p in below),
            sum(not any(q[:-1] == p for q in below if q) for p in below),
            sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return out


def some_rows(seed, convs=130):
    random.seed(seed)
    rows = [(None, 1, "user", "lost"), (7, None, None, None), (7, None, None, ""), (7, 1, "user", "é🙂"), (7, 1, "user", "b"), (-5, 0, "", "x"), (-100, 2, "u", "deep")]
    texts = ["hi", "hello there", "", None, "é🙂", "tell me more"]
    for conv in random.sample(range(-150, 420), convs):
        if conv % 11 == 0:
            turns = [("user", "same"), ("bot", "same answer"), ("user", "bye")] * 4
        else:
            turns = [(random.choice(("user", "bot", None)), random.choice(texts[: random.choice((1, 2, 6))])) for _ in range(random.randint(1, 9))]
        rows += [(conv, i, *turn) for i, turn in enumerate(turns)]
    random.shuffle(rows)
    return rows


def collected(df):
    return sorted(map(repr, (tuple(r) for r in df.select(*COLUMNS).collect())))


@pytest.mark.parametrize("most_rows, most_turns", [(20_000, 200_000), (8, 10_000), (1, 1), (10_000, 60)])
def test_nodes_equal_brute_force_however_containers_burst(spark, most_rows, most_turns):
    rows = some_rows(3)
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    found = burst_trie.prefix_trie(turns, most_rows=most_rows, most_turns=most_turns)
    assert collected(found) == sorted(map(repr, brute_trie(rows)))


def test_odd_tables(spark):
    schema = "conv_id int, turn long, role string, text string, " + ", ".join(
        f"{c} string" for c in ("head", "path", "above", "rest", "n", "least", "ends", "depth", "chars", "turns", "donor", "id", "big", "salt")
    )
    rows = [(5, 1, "user", "word " * 200_000), (5, 2, None, None), (5, 2, None, None), (105, None, "a", None)]
    turns = spark.createDataFrame([(*row, *["x"] * 14) for row in rows], schema)
    assert collected(burst_trie.prefix_trie(turns)) == sorted(map(repr, brute_trie(rows)))
    assert burst_trie.prefix_trie(turns.where("false")).count() == 0
    assert burst_trie.prefix_trie(turns.where("false").select("conv_id", "turn", "role", "text")).columns == COLUMNS


def test_ends_of_a_class_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        members = spark.range(100).selectExpr("id as conv_id", "cast(if(id < 60, 'a', 'b') as binary) as path")
        found = {bytes(r["path"]): r for r in burst_trie.class_ends(members).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for path, ids in ((b"a", range(60)), (b"b", range(60, 100))):
        assert found[path]["n"] == len(ids) and found[path]["least"] == ids[0]
        assert found[path]["ends"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
