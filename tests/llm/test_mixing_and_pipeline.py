"""Mixing against its SQL and a brute-force allotment; the pipeline stage by stage."""

from __future__ import annotations

import hashlib
import re
from pathlib import Path

import pytest

import __spark_entry__ as driver
import corpus_pipeline
from hourtally.llm import source_mixing as mixing
from hourtally.llm.queries import ORACLE, QUERIES
from test_dedup import brute_components, brute_sets

duckdb = pytest.importorskip("duckdb")


def test_all_queries_are_registered():
    assert {*QUERIES, "pipeline"} <= driver.queries().keys()
    numbers = {int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES}
    assert numbers == set(range(1, 14)) and len(QUERIES) == 13


@pytest.mark.parametrize("name", ORACLE)
def test_query_against_sql(spark, sf_dir, name):
    connection = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    result = connection.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    frame = QUERIES[name](spark, sf_dir)
    assert sorted(columns) == sorted(frame.columns)
    got = sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)
    assert got == sorted(result.fetchall(), key=repr)


def brute_share(available, children):
    """``name -> budget`` of ``name -> (holds, weight)``: fill in turn what holds less than its share."""
    budgets, left = {}, dict(children)
    while left:
        weights = sum(w for _, w in left.values())
        full = [c for c, (holds, w) in left.items() if holds * weights <= w * available]
        if not full:
            break
        for c in full:
            budgets[c] = left.pop(c)[0]
            available -= budgets[c]
    if left:
        weights = sum(w for _, w in left.values())
        shares = {c: available * w // weights for c, (_, w) in left.items()}
        rest = available - sum(shares.values())
        for c in sorted(left, key=lambda c: (left[c][0] / left[c][1], c)):
            budgets[c] = shares[c] + (rest > 0)
            rest -= rest > 0
    return budgets


def brute_copies(rows, mixture):
    """Copies of ``doc_id, (domain, lang, source), tokens``."""
    supply = {}
    for _, leaf, tokens in rows:
        supply[leaf] = supply.get(leaf, 0) + tokens
    budget = {(): sum(supply.values()) * mixture.percent // 100}
    for level in range(3):
        for parent in [p for p in budget if len(p) == level]:
            names = {leaf[level] for leaf in supply if leaf[:level] == parent}
            children = {
                n: (
                    sum(s for leaf, s in supply.items() if leaf[: level + 1] == (*parent, n)) * mixture.max_epochs,
                    mixture.weights[level].get(n, 1),
                )
                for n in names
            }
            budget |= {(*parent, n): b for n, b in brute_share(budget[parent], children).items()}
    out = []
    for leaf, held in supply.items():
        full = budget[leaf] // held if held else 0
        rest, used = budget[leaf] - full * held, 0

        def place(i):
            return hashlib.md5(f"{mixture.seed}:{full}:{'' if i is None else i}".encode()).hexdigest() + f":{'' if i is None else i}"

        groups = {}
        for i, _, tokens in (r for r in rows if r[1] == leaf):
            groups.setdefault(place(i), []).append((i, tokens))
        for key in sorted(groups):
            used += sum(t for _, t in groups[key])
            out += [(i, full + (used <= rest)) for i, _ in groups[key]]
    return out


def tree_rows(frame):
    return [(r["doc_id"], (r["domain"], r["lang"], r["source"]), r["n_tokens"]) for r in mixing.with_tree(frame).collect()]


@pytest.mark.parametrize("percent, epochs", [(60, 4), (350, 4), (90, 1), (0, 2), (100, 1)])
def test_budgets_and_copies(spark, documents, percent, epochs):
    mixture = mixing.Mixture(percent=percent, max_epochs=epochs)
    rows = mixing.with_tree(documents)
    planned = rows.join(mixing.leaf_plan(rows, mixture), list(mixing.TREE))
    got = sorted((r["doc_id"], r["copies"]) for r in planned.select("doc_id", mixing.copies(mixture).alias("copies")).collect())
    assert got == sorted(brute_copies(tree_rows(documents), mixture))
    leaves = planned.select(*mixing.TREE, "supply", "budget").distinct().collect()
    total = sum(r["supply"] for r in leaves)
    assert sum(r["budget"] for r in leaves) == min(total * percent // 100, total * epochs)


def test_mixing_of_odd_rows(odd_docs, no_docs):
    mixture = mixing.Mixture(percent=150, max_epochs=3)
    mixed = mixing.mix(odd_docs, mixture)
    assert mixed.columns == odd_docs.columns
    want = {}
    for i, n in brute_copies(tree_rows(odd_docs), mixture):
        want[i] = want.get(i, 0) + n
    got = {}
    for row in mixed.collect():
        got[row["doc_id"]] = got.get(row["doc_id"], 0) + 1
    assert got == {i: n for i, n in want.items() if n}
    assert mixing.mix(no_docs, mixture).count() == 0


def test_pipeline_stage_by_stage(spark, sf_dir, documents):
    tokenizers = pytest.importorskip("tokenizers")
    docs, columns = documents, documents.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "bpe"]
    before = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        after = {r["doc_id"]: r for r in docs.collect()}
        assert docs.columns == columns and all(before[i] == r for i, r in after.items())
        if name == "exact_dedup":
            assert after.keys() == {max(i for i, r in before.items() if r["text"] == t) for t in {r["text"] for r in before.values()}}
        if name == "near_dedup":
            want = brute_components(brute_sets({i: r["text"] for i, r in before.items()}, 5))
            assert after.keys() == {i for i, c in want.items() if i == c}
        if name == "mixing":
            kept = brute_copies(tree_rows(spark.createDataFrame(list(before.values()), documents.schema)), corpus_pipeline.MIXTURE)
            assert after.keys() == {i for i, n in kept if n}
        if name == "toxicity":
            scored = QUERIES["op1_toxicity_fm"](spark, sf_dir).collect()
            assert after.keys() == {r["doc_id"] for r in scored if r["predicted"] == 0}
        before = after
    reference = tokenizers.Tokenizer.from_file(corpus_pipeline.tokenizer_path(corpus_pipeline.VOCABULARY))
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    lengths = {i: len(reference.encode(r["text"] or "", add_special_tokens=False).ids) for i, r in before.items()}
    assert {r["doc_id"]: r["n_tokens"] for r in last} == lengths
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, last))


def test_pipeline_of_odd_and_of_no_rows(spark, sf_dir, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf_dir).cache()
            assert docs.columns == odd_docs.columns
        rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
        assert len(rows) == docs.count()
