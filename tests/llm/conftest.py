from __future__ import annotations

import random
from pathlib import Path

import pytest

SF = Path("/root/testdata/sf0.001")
# Names that the operators use inside, as further columns of the input.
CLASHES = ("digest", "content", "salt", "keep_id", "score", "label", "rep", "key", "row", "rank", "n", "ids", "place")


@pytest.fixture(scope="session")
def sf_dir():
    if not SF.exists():
        pytest.skip("driver tables absent")
    return str(SF)


def long_text() -> str:
    random.seed(4)
    return " ".join(random.choice(("alpha", "beta", "gamma", "delta", "x1", "Ünï", "z,")) for _ in range(30_000))


ODD_TEXTS = {
    1: None,
    2: "",
    3: "   \n\t ",
    4: "one two three",
    5: "one two three",
    6: "The Quick brown fox jumps over the lazy dog near the river bank today",
    7: "the quick BROWN fox jumps over the lazy dog near the river bank today",
    8: "é́ 日本語 テキスト　x 🙂🙂 \x1c\x85 <|endoftext|> it's 12½ İstanbul ΣΑΣ",
    9: long_text(),
    10: long_text(),
    11: "#$% 123 !!! ***",
    12: "a" * 5000,
    13: "one two three",
}


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, copies, repeated rows, further columns."""
    rows = [(i, text, "en" if i % 3 else None, f"src{i % 3}" if i % 4 else None, 1) for i, text in ODD_TEXTS.items()]
    rows += [(4, "one two three", "en", "src1", 1), (None, "one two three", None, None, None), (None, None, None, None, None)]
    rows = [(*row, *[f"{c}{i}" for c in CLASHES]) for i, row in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def odd_labels(spark):
    rows = [(4, 1, 1), (4, 0, None), (6, None, 0), (None, 1, 1), (9, 1, 0), (99, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {row["doc_id"]: row["text"] for row in documents.select("doc_id", "text").collect()}
