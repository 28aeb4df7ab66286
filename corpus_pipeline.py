"""A corpus pipeline over ``documents``: every stage reads all that its predecessor kept.

``STAGES`` lists the stages in order. Each takes ``(spark, docs, sf_dir)`` and
returns rows with the columns of ``documents``; the last returns token counts and
digests of the encoded corpus. Rows with null or empty texts, repeated rows, empty tables and further
columns have the results that the operators' docstrings define; further columns
are carried through all but the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hourtally.llm.bpe_trie import VOCABULARY, bpe_digests, tokenizer_path
from hourtally.llm.common import read_table
from hourtally.llm.exact_dedup import drop_exact_duplicates
from hourtally.llm.minhash_join import drop_near_duplicates
from hourtally.llm.source_mixing import Mixture, mix
from hourtally.llm.toxicity_fm import drop_toxic, fit
from hourtally.session import materialize

# Of the tokens that are left nine in ten are used, each document once at most.
MIXTURE = Mixture(percent=90, max_epochs=1)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine does not call toxic."""
    return drop_toxic(docs, fit(docs, read_table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a similarity of 0.8 on five-word shingles the one with the smallest id."""
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the budgets of their domain, language and source pay for."""
    return mix(docs, MIXTURE)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them."""
    return bpe_digests(docs, tokenizer_path(VOCABULARY))


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("bpe", bpe),
]

# The stages learn models and count hash collisions, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage is written to shared storage and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
