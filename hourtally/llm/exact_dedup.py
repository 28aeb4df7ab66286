"""Exact duplicates: local, salted and global combining, with full content compared at every stage.

Defined results: a null text is empty; a null ``doc_id`` never wins against
another; a group of null ids keeps null; rows repeated with one ``doc_id`` count
each in ``group_size`` and exactly one of them is kept. Other columns than
``doc_id`` and ``text`` play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hourtally.llm.common import read_table
from hourtally.session import materialize

SALTS = 32


def sha256(text: Column) -> Column:
    """32 bytes of the UTF-8 text."""
    return F.unhex(F.sha2(text, 256))


def with_digest(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id"), text.alias("content"), digest(text).alias("digest"))


def combine(rows: DataFrame, salts: int, first: list[Column], merge: list[Column]) -> DataFrame:
    """One row per ``digest, content``: within a task, then within a salt, then over salts.

    The grouping keys hold the whole content, so equal digests of different
    texts never meet. A task sends one row per text, and the salt is the task's
    number, so a text that is everywhere reaches a reducer once per ``salts``
    share of the tasks and the last one ``salts`` times.
    """
    salted = rows.withColumn("salt", F.spark_partition_id() % salts)
    return salted.groupBy("digest", "content", "salt").agg(*first).groupBy("digest", "content").agg(*merge)


def content_groups(rows: DataFrame, salts: int) -> DataFrame:
    """``digest, content, keep_id, group_size`` of ``doc_id, digest, content``."""
    return combine(
        rows,
        salts,
        [F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")],
        [F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")],
    )


def exact_groups(
    docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = SALTS
) -> DataFrame:
    """``doc_id, digest, keep_id, group_size, kept`` for every row of ``doc_id, text``.

    Rows find their group by digest alone, which carries no text over the
    network once more. Digests under which two contents were seen are found
    first; their rows are matched by content.
    """
    rows = with_digest(docs, digest)
    groups = materialize(
        content_groups(rows, salts)
        .groupBy("digest")
        .agg(
            F.count(F.lit(1)).alias("contents"),
            F.max("keep_id").alias("keep_id"),
            F.sum("group_size").alias("group_size"),
        )
        .where("group_size > 1")
    )
    # A row looks for its group under one of ``salts`` copies of it, so a text
    # that is everywhere is matched by as many tasks. Spark takes the copies for
    # as small as the groups' file and would broadcast them, all of them by way
    # of the driver; the hint has both sides shuffled at every size.
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    same = groups.where("contents = 1").select("digest", "keep_id", "group_size", copies).hint("merge")
    clashes = groups.where("contents > 1").select("digest")
    plain = rows.select("doc_id", "digest", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"))
    if clashes.isEmpty():
        found = plain.join(same, ["digest", "salt"], "left")
    else:
        clashing = rows.join(clashes, "digest", "left_semi")
        matched = clashing.join(content_groups(clashing, salts), ["digest", "content"]).drop("content")
        others = plain.join(clashes, "digest", "left_anti").join(same, ["digest", "salt"], "left")
        found = others.drop("salt").unionByName(matched)
    found = found.select(
        "doc_id",
        "digest",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
    )
    # Only rows repeated with one id and text share a window here.
    turn = F.row_number().over(Window.partitionBy("doc_id", "digest", "keep_id").orderBy("group_size"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (turn == 1))


def drop_exact_duplicates(
    docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = SALTS
) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: of equal texts the one with the largest ``doc_id``.

    The other columns travel with the content as the value of the largest id,
    so nothing is joined back.
    """
    others = [c for c in docs.columns if c != "text"]
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        digest(text).alias("digest"),
        text.alias("content"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("rank"),
        F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)], F.col("text").isNull().alias("gone")).alias("row"),
    )
    best = F.max_by("row", "rank").alias("row"), F.max("rank").alias("rank")
    kept = combine(rows, salts, list(best), [best[0]])
    back = {c: F.col(f"row.c{i}") for i, c in enumerate(others)}
    back["text"] = F.when(~F.col("row.gone"), F.col("content"))
    return kept.select(*[back[c].alias(c) for c in docs.columns])


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(read_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP5_SQL = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM (
    SELECT doc_id,
           max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
           count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
           sha256(coalesce(text, '')) AS text_sha256
    FROM documents
)
"""
