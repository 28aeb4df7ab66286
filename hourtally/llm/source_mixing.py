"""Mixing sources to target weights over a tree of domains, languages and sources.

A token budget is handed down the tree: the children of a node share its budget in
proportion to their weights. A child that holds less than its share, at most
``max_epochs`` times its tokens, gets all it holds and its siblings share what is
missing in proportion to theirs; only what all of them cannot take is short at
their parent, which was itself allotted no more than its children hold together.
So shortages go to siblings before they reach ancestors. All amounts are whole
tokens and the shares of a node add up to it exactly.

A leaf's budget pays for whole epochs over its documents and for the beginning of
one more: documents in the order of a seeded hash of epoch and id, as long as
their tokens fit. The end of that prefix is found per leaf: hash buckets are added
up, twice over, and documents are ordered only within the last bucket that the
budget reaches. A document is then chosen by its own hash, so no text moves.

Defined results: a null text has no tokens; null names are the empty name. Rows
repeated with one ``doc_id`` are chosen or left out together. A null ``doc_id`` is
the empty id. Without rows there is no budget and no row. Columns are used by the
names given, others are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hourtally.llm.common import WORD_PATTERN, read_table
from hourtally.session import materialize

TREE = ("domain", "lang", "source")
# Digits of the hash that a leaf's documents are added up by: first into 16 ** 3 buckets, and
# then those of the bucket where its budget ends into as many.
BUCKET_DIGITS = (3, 6)
SEED = "mix-1"


@dataclass(frozen=True)
class Mixture:
    """Whole weights by name for each level of the tree, 1 for other names.

    ``percent`` of all tokens is the budget; a document is used at most
    ``max_epochs`` times.
    """

    weights: tuple[dict[str, int], ...] = (
        {"d0": 4, "d1": 3, "d2": 2, "d3": 1},
        {"en": 5, "de": 2, "fr": 2, "es": 1},
        {"src0": 3},
    )
    percent: int = 60
    max_epochs: int = 4
    seed: str = SEED


def domain_of(source: Column) -> Column:
    """Sources are dealt to four domains by the number that their name ends with."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    return F.when(number == "", "dx").otherwise(F.concat(F.lit("d"), (number.cast("long") % 4).cast("string")))


def tree_names() -> list[Column]:
    names = [domain_of(F.col("source")), F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))]
    return [column.alias(name) for column, name in zip(names, TREE)]


def with_tree(docs: DataFrame) -> DataFrame:
    """``doc_id``, the names of the tree and ``n_tokens``, the number of words."""
    tokens = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD_PATTERN)).cast("long")
    return docs.select("doc_id", *tree_names(), tokens.alias("n_tokens"))


def weight_of(level: int, mixture: Mixture) -> Column:
    out = F.lit(1)
    for name, weight in mixture.weights[level].items():
        out = F.when(F.col(TREE[level]) == name, weight).otherwise(out)
    return out.cast("decimal(9,0)")


def share_out(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``budget`` to rows with ``weight``, ``holds`` and the parent's ``available``.

    In ascending order of what they hold per weight, children take all they hold
    as long as that is no more than their share of what is left.
    """
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.col("holds").cast("double") / F.col("weight").cast("double"), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    amount = "decimal(20,0)"
    rows = (
        children.withColumn("taken", F.coalesce(F.sum("holds").over(before), F.lit(0)).cast(amount))
        .withColumn("weights", F.sum("weight").over(rest).cast("decimal(18,0)"))
        .withColumn("whole", F.expr("holds * weights <= weight * cast(available - taken AS decimal(20,0))"))
    )
    open_ = ~F.col("whole")
    rows = (
        rows.withColumn("left", (F.col("available") - F.sum(F.when(F.col("whole"), F.col("holds")).otherwise(0)).over(by)).cast(amount))
        .withColumn("open_weight", F.sum(F.when(open_, F.col("weight")).otherwise(0)).over(by).cast("decimal(18,0)"))
        .withColumn("floor", F.when(open_, F.expr("cast(weight * left div open_weight AS decimal(20,0))")))
        .withColumn("over", (F.col("left") - F.sum("floor").over(by)).cast(amount))
        .withColumn("turn", F.row_number().over(by.orderBy("whole", F.col("holds").cast("double") / F.col("weight").cast("double"), name)))
    )
    extra = F.when(F.col("turn") <= F.col("over"), 1).otherwise(0)
    budget = F.when(F.col("whole"), F.col("holds")).otherwise(F.col("floor") + extra)
    return rows.withColumn("budget", budget.cast("long")).drop("taken", "weights", "whole", "left", "open_weight", "floor", "over", "turn")


def leaf_budgets(leaves: DataFrame, mixture: Mixture) -> DataFrame:
    """``domain, lang, source, supply, budget`` of ``domain, lang, source, supply``: one row per leaf."""
    total = leaves.agg(F.coalesce(F.sum("supply"), F.lit(0))).first()[0]
    above, above_names = None, []
    for level, name in enumerate(TREE):
        path = list(TREE[: level + 1])
        nodes = leaves.groupBy(*path).agg((F.sum("supply") * mixture.max_epochs).cast("decimal(20,0)").alias("holds"))
        nodes = nodes.withColumn("weight", weight_of(level, mixture))
        if above is None:
            nodes = nodes.withColumn("available", F.lit(int(total) * mixture.percent // 100).cast("decimal(20,0)"))
        else:
            nodes = nodes.join(above, above_names)
        shared = share_out(nodes, path[:-1], name)
        above, above_names = shared.select(*path, F.col("budget").cast("decimal(20,0)").alias("available")), path
    return leaves.join(above.withColumnRenamed("available", "budget"), list(TREE)).withColumn("budget", F.col("budget").cast("long"))


def place(epoch: Column, mixture: Mixture) -> Column:
    """A document's place in the order of an epoch: a hash, then its id."""
    doc_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    key = F.concat_ws(":", F.lit(mixture.seed), epoch.cast("string"), doc_id)
    return F.concat_ws(":", F.md5(key.cast("binary")), doc_id)


def leaf_plan(tree_rows: DataFrame, mixture: Mixture) -> DataFrame:
    """Per leaf its ``budget``, the number of ``full`` epochs and the ``last`` place chosen in the next one.

    ``tree_rows`` has ``doc_id``, the names of the tree and ``n_tokens``, and should be materialized.
    """
    names = list(TREE)
    leaves = materialize(tree_rows.groupBy(*names).agg(F.sum("n_tokens").alias("supply")))
    full = F.when(F.col("supply") > 0, F.expr("budget div supply")).otherwise(0)
    budgets = leaf_budgets(leaves, mixture).withColumn("full", full.cast("long"))
    budgets = materialize(budgets.withColumn("rest", F.col("budget") - F.col("full") * F.col("supply")))
    placed = tree_rows.join(budgets.select(*names, "full", "rest"), names).withColumn("place", place(F.col("full"), mixture))
    ends = budgets.select(*names, "rest", F.lit("").alias("bucket"), F.lit(0).cast("long").alias("before"))
    for digits in BUCKET_DIGITS:
        inside = placed.join(ends.drop("rest"), names).where(F.col("place").startswith(F.col("bucket")))
        finer = F.substring("place", 1, digits).alias("finer")
        ordered = Window.partitionBy(*names).orderBy("finer").rowsBetween(Window.unboundedPreceding, -1)
        ends = materialize(
            inside.groupBy(*names, "rest", "before", finer)
            .agg(F.sum("n_tokens").alias("tokens"))
            .withColumn("before", F.col("before") + F.coalesce(F.sum("tokens").over(ordered), F.lit(0)))
            .where("before <= rest AND before + tokens > rest")
            .select(*names, "rest", F.col("finer").alias("bucket"), "before")
        )
    inside = placed.join(ends.drop("rest"), names).where(F.col("place").startswith(F.col("bucket")))
    same = inside.groupBy(*names, "rest", "bucket", "before", "place").agg(F.sum("n_tokens").alias("tokens"))
    running = F.sum("tokens").over(Window.partitionBy(*names).orderBy("place"))
    lasts = (
        same.withColumn("upto", F.col("before") + running)
        .groupBy(*names, "bucket")
        .agg(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("place"))).alias("last"))
        .select(*names, F.coalesce("last", "bucket").alias("last"))
    )
    # Where no bucket exceeds the rest, the whole epoch is chosen: above every hash.
    found = budgets.join(lasts, names, "left").withColumn("last", F.coalesce("last", F.lit("g")))
    return materialize(found.select(*names, "supply", "budget", "full", "last"))


def copies(mixture: Mixture) -> Column:
    """How often a row with its leaf's plan is used."""
    return F.col("full") + (place(F.col("full"), mixture) <= F.col("last")).cast("long")


def mix(docs: DataFrame, mixture: Mixture) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as its leaf's budget uses it."""
    tree_rows = materialize(with_tree(docs))
    names = list(TREE)
    plan = leaf_plan(tree_rows, mixture).select(*[F.col(c).alias(f"leaf_{c}") for c in names], "full", "last")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select("doc_id", whole.alias("row"), *tree_names())
    joined = rows.join(plan, [rows[c] == plan[f"leaf_{c}"] for c in names])
    used = joined.withColumn("copies", copies(mixture)).where("copies > 0")
    if mixture.max_epochs > 1:
        used = used.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return used.select("row.*")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixture = Mixture()
    rows = materialize(with_tree(read_table(spark, sf_dir, "documents")))
    planned = rows.join(leaf_plan(rows, mixture), list(TREE))
    return planned.select("doc_id", *TREE, "n_tokens", F.col("budget").alias("leaf_budget"), copies(mixture).alias("copies"))


def _weight_sql(level: int, mixture: Mixture) -> str:
    cases = " ".join(f"WHEN '{name}' THEN {weight}" for name, weight in mixture.weights[level].items())
    return f"CASE {TREE[level]} {cases} ELSE 1 END"


def _level_sql(level: int, mixture: Mixture) -> str:
    """One level of the budget: nodes, then what they take whole, then the shares of the others."""
    path, name = ", ".join(TREE[: level + 1]), TREE[level]
    by = "PARTITION BY " + (", ".join(TREE[:level]) if level else "1")
    order = f"ORDER BY holds::DOUBLE / weight, {name}"
    available = f"(SELECT sum(supply) FROM leaves) * {mixture.percent} // 100"
    joined = f"JOIN budget{level - 1} USING ({', '.join(TREE[:level])})" if level else ""
    return f"""
nodes{level} AS (
    SELECT *, {_weight_sql(level, mixture)} AS weight, {"budget" if level else available} AS available
    FROM (SELECT {path}, sum(supply) * {mixture.max_epochs} AS holds FROM leaves GROUP BY {path}) {joined}
), whole{level} AS (
    SELECT {path}, holds, weight, available,
           holds * sum(weight) OVER ({by} {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
           <= weight * (available - coalesce(sum(holds) OVER ({by} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS whole
    FROM nodes{level}
), open{level} AS (
    SELECT *, available - sum(CASE WHEN whole THEN holds ELSE 0 END) OVER ({by}) AS rest,
           sum(CASE WHEN whole THEN 0 ELSE weight END) OVER ({by}) AS open_weight,
           row_number() OVER ({by} ORDER BY whole, holds::DOUBLE / weight, {name}) AS turn
    FROM whole{level}
), floor{level} AS (
    SELECT *, CASE WHEN NOT whole THEN weight * rest // open_weight END AS share FROM open{level}
), budget{level} AS (
    SELECT {path}, CASE WHEN whole THEN holds
           ELSE share + CASE WHEN turn <= rest - sum(share) OVER ({by}) THEN 1 ELSE 0 END END AS budget
    FROM floor{level}
)"""


def mixing_sql(mixture: Mixture) -> str:
    levels = ",".join(_level_sql(level, mixture) for level in range(len(TREE)))
    names = ", ".join(TREE)
    return f"""
WITH numbered AS (
    SELECT *, regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS number FROM documents
), docs AS (
    SELECT doc_id, CASE WHEN number = '' THEN 'dx' ELSE 'd' || (number::BIGINT % 4) END AS domain,
           coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens
    FROM numbered
), leaves AS (
    SELECT {names}, sum(n_tokens) AS supply FROM docs GROUP BY {names}
),{levels}, plans AS (
    SELECT {names}, supply, budget, CASE WHEN supply > 0 THEN budget // supply ELSE 0 END AS epochs
    FROM leaves JOIN budget{len(TREE) - 1} USING ({names})
), placed AS (
    SELECT docs.*, budget, epochs, budget - epochs * supply AS rest,
           md5('{mixture.seed}:' || epochs::BIGINT || ':' || doc_id) || ':' || doc_id AS place
    FROM docs JOIN plans USING ({names})
), run AS (
    SELECT *, sum(n_tokens) OVER (PARTITION BY {names} ORDER BY place) AS upto FROM placed
)
SELECT doc_id, {names}, n_tokens, budget::BIGINT AS leaf_budget,
       (epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies
FROM run
"""


OP2_SQL = mixing_sql(Mixture())
