"""The prefix trie of conversations, built as a burst trie.

A conversation becomes one row with the ids of its turns. Rows with equal
sequences are one class, so a conversation copied a million times is swept
once. All classes start in one container under the root. A container with more
than ``most_rows`` classes or ``most_turns`` turns bursts: its head becomes a
node of the trie, and every class moves to the container of its next turn id.
This is repeated for what is still too large, a level each time, in Spark. The
containers that remain are dealt over shards by head; each is sorted and swept
into nodes in one go, in memory that the two limits bound. Nodes that burst are
added up from their children, level by level from the deepest.

A turn id is 128 bits of the SHA-256 of role and text; texts are not shuffled.
A conversation is one row of about 40 bytes a turn. ``ends_sha256`` is a
sequential hash by its contract: the sorted ids of a class stream through one
task, a few bytes each, and are never held.

Defined results: null roles and texts are empty, rows without ``conv_id`` are
no conversation. Turns are ordered by number (null first), equal numbers by the
digest of role and text, so repeated rows are repeated turns. An empty table
has no nodes. Further columns are not looked at.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourtally.llm.common import read_table
from hourtally.session import materialize

BLOCK = 100  # conversations that take over turns of one
HEADS = 6  # takes over less than so many turns
MOST_ROWS = 20_000
MOST_TURNS = 200_000
SALTS = 16

_NODE = "conv_id BIGINT, n_convs BIGINT, n_children BIGINT, n_leaves BIGINT, saved_tokens BIGINT, ends_sha256 STRING"
_SWEPT = f"head BINARY, above BINARY, top BOOLEAN, depth BIGINT, parent_conv_id BIGINT, {_NODE}"
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def _digest(value: Column) -> Column:
    return F.substring(F.unhex(F.sha2(value, 256)), 1, 16)


def turn_sequences(turns: DataFrame) -> DataFrame:
    """``conv_id, turns``: the turns of every conversation in order, each ``id, chars``."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    one = F.struct(
        F.col("turn").alias("turn"),
        _digest(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("id"),
        F.length(text).cast("long").alias("chars"),
    )
    return (
        turns.where("conv_id is not null")
        .groupBy(F.col("conv_id").cast("long").alias("conv_id"))
        .agg(F.array_sort(F.collect_list(one)).alias("turns"))
        .select("conv_id", F.transform("turns", lambda t: F.struct(t["id"].alias("id"), t["chars"].alias("chars"))).alias("turns"))
    )


def rebuilt(sequences: DataFrame, block: int = BLOCK, heads: int = HEADS) -> DataFrame:
    """Every conversation with its first turns taken from the first conversation of its block."""
    donors = sequences.where(F.col("conv_id") % block == 0).select(
        F.col("conv_id").alias("donor"), F.slice("turns", 1, heads - 1).alias("first")
    )
    taken = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    joined = sequences.withColumn("donor", F.col("conv_id") - F.col("conv_id") % block).join(donors, "donor", "left")
    none = F.slice("turns", 1, 0)
    turns = F.concat(
        F.slice(F.coalesce("first", none), F.lit(1), taken), F.slice("turns", taken + 1, F.size("turns"))
    )
    return joined.select("conv_id", turns.alias("turns"))


def class_ends(members: DataFrame) -> DataFrame:
    """``path, n, least, ends`` of the conversations ``path, conv_id`` that are equal, ids in a sorted stream."""

    def run(batches):
        current, digest, n, least = None, None, 0, None
        for batch in batches:
            paths, ids = batch.column("path").to_pylist(), batch.column("conv_id").to_numpy()
            done, start = [], 0
            while start < len(paths):
                path, stop = paths[start], start + 1
                while stop < len(paths) and paths[stop] == path:
                    stop += 1
                if path != current:
                    if current is not None:
                        done.append((current, n, least, digest.hexdigest()))
                    current, digest, n, least = path, hashlib.sha256(), 0, int(ids[start])
                joined = ",".join(map(str, ids[start:stop].tolist()))
                digest.update((("," if n else "") + joined).encode())
                n += stop - start
                start = stop
            if done:
                yield _class_rows(done)
        if current is not None:
            yield _class_rows([(current, n, least, digest.hexdigest())])

    ordered = members.select("path", "conv_id").repartition("path").sortWithinPartitions("path", "conv_id")
    return ordered.mapInArrow(run, "path BINARY, n BIGINT, least BIGINT, ends STRING")


def _class_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.binary(), pa.int64(), pa.int64(), pa.string())
    arrays = [pa.array(column, t) for column, t in zip(zip(*rows), types)]
    return pa.RecordBatch.from_arrays(arrays, names=["path", "n", "least", "ends"])


def classes(conversations: DataFrame) -> DataFrame:
    """``path, turns, n, least, ends``: every distinct sequence of turns once."""
    ids = F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), "")
    named = materialize(conversations.withColumn("path", _digest(ids)))
    ends = class_ends(named)
    return ends.join(
        named.select("path", F.col("conv_id").alias("least"), "turns"), ["path", "least"]
    )


def burst(rows: DataFrame, most_rows: int, most_turns: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """The containers that remain, and the burst heads of every level.

    Containers have rows ``head, above, chars, depth, rest, n, least, ends``.
    Heads have ``head, above, chars`` and what ends at them: ``n, least, ends``.
    """
    settled, levels = [], []
    open_rows = materialize(
        rows.select(
            "path", F.lit(b"").alias("head"), F.lit(None).cast("binary").alias("above"), F.lit(0).cast("long").alias("chars"),
            F.lit(0).cast("long").alias("depth"), F.col("turns").alias("rest"), "n", "least", "ends",
        )
    )
    while True:
        sizes = open_rows.groupBy("head").agg(
            F.count(F.lit(1)).alias("rows"), F.sum(F.size("rest").cast("long")).alias("turns")
        )
        big = materialize(sizes.where(f"rows > 1 and (rows > {most_rows} or turns > {most_turns})").select("head"))
        if big.isEmpty():
            return [*settled, open_rows], levels
        # One head may hold most rows, so both sides of the join are salted.
        salt = F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int")
        salted = big.select("head", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("big"))
        marked = materialize(open_rows.withColumn("salt", salt).join(salted, ["head", "salt"], "left").drop("salt"))
        settled.append(marked.where("big is null").drop("big"))
        bursting = marked.where("big").drop("big")
        here = F.when(F.size("rest") == 0, F.struct("n", "least", "ends"))
        levels.append(
            bursting.groupBy("head", "above", "chars").agg(F.max(here).alias("here")).select("head", "above", "chars", "here.*")
        )
        following = F.col("rest")[0]
        open_rows = materialize(
            bursting.where(F.size("rest") > 0).select(
                "path",
                _digest(F.concat(F.hex("head"), F.hex(following["id"]))).alias("head"),
                F.col("head").alias("above"),
                following["chars"].alias("chars"),
                (F.col("depth") + 1).alias("depth"),
                F.slice("rest", F.lit(2), F.size("rest")).alias("rest"),
                "n",
                "least",
                "ends",
            )
        )


def sweep(chars: int, depth: int, rows: list[tuple]) -> dict[str, list]:
    """The nodes of one container, whose ``rows`` (ids, chars, n, least, ends) are sorted; the first is its head."""
    nodes = {name: [0] for name in ("n", "leaves", "children", "saved")}
    n, leaves, children, saved = (nodes[name] for name in ("n", "leaves", "children", "saved"))
    up, deep, least, ends, own = [-1], [depth], [None], [None], [chars]
    stack, before = [0], []
    for ids, lengths, copies, smallest, digest in rows:
        shared = 0
        for x, y in zip(ids, before):
            if x != y:
                break
            shared += 1
        del stack[shared + 1 :]
        for at in range(shared, len(ids)):
            up.append(stack[-1])
            deep.append(depth + at + 1)
            own.append(lengths[at])
            least.append(None)
            ends.append(None)
            for column in nodes.values():
                column.append(0)
            stack.append(len(up) - 1)
        last = stack[-1]
        n[last] += copies
        ends[last] = digest
        least[last] = smallest if least[last] is None else min(least[last], smallest)
        before = ids
    for i in range(len(up) - 1, -1, -1):
        leaves[i] = leaves[i] or 1
        saved[i] += (n[i] - 1) * own[i]
        at = up[i]
        if at >= 0:
            n[at] += n[i]
            children[at] += 1
            leaves[at] += leaves[i]
            saved[at] += saved[i]
            least[at] = least[i] if least[at] is None else min(least[at], least[i])
    parents = [None if at < 0 else least[at] for at in up]
    return {"depth": deep, "parent_conv_id": parents, "conv_id": least, "ends_sha256": [e or _NO_ENDS for e in ends], **nodes}


def _sweep_rows(container: tuple, rows: list[tuple]) -> pa.RecordBatch:
    head, above, chars, depth = container
    found = sweep(chars, depth, rows)
    many = len(found["depth"])
    top = np.zeros(many, dtype=bool)
    top[0] = True
    whole = lambda name: pa.array(found[name], pa.int64())
    columns = {
        "head": pa.array([head] * many, pa.binary()), "above": pa.array([above] * many, pa.binary()), "top": pa.array(top),
        "depth": whole("depth"), "parent_conv_id": whole("parent_conv_id"), "conv_id": whole("conv_id"),
        "n_convs": whole("n"), "n_children": whole("children"), "n_leaves": whole("leaves"), "saved_tokens": whole("saved"),
        "ends_sha256": pa.array(found["ends_sha256"], pa.string()),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def swept(containers: DataFrame) -> DataFrame:
    """The nodes of all containers; ``top`` marks the heads, whose parents lie in the trie ``above``."""

    def run(batches):
        current, held = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("head", "above", "chars", "depth", "ids", "lengths", "n", "least", "ends")]
            for head, above, chars, depth, *row in zip(*columns):
                if current is None or head != current[0]:
                    if current is not None:
                        yield _sweep_rows(current, held)
                    current, held = (head, above, chars, depth), []
                held.append(row)
        if current is not None:
            yield _sweep_rows(current, held)

    flat = containers.select(
        "head", "above", "chars", "depth", F.col("rest.id").alias("ids"), F.col("rest.chars").alias("lengths"), "n", "least", "ends"
    )
    return flat.repartition("head").sortWithinPartitions("head", "ids").mapInArrow(run, _SWEPT)


def head_nodes(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """``head, above, depth`` and the figures of the nodes that burst, from the deepest level up."""
    figures = ["conv_id", "n_convs", "n_leaves", "saved_tokens"]
    found = []
    for depth in range(len(levels) - 1, -1, -1):
        below = tops.where(F.col("depth") == depth + 1).select(F.col("above").alias("head"), *figures)
        if found:
            below = below.unionByName(found[-1].select(F.col("above").alias("head"), *figures))
        below = below.groupBy("head").agg(
            F.min("conv_id").alias("conv_id"),
            F.count(F.lit(1)).alias("n_children"),
            *[F.sum(c).alias(c) for c in figures[1:]],
        )
        n = F.col("n_convs") + F.coalesce("n", F.lit(0))
        found.append(
            materialize(
                levels[depth].join(below, "head").select(
                    "head",
                    "above",
                    F.lit(depth).cast("long").alias("depth"),
                    F.least("conv_id", "least").alias("conv_id"),
                    n.alias("n_convs"),
                    "n_children",
                    "n_leaves",
                    (F.col("saved_tokens") + (n - 1) * F.col("chars")).alias("saved_tokens"),
                    F.coalesce("ends", F.lit(_NO_ENDS)).alias("ends_sha256"),
                )
            )
        )
    return reduce(DataFrame.unionByName, found)


def prefix_trie(
    turns: DataFrame, block: int = BLOCK, heads: int = HEADS, most_rows: int = MOST_ROWS, most_turns: int = MOST_TURNS
) -> DataFrame:
    """One row per node of the trie of rebuilt ``conv_id, turn, role, text``.

    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``. The limits say when a container bursts and
    change no result.
    """
    rows = classes(rebuilt(materialize(turn_sequences(turns)), block, heads))
    settled, levels = burst(rows, most_rows, most_turns)
    nodes = materialize(swept(reduce(DataFrame.unionByName, settled)))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    if not levels:
        return nodes.select(*columns)
    tops = nodes.where("top")
    inner = head_nodes(levels, tops)
    parents = inner.select(F.col("head").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    joined = tops.drop("head", "top", "parent_conv_id").unionByName(inner.drop("head")).join(parents, "above", "left")
    return nodes.where("not top").select(*columns).unionByName(joined.select(*columns))


def op13_burst_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read_table(spark, sf_dir, "conversations"))


# Unsigned crc32, bit by bit: every byte of the decimal number enters before eight shifts.
OP13_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS said,
        sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))[1:32] AS digest
    FROM conversations WHERE conv_id IS NOT NULL
), own AS (
    SELECT conv_id, list(said ORDER BY turn NULLS FIRST, digest) AS turns FROM turns GROUP BY conv_id
), taken AS (
    SELECT conv_id, turns, conv_id - conv_id % 100 AS donor, xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(conv_id::VARCHAR) + 1),
            lambda i: [ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
        lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1)))) % 6 AS h
    FROM own
), rebuilt AS (
    SELECT t.conv_id, list_concat(coalesce(d.turns, [])[1:t.h], t.turns[t.h + 1:]) AS turns
    FROM taken t LEFT JOIN own d ON d.conv_id = t.donor
), members AS (
    SELECT conv_id, len(turns) AS size, d, turns[1:d] AS path
    FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)
), nodes AS (
    SELECT path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
        coalesce(string_agg(CASE WHEN size = d THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '') AS ends
    FROM members GROUP BY path, d
), children AS (
    SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), sized AS (
    SELECT n.*, coalesce(c.n_children, 0) AS n_children,
        CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(n.path[depth].text) END AS saved
    FROM nodes n LEFT JOIN children c ON c.path = n.path
), above AS (
    SELECT path[1:unnest(range(0, depth + 1))] AS path, saved, n_children FROM sized
), subtrees AS (
    SELECT path, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM above GROUP BY path
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens,
    sha256(n.ends) AS ends_sha256
FROM sized n JOIN subtrees s ON s.path = n.path
LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[1:n.depth - 1]
"""
