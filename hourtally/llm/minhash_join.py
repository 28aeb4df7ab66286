"""Near duplicates by an inverted join over the coordinates of minhash signatures.

Documents with equal shingle sets are one class and travel as its smallest id.
Classes are posted under each (coordinate, value) of their signature. Two sets
of similarity 0.8 agree in about 0.8 of the coordinates; a pair must agree in
``match`` of them, and such a pair shares one of the ``coordinates - match + 1``
rarest values of either class (all classes order values by one total order), so
only these are posted. The remaining coordinates are skipped to: a pair's other
collisions are read off its signatures, and what passes is confirmed on the
full sets.

With the defaults a pair at exactly 0.8 is missed with probability below 1e-6;
nothing else is dropped.

A posting list is never turned into all its pairs. First its members are
compared with a few hubs of the list; the first hub is the member whose values
most others share, which is near the middle of a group of near copies, so most
of such a group is joined at once. What still shares a list with another
component is compared by how it differs from the list's first hub: sets X and Y
that differ from hub H in D(X) and D(Y) differ in |D(X)| + |D(Y)| - 2 |D(X) & D(Y)|
shingles. What near copies have in common is in no difference, and a bound by
sizes and by the differences that anyone shares tells most classes apart from
all others without a pair. This step is exact; its pairs need no collisions.

Defined results: null and empty texts have no shingles and no links. A null
``doc_id`` is linked with nothing and has no component. Rows repeated with one
``doc_id`` share its outcome if their texts are equal; rows with one ``doc_id``
and different texts are documents of their own, each in the component of its text.
Columns other than ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hourtally.llm.common import read_table
from hourtally.llm.components import components
from hourtally.llm.shingles import full_sets, set_signatures
from hourtally.session import materialize

COORDINATES = 64
MATCH = 34
HUBS = 3
SALTS = 8  # parts of the lists and hubs that most rows may be joined with


def prefix_posts(classes: DataFrame, coordinates: int, match: int) -> DataFrame:
    """``key, digest, weight``: each class under its rarest shared values, as many as can matter.

    A value of one class alone counts as one of its rarest but is not posted. A
    class with fewer than ``match`` shared values has no partner. The weight is
    the number of collisions of a class with all others.
    """
    posts = classes.select("digest", F.posexplode("signature").alias("at", "value")).select(
        "digest", (F.shiftleft(F.col("at").cast("long"), 32) + F.col("value")).alias("key")
    )
    shared = posts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    own = Window.partitionBy("digest")
    return (
        posts.join(shared, "key")
        .withColumn("turn", F.row_number().over(own.orderBy("n", "key")))
        .withColumn("shared", F.count(F.lit(1)).over(own))
        .withColumn("weight", F.sum("n").over(own))
        .where(F.col("turn") <= F.col("shared") - (match - 1))
        .select("key", "digest", "weight")
    )


def _salt(column: str = "digest") -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int").alias("salt")


def _every_salt() -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")


def list_hubs(posts: DataFrame, hubs: int) -> DataFrame:
    """``key, salt, hub0, hub1, ...``: the weightiest member of each list, then the least under seeded orders."""

    def hub(i):
        return F.max_by("digest", F.struct("weight", "digest")) if i == 0 else F.min_by("digest", F.xxhash64("digest", F.lit(i)))

    lists = posts.groupBy("key").agg(*[hub(i).alias(f"hub{i}") for i in range(hubs)])
    return lists.select("*", _every_salt())


def hub_pairs(posts: DataFrame, lists: DataFrame) -> DataFrame:
    """Every member of a list with the list's hubs."""
    names = [c for c in lists.columns if c.startswith("hub")]
    joined = posts.select("key", "digest", _salt()).join(lists, ["key", "salt"])
    return ordered_pairs(joined.select("digest", F.explode(F.array(*names)).alias("hub")), "digest", "hub")


def ordered_pairs(rows: DataFrame, left: str, right: str) -> DataFrame:
    return (
        rows.where(F.col(left) != F.col(right))
        .select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b"))
        .distinct()
    )


def open_members(posts: DataFrame, lists: DataFrame, labels: DataFrame) -> DataFrame:
    """``hub, digest, label`` of the members of lists that hold more than one component, with the first hub."""
    marked = posts.join(labels, posts["digest"] == labels["node"], "left").select(
        "key", "digest", _salt(), F.coalesce("label", "digest").alias("label")
    )
    ends = marked.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most")
    still = lists.select("key", "salt", F.col("hub0").alias("hub")).join(ends.select("key"), "key", "left_semi")
    return marked.join(still, ["key", "salt"]).select("hub", "digest", "label").distinct()


def differences(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``hub, digest, label, n, m, d, diff``: in which shingles the sets of n shingles differ from their hub's m."""
    salted = members.select("*", _salt()).join(sets, "digest")
    hubs = sets.select(F.col("digest").alias("hub"), F.col("shingles").alias("middle"))
    hubs = hubs.join(members.select("hub").distinct(), "hub", "left_semi").select("*", _every_salt())
    both = salted.join(hubs, ["hub", "salt"])
    diff = F.concat(F.array_except("shingles", "middle"), F.array_except("middle", "shingles"))
    found = both.select("hub", "digest", "label", F.size("shingles").alias("n"), F.size("middle").alias("m"), diff.alias("diff"))
    return found.withColumn("d", F.size("diff"))


def difference_pairs(differing: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of one hub in different components that may be similar.

    Sets of n and n' shingles are similar enough if they differ in at most
    ``share`` * (n + n'), ``share`` = (100 - percent) / (100 + percent). So their
    differences from the hub must have at least ``need`` = (d + d' - share * (n + n')) / 2
    shingles in common, and one of them is further from the hub than a link: two
    that are linked with it are in one component. A set shares one of as many
    of its rarest differences as the least ``need`` of any partner leaves.
    """
    share = (100 - percent) / (100 + percent)
    keys = ["hub", "shingle"]
    far = (100 + percent) * F.col("d") > (100 - percent) * (F.col("n") + F.col("m"))
    elements = differing.withColumn("far", far).select("hub", "digest", "label", "n", "m", "d", "far", F.explode("diff").alias("shingle"))
    often = elements.groupBy(*keys).agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    own = Window.partitionBy("hub", "digest")
    ranked = (
        elements.join(often, keys)
        .withColumn("s", F.count(F.lit(1)).over(own))
        .withColumn("at", F.col("d") - F.col("s") + F.row_number().over(own.orderBy("f", "shingle")))
    )
    d, n, m = F.col("d"), F.col("n"), F.col("m")
    closest = F.when(F.col("far"), d - share * (n + m)).otherwise(d + share * (m - n)) / 2
    least = F.ceil(F.greatest(closest, d - share * n * (1 + 100 / percent), F.lit(1.0)) - 1e-6)
    placed = materialize(ranked.where(F.col("at") <= d - least + 1).drop("f", "m"))
    # What the best partner in the group can make up for decides whether a member has any.
    gain = 2 * F.col("s") - d + share * n
    best = materialize(
        placed.groupBy("hub").agg(F.max(gain).alias("best"), F.max(F.when(F.col("far"), gain)).alias("best_far"))
    )
    limit = F.when(F.col("far"), F.col("best")).otherwise(F.col("best_far"))
    useful = placed.join(best, "hub").where(d - share * n <= limit + 1e-6).drop("best", "best_far")

    def side(rows, name):
        return rows.select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in ("digest", "label", "n", "d", "s", "at", "far")])

    useful = materialize(useful)
    x, y = (lambda c: F.col(f"x_{c}")), (lambda c: F.col(f"y_{c}"))
    need = F.ceil((x("d") + y("d") - share * (x("n") + y("n"))) / 2 - 1e-6)
    met = side(useful.where("far"), "x").join(side(useful, "y"), keys).where(
        (x("label") != y("label"))
        & (~y("far") | (x("digest") < y("digest")))
        & (100 * F.least(x("n"), y("n")) >= percent * F.greatest(x("n"), y("n")))
        & (F.least(x("s"), y("s")) >= need)
        & (x("at") <= x("d") - need + 1)
        & (y("at") <= y("d") - need + 1)
    )
    pair = ["hub", *[f"{name}_{c}" for name in "xy" for c in ("digest", "n", "d")]]
    counted = met.groupBy(*pair).agg(F.count(F.lit(1)).alias("met"), F.max("x_at").alias("x_at"), F.max("y_at").alias("y_at"))
    most = F.col("met") + F.least(x("d") - x("at"), y("d") - y("at"))
    return ordered_pairs(counted.where(most >= need), "x_digest", "y_digest")


def confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame, match: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` that collide ``match`` times and whose full sets are similar enough."""

    def side(name):
        return classes.select(
            F.col("digest").alias(name), F.col("signature").alias(f"{name}_sig"), F.col("n_shingles").alias(f"{name}_n")
        )

    def whole(name):
        return sets.select(F.col("digest").alias(name), F.col("shingles").alias(f"{name}_set"))

    near = pairs
    if match:
        near = (
            pairs.join(side("a"), "a")
            .join(side("b"), "b")
            .where(100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n"))
            .where(F.size(F.filter(F.zip_with("a_sig", "b_sig", lambda x, y: x == y), lambda same: same)) >= match)
            .select("a", "b")
        )
    common = F.size(F.array_intersect("a_set", "b_set"))
    return (
        materialize(near)
        .join(whole("a"), "a")
        .join(whole("b"), "b")
        .select("a", "b", common.alias("both"), (F.size("a_set") + F.size("b_set") - common).alias("any"))
        .where(100 * F.col("both") >= percent * F.col("any"))
        .select("a", "b")
    )


def near_duplicates(
    docs: DataFrame,
    shingle_words: int = 5,
    percent: int = 80,
    coordinates: int = COORDINATES,
    match: int = MATCH,
    hubs: int = HUBS,
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``doc_id, text``.

    Documents are linked when 100 * intersection >= ``percent`` * union of their
    sets of ``shingle_words``-word shingles; ``component_id`` is the smallest
    ``doc_id`` reachable over links, the document itself included.
    """
    signed = materialize(set_signatures(docs, shingle_words, coordinates))
    classes = materialize(
        signed.where("digest is not null and doc_id is not null")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    )
    posts = materialize(prefix_posts(classes, coordinates, match))
    lists = materialize(list_hubs(posts, hubs))
    posted = materialize(classes.join(posts, "digest", "left_semi").select("digest", F.col("rep").alias("doc_id")))
    chosen = docs.select("doc_id", "text").join(posted.select("doc_id").distinct(), "doc_id", "left_semi")
    whole = full_sets(chosen, shingle_words).join(posted.select("digest"), "digest", "left_semi")
    sets = materialize(whole.groupBy("digest").agg(F.first("shingles").alias("shingles")))
    links = materialize(confirmed(hub_pairs(posts, lists), classes, sets, match, percent))
    first = materialize(components(links))
    differing = materialize(differences(open_members(posts, lists, first), sets))
    near = differing.where((100 + percent) * F.col("d") <= (100 - percent) * (F.col("n") + F.col("m")))
    further = confirmed(difference_pairs(differing, percent), classes, sets, 0, percent)
    more = materialize(ordered_pairs(near, "hub", "digest").unionByName(further))
    labels = first if more.isEmpty() else materialize(components(links.unionByName(more)))
    of_class = classes.join(labels, classes["digest"] == labels["node"], "left").select(
        "digest", "rep", F.coalesce("label", "digest").alias("label")
    )
    smallest = of_class.groupBy("label").agg(F.min("rep").alias("component"))
    named = of_class.join(smallest, "label").select("digest", "component")
    joined = signed.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    label = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select("doc_id", "n_shingles", label.alias("component_id"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, without the documents of a component but its smallest id.

    Those that go are few beside those that stay, so Spark may broadcast their
    ids. Rows with a null ``doc_id`` stay.
    """
    gone = near_duplicates(docs, **options).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(materialize(gone), "doc_id", "left_anti").select(*docs.columns)


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"), shingle_words=4)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


OP8_SQL = r"""
WITH RECURSIVE split AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM split WHERE len(w) > 0)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
    FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id < y.doc_id
    GROUP BY 1, 2
), links AS (
    SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
    WHERE 100 * shared >= 80 * (p.n + q.n - shared)
), ways AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
    SELECT doc_id, doc_id AS other FROM documents
    UNION
    SELECT reach.doc_id, ways.b FROM reach JOIN ways ON reach.other = ways.a
), least_id AS (
    SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM least_id LEFT JOIN sizes USING (doc_id)
"""
