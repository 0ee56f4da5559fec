"""Near-duplicate classes: fast similarity sketches, banding, exact verification."""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sketch
from .common import documents, made_schema, packed, row_key, settle, shipped, side, unpacked
from .components import components

shipped(sketch)

WIDTH = 5
#: Coordinates in a band, and how rarely a pair at the threshold may share none.
ROWS, MISS = 5, 5e-7
#: Id tables up to so many rows, of fixed width, are broadcast, larger ones
#: shuffled; up to so many whole sets are written apart and broadcast if small.
BROADCAST_ROWS, SMALL_SETS = 200_000, 5_000


def bands_for(percent: int, rows: int = ROWS) -> int:
    """Bands that a pair at the threshold misses once in two million: 25 for a
    similarity of 0.85, 37 for 0.8."""
    return math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** rows))) if percent < 100 else 1


def similar(both: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    """100 * |a and b| >= percent * |a or b|."""
    return 100 * both >= percent * (n_a + n_b - both)


def _few(ids: DataFrame) -> bool:
    return ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, both, n_a, n_b): items that the two full sets of each pair share,
    and their sizes. Sets of no pair are left out before the shuffle while the
    ids are few. Where all sets of the pairs are few and small they are broadcast,
    so that many pairs among them ship no set; else each pair's go to its task."""
    pairs = settle(pairs)
    ids = settle(pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct())
    n = ids.count()
    if n <= BROADCAST_ROWS:
        sets = sets.join(F.broadcast(ids), "c", "left_semi")
    if n <= SMALL_SETS:
        sets = side(settle(sets))
    left = pairs.join(sets.select(F.col("c").alias("b"), F.col("items").alias("items_b")), "b")
    met = left.join(sets.select(F.col("c").alias("a"), F.col("items").alias("items_a")), "a")
    size = lambda c: F.size(c).cast("long")
    return settle(met.select("a", "b", size(F.array_intersect("items_a", "items_b")).alias("both"), size(F.col("items_a")).alias("n_a"), size(F.col("items_b")).alias("n_b")))


def links_of(counted: DataFrame, percent: int) -> DataFrame:
    return counted.where(similar(F.col("both"), F.col("n_a"), F.col("n_b"), percent)).select("a", "b")


def peel(sets: DataFrame, percent: int) -> DataFrame:
    """(c, n, u, u_all) of the sets that may still be linked with another of ``sets``.

    A set whose share of items found in no other set exceeds 100 - percent has
    no partner. Leaving such sets out makes other items unique, so this repeats
    while a round leaves out a tenth; stopping early is as exact, as it only
    keeps more. u counts the unique items among the sets of the last round,
    u_all those among all ``sets``.
    """
    sets, first = settle(sets.select("c", F.xxhash64("c").alias("h"), "items")), None
    while True:
        held = sets.select("h", F.explode("items").alias("item"))
        alone = held.groupBy("item").agg(F.count(F.lit(1)).alias("k"), F.min("h").alias("h")).where("k = 1").groupBy("h").agg(F.count(F.lit(1)).alias("u"))
        counted = sets.select("c", "h", F.size("items").cast("long").alias("n")).join(alone, "h", "left").withColumn("u", F.coalesce("u", F.lit(0)))
        left = settle(counted.where(100 * F.col("u") <= (100 - percent) * F.col("n")).select("c", "n", "u"))
        before, now = sets.count(), left.count()
        first = left.select("c", F.col("u").alias("u_all")) if first is None else first
        if 10 * (before - now) <= before or not now:
            return left.join(first, "c")
        sets = settle(sets.join(left.select("c"), "c", "left_semi"))


def link_classes(classes: DataFrame, docs: DataFrame, percent: int, width: int = WIDTH) -> DataFrame:
    """(node, component) over the distinct shingle sets ``classes`` (c, row,
    n, bands): every set that shares a band with another. ``row`` is the row key
    of one of the set's rows in ``docs`` (text, _k1, _k2).

    First each band's most central set (the one whose bands are the fullest)
    is compared with the band's other sets: a star, however large the band.
    That joins what lies near the centre of a group. Then, in bands that still
    hold several components, the pairs between components are compared, except
    those that exact bounds rule out: by their unique shingles, and by what each
    shares with the band's centre. Of what x and y have in common, what the
    centre has too is at most the lesser of their shares of it, and the rest at
    most the lesser of their other shingles that are not unique.
    """
    banded = classes.select("c", "row", "n", "bands", F.explode("bands").alias("key"))
    shared = settle(banded.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1"))
    members = settle(banded.drop("bands").join(shared, "key"))
    central = members.groupBy("c").agg(F.sum("held").alias("weight"), F.first("row").alias("row"), F.first("n").alias("n"))
    central = settle(central)
    members = settle(members.select("key", "c").join(central.select("c", "weight", "n"), "c"))
    pivots = settle(members.groupBy("key").agg(F.max(F.struct("weight", "c", "n")).alias("p")).select("key", F.col("p.c").alias("a"), F.col("p.n").alias("n_a")))
    sized = (100 * F.least("n", "n_a") >= percent * F.greatest("n", "n_a")) & (F.col("a") != F.col("c"))
    pairs = members.join(pivots, "key").where(sized).select("a", F.col("c").alias("b")).distinct()
    sets = shingle_sets(docs, central, width)
    tested = overlaps(pairs, sets)
    links = links_of(tested, percent)
    first = settle(components(links.unionByName(central.select(F.col("c").alias("a"), F.col("c").alias("b")))))

    placed = settle(members.select("key", "c").join(first.withColumnRenamed("node", "c"), "c"))
    mixed = settle(placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key"))
    open_rows = settle(placed.join(mixed, "key"))
    left = peel(sets.join(open_rows.select("c").distinct(), "c", "left_semi"), percent)
    rows = open_rows.join(left, "c").join(classes.select("c", "bands"), "c").join(pivots.select("key", "a"), "key")
    rows = rows.join(tested.select("a", F.col("b").alias("c"), "both"), ["a", "c"], "left").withColumn("s", F.when(F.col("a") == F.col("c"), F.col("n")).otherwise(F.col("both")))
    rows = settle(rows.select("key", "c", "component", "n", "u", "bands", "s", (F.col("n") - F.col("s") - F.col("u_all")).alias("o")))
    x, y = (rows.select("key", *[F.col(k).alias(f"{k}_{s}") for k in ("c", "component", "n", "u", "bands", "s", "o")]) for s in "xy")
    common = [F.col(f"n_{s}") - F.col(f"u_{s}") for s in "xy"]
    possible = 100 * F.least(*common) >= percent * (F.col("u_x") + F.col("u_y") + F.greatest(*common))
    through = F.least("s_x", "s_y") + F.least("o_x", "o_y")
    possible &= F.coalesce(F.when(F.col("s_x").isNotNull() & F.col("s_y").isNotNull(), similar(through, F.col("n_x"), F.col("n_y"), percent)), F.lit(True))
    once = F.get(F.filter(F.zip_with("bands_x", "bands_y", lambda p, q: F.when(p == q, p)), lambda p: p.isNotNull()), F.lit(0)) == F.col("key")
    rest = x.join(y, "key").where((F.col("c_x") < F.col("c_y")) & (F.col("component_x") != F.col("component_y")) & possible & once).select(F.col("c_x").alias("a"), F.col("c_y").alias("b"), "component_x", "component_y")
    rest = settle(rest)
    more = links_of(overlaps(rest.select("a", "b"), sets), percent)
    bridges = settle(more.join(rest, ["a", "b"]).select(F.col("component_x").alias("a"), F.col("component_y").alias("b")).distinct())
    second = components(bridges).select(F.col("node").alias("component"), F.col("component").alias("final"))
    return settle(first.join(second, "component", "left").select("node", F.coalesce("final", "component").alias("component")))


def shingle_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(c, items) for the classes ``wanted`` (c, row), from the whole texts."""
    keys = settle(wanted.select("row.*").distinct())
    keys = F.broadcast(keys) if _few(keys) else keys
    texts = docs.join(keys, ["_k1", "_k2"], "left_semi").select("_k1", "text")
    made = texts.mapInArrow(partial(sketch.set_batches, width=width), "c binary, items array<bigint>")
    return settle(made.join(wanted.select("c"), "c", "left_semi").groupBy("c").agg(F.first("items").alias("items")))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = 80, width: int = WIDTH, bands: int | None = None, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Documents are linked if 100 * |common shingles| >= percent * |all shingles|;
    components are what links connect. Equal shingle sets are one class from the
    start, so exact copies cost one sketch each and no pairs. Null, empty and
    blank texts have no shingles: each is its own component. Rows that share an
    id share a component only through their texts; a null id takes part with
    its text but never names a component: a component of null ids alone is
    null, and such rows are kept. Of rows repeating a kept id all are kept.
    """
    out = _placed(docs, text, doc_id, percent, width, bands, rows)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def _placed(docs: DataFrame, text: str, doc_id: str, percent: int, width: int, bands: int | None, rows: int) -> DataFrame:
    """``near_duplicates`` with the row key (_k1, _k2) of each row."""
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    k1, k2 = row_key(F.col("doc_id"), F.col("text"))
    rows_of = docs.select("doc_id", "text", k1.alias("_k1"), k2.alias("_k2"))
    keyed = rows_of.select(F.struct("doc_id", "_k1", "_k2").alias("row"), "text")
    n_bands = bands or bands_for(percent, rows)
    made = keyed.mapInArrow(partial(sketch.sketch_batches, t=n_bands * rows, rows=rows, width=width), made_schema(keyed, ["row"], n_shingles="bigint", digest="binary", bands="array<bigint>"))
    sketched = settle(made.select("row.*", "n_shingles", "digest", "bands"))
    classes = settle(sketched.where("digest IS NOT NULL").groupBy(F.col("digest").alias("c")).agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("_k1", "_k2")).alias("row"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")))
    linked = link_classes(classes.select("c", "row", "n", "bands"), rows_of.drop("doc_id"), percent, width)
    joined = classes.select("c", "doc_id").join(linked, F.col("c") == F.col("node"), "left").select("c", "doc_id", F.coalesce("component", "c").alias("component"))
    least = settle(joined.groupBy("component").agg(F.min("doc_id").alias("component_id")))
    named = settle(joined.join(least, "component").select(F.col("c").alias("digest"), "component_id"))
    out = sketched.drop("bands").join(named, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("_k1", "_k2", "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = 80, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` with one document of each component: its least id.
    Rows that repeat a kept id and text become one row."""
    placed = settle(_placed(docs, text, doc_id, percent, width, None, ROWS).where("kept").groupBy("_k1", "_k2").agg(F.count(F.lit(1)).alias("n")))
    k1, k2 = row_key(F.col("_row")[doc_id], F.col("_row")[text])
    out = packed(docs).withColumn("_k1", k1).withColumn("_k2", k2).join(placed.select("_k1", "_k2"), ["_k1", "_k2"], "left_semi")
    if not placed.where("n > 1").isEmpty():
        out = out.dropDuplicates(["_k1", "_k2"])
    return out.select(*unpacked(docs.columns))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components of all ``documents``; nulls, empty texts, null ids and
    repeated rows as in ``near_duplicates``."""
    return near_duplicates(documents(spark, sf_dir), percent=85)


ORACLE_OP10 = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], chr(10)) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2) p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 85 * (nx.n + ny.n - k)),
r AS (SELECT doc_id, doc_id AS seen FROM d UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.seen),
c AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""
