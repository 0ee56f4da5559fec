"""Benchmark decontamination with a positional inverted index (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, documents, let, packed, row_key, settle, side, unpacked, without

#: What lies between words: ASCII that is no letter or digit. Fixed value.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
#: A proximity match is an item of which this share of words occurs in place, or
#: up to ``SLACK`` words inserted or deleted on the way, without an exact window.
NEAR_SHARE, SLACK = 0.5, 4


def terms(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN, -1), "")


def rarest_terms(items: DataFrame, docs_terms: DataFrame, window: int) -> DataFrame:
    """For every window of every item the two positions whose terms are rarest
    in the corpus: rows (term, item, at, need), distinct over an item's windows.

    Terms that the corpus lacks are passed over: such a window can't occur, but
    may be met nearly. Windows with fewer than two known terms are left out.
    ``need`` is 1 for items of one word, which have a single position.
    """
    at = items.select("item", F.posexplode("item_terms").alias("at", "term"), F.size("item_terms").alias("len"))
    vocabulary = settle(at.select("term").distinct())
    frequency = settle(docs_terms.select(F.explode("terms").alias("term")).join(side(vocabulary), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n")))
    ranked = at.join(frequency, "term", "left").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("at", "term", "n"))).alias("all"))
    width = F.least(F.size("all"), F.lit(window))
    each = ranked.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.size("all") - width + 1), lambda s: F.slice("all", s, width))).alias("win"))
    known = F.filter("win", lambda t: t["n"].isNotNull())
    each = each.where(F.size(known) >= F.least(F.size("win"), F.lit(2)))
    order = F.sort_array(F.transform(known, lambda t: F.struct(t["n"].alias("n"), t["at"].alias("at"), t["term"].alias("term"))))
    return settle(each.select("item", F.explode(F.slice(order, 1, 2)).alias("t"), F.least(F.size("win"), F.lit(2)).alias("need"))
                  .select(F.col("t.term").alias("term"), "item", F.col("t.at").alias("at"), "need").distinct())


def exact_runs(equal: Column, width: Column) -> Column:
    """[start, end) of the maximal runs of true of at least ``width``."""
    breaks = let(equal, lambda e: F.concat(F.array(F.lit(-1)), F.filter(F.sequence(F.lit(0), F.size(e) - 1), lambda j: ~F.get(e, j)), F.array(F.size(e))))
    return let(breaks, lambda b: F.filter(F.transform(F.slice(b, 1, F.size(b) - 1), lambda x, i: F.struct((x + 1).alias("start"), F.get(b, i + 1).alias("end"))), lambda r: r["end"] - r["start"] >= width))


def phrase_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, near_share: float = NEAR_SHARE, slack: int = SLACK) -> DataFrame:
    """Rows (_k1, _k2, exact, near) for the distinct document contents with a match.

    The index holds postings (term, document, position) of the terms that are
    the rarest or second rarest of some benchmark window; no others are stored.
    Each item's lists are shifted by the term's place in the item and intersected
    on (document, shift); a window can only occur where both its rarest terms
    meet. At each shift that survives, the stretch of the document that lies
    against the item becomes a row of its own and is compared with the item word
    by word, so no row holds more than two texts of an item's length.

    exact: (item, start, end) of maximal runs of at least a window (an item of
    fewer words: all of it), in words of the document. near: (item, start,
    equal) where ``near_share`` of the item's words agree at a shift or at shifts
    up to ``slack`` above it, as after words inserted or deleted, and no shift
    among them has an exact run; a shift is only tried where both rarest terms
    of some window meet. Null and empty texts or items have no terms and
    match nothing; repeated rows share their match through the row key; a null
    item id is kept as null.
    """
    k1, k2 = row_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))
    keyed = docs.select(k1.alias("_k1"), k2.alias("_k2"), F.col(f"`{text}`").alias("_text"))
    items = settle(benchmark.select(F.xxhash64(F.col(f"`{item_id}`"), F.col(f"`{item_text}`")).alias("item"), F.col(f"`{item_id}`").cast("string").alias("item_id"), terms(F.col(f"`{item_text}`")).alias("item_terms")).where(F.size("item_terms") > 0).distinct())
    rare = rarest_terms(items, keyed.select(terms(F.col("_text")).alias("terms")), window)
    wanted = settle(rare.select("term").distinct())
    postings = settle(keyed.select("_k1", "_k2", F.posexplode(terms(F.col("_text"))).alias("pos", "term")).join(side(wanted), "term"))
    shifts = (postings.join(side(rare), "term").withColumn("shift", F.col("pos") - F.col("at"))
              .groupBy("_k1", "_k2", "item", "shift").agg(F.collect_set("at").alias("met"), F.max("need").alias("need"), F.min("need").alias("least"))
              .where(F.size("met") >= F.col("least")).select("_k1", "_k2", "item", "shift"))
    lengths = settle(items.select("item", F.size("item_terms").alias("of")).distinct())
    # Fixed-width tries: at most one for each shift of an item in the document.
    tries = settle(shifts.join(side(lengths), "item").groupBy("_k1", "_k2").agg(F.collect_list(F.struct("item", "shift", "of")).alias("tries")))
    holders = side(settle(tries.select("_k1", "_k2")))
    texts = keyed.join(holders, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"])
    stretch = lambda w, t: F.slice(w, F.greatest(t["shift"], F.lit(0)) + 1, F.greatest(t["of"] + F.least(t["shift"], F.lit(0)), F.lit(0)))
    laid = texts.join(tries, ["_k1", "_k2"]).select("_k1", "_k2", F.explode(let(terms(F.col("_text")), lambda w: F.transform(F.col("tries"), lambda t: F.struct(t["item"].alias("item"), t["shift"].alias("shift"), stretch(w, t).alias("words"))))).alias("t"))
    laid = laid.select("_k1", "_k2", "t.*").join(side(items), "item")
    equal = F.transform("item_terms", lambda x, j: F.coalesce(F.get(F.col("words"), j + F.least(F.col("shift"), F.lit(0))) == x, F.lit(False)))
    places = let(equal, lambda e: F.struct(
        exact_runs(e, F.least(F.size(e), F.lit(window))).alias("runs"),
        F.filter(F.transform(e, lambda y, j: F.when(y, j)), lambda j: j.isNotNull()).alias("places")))
    compared = laid.select("_k1", "_k2", "item", "item_id", "shift", F.size("item_terms").alias("of"), places.alias("p"))
    # All shifts of an item in a document, and so at most a row for each of its words' places.
    per_item = compared.groupBy("_k1", "_k2", "item", "item_id").agg(F.first("of").alias("of"), F.sort_array(F.collect_list(F.struct("shift", F.col("p.runs").alias("runs"), F.col("p.places").alias("places")))).alias("all"))
    exact = F.flatten(F.transform("all", lambda t: F.transform(t["runs"], lambda r: F.struct(F.col("item_id").alias("item_id"), (t["shift"] + r["start"]).alias("start"), (t["shift"] + r["end"]).alias("end")))))

    def banded(t: Column, i: Column) -> Column:
        """Places that agree at this shift or one up to ``slack`` above, and whether one has a run."""
        band = F.filter(F.slice("all", i + 1, slack + 1), lambda o: o["shift"] <= t["shift"] + slack)
        return F.struct(F.col("item_id").alias("item_id"), t["shift"].alias("start"), F.size(F.array_distinct(F.flatten(F.transform(band, lambda o: o["places"])))).alias("equal"), F.exists(band, lambda o: F.size(o["runs"]) > 0).alias("run"))

    tried = F.filter(F.transform("all", banded), lambda b: ~b["run"] & (b["equal"] >= F.ceil(F.col("of") * near_share)))
    # Of neighbouring shifts that reach the share, the best one stands for them.
    best = F.filter(tried, lambda b: ~F.exists(tried, lambda o: (F.abs(o["start"] - b["start"]) <= slack) & ((o["equal"] > b["equal"]) | (o["equal"] == b["equal"]) & (o["start"] < b["start"]))))
    near = F.transform(best, lambda b: F.struct(b["item_id"].alias("item_id"), b["start"].alias("start"), b["equal"].alias("equal")))
    found = per_item.select("_k1", "_k2", exact.alias("exact"), near.alias("near")).where((F.size("exact") > 0) | (F.size("near") > 0))
    return found.groupBy("_k1", "_k2").agg(F.array_sort(F.flatten(F.collect_list("exact"))).alias("exact"), F.array_sort(F.flatten(F.collect_list("near"))).alias("near"))


def covered_words(spans: Column) -> Column:
    """Positions inside any of the (start, end) spans, each counted once."""
    merged = lambda a, s: F.struct((a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["upto"]), F.lit(0))).alias("n"), F.greatest(a["upto"], s["end"]).alias("upto"))
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    return F.aggregate(ordered, F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")), merged, lambda a: a["n"].cast("long"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] | None = None, **options) -> DataFrame:
    """``docs``, or its columns ``carry``, with _n_words, _exact and _near (empty
    arrays without a match); see ``phrase_matches``. Null and empty texts have no
    words and no match; repeated rows each get theirs; own columns of the three
    names are replaced; empty tables give empty results or none that match."""
    matches = phrase_matches(docs, benchmark, text=text, doc_id=doc_id, **options)
    columns = without(carry if carry is not None else docs.columns, "_n_words", "_exact", "_near")
    the_id, the_text = F.col("_row")[doc_id], F.col("_row")[text]
    k1, k2 = row_key(the_id, the_text)
    mine = packed(docs).withColumns({"_k1": k1, "_k2": k2, "_n_words": F.size(terms(the_text)).cast("long")}).select(F.struct(*unpacked(columns)).alias("_row"), "_k1", "_k2", "_n_words")
    out = mine.join(matches, ["_k1", "_k2"], "left")
    none = lambda kind: F.array().cast(kind)
    return out.select(*unpacked(columns), "_n_words", F.coalesce("exact", none("array<struct<item_id:string,start:int,end:int>>")).alias("_exact"), F.coalesce("near", none("array<struct<item_id:string,start:int,equal:int>>")).alias("_near"))


def contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact matches of all of ``benchmark`` in all ``documents``; nulls, empty
    and repeated texts as in ``decontaminate``."""
    out = decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=("doc_id",))
    ids = F.array_sort(F.array_distinct(F.transform("_exact", lambda s: s["item_id"])))
    return out.withColumn("_hit", covered_words(F.col("_exact"))).select(
        "doc_id", F.col("_n_words").alias("n_words"), F.col("_hit").alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), contaminated(F.col("_hit"), F.col("_n_words")).alias("contaminated"))


ORACLE_OP6 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
i AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM i)),
dw AS (SELECT rid, n, s, array_to_string(w[s:s + n - 1], ' ') AS win FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
m AS (SELECT rid, item_id, s, dw.n FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM m) GROUP BY rid),
f AS (SELECT rid, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT rid, item_id FROM m) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN f USING (rid)
"""
