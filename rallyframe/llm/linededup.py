"""Line dedup over overlapping three-line windows (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, documents, let, packed, row_key, settle, unpacked

WINDOW = 3


def numbered_lines(text: Column) -> Column:
    """(at, line) of the lines that have a word: place among all lines from 0,
    white space squeezed and trimmed."""
    squeezed = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x, i: F.struct(i.alias("at"), F.trim(F.regexp_replace(x, SPACE, " ")).alias("line")))
    return F.filter(squeezed, lambda x: x["line"] != "")


def windows_of(lines: Column, window: int) -> Column:
    """(w1, w2, at) of every run of ``window`` lines with words; a text of
    fewer such lines, but not none, is one run."""
    width = let(F.size(lines), lambda n: F.least(n, F.lit(window)))
    hashed = F.transform(lines, lambda x: x["line"])
    return F.when(F.size(lines) == 0, F.array().cast("array<struct<w1:bigint,w2:int,at:int>>")).otherwise(let(F.struct(hashed.alias("h"), width.alias("w")), lambda c: F.transform(
        F.sequence(F.lit(0), F.size(c["h"]) - c["w"]),
        lambda i: let(F.slice(c["h"], i + 1, c["w"]), lambda s: F.struct(F.xxhash64(s, c["w"]).alias("w1"), F.hash(s, F.lit(1)).alias("w2"), i.alias("at"))))))


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """``docs`` with its text less the lines of repeated windows, and
    ``_n_lines``, ``_n_removed``: lines with a word, before and removed.

    A window is ``window`` consecutive lines with words. All occurrences but
    the first go, in the order of document id (null first), then content hash,
    then place; overlapping ones merge, so a line goes once. Lines without a
    word stay. Null texts stay null and empty ones empty; rows that repeat an
    id and text count as one document and get the same result. Two passes over
    the windows, both split by their hash: a count with the first occurrence,
    and a join with the repeated ones, whose hot hashes the engine splits.
    """
    columns, docs = docs.columns, packed(docs)
    the_id, the_text = F.col("_row")[doc_id], F.col("_row")[text]
    k1, k2 = row_key(the_id, the_text)
    place = settle(docs.select(the_id.alias("_id"), k1.alias("_k1"), k2.alias("_k2"), F.explode(let(numbered_lines(the_text), lambda x: windows_of(x, window))).alias("w"))
                   .select("w.w1", "w.w2", "_id", "_k1", "_k2", "w.at"))
    here = F.struct("_id", "_k1", "_k2", "at")
    repeated = settle(place.groupBy("w1", "w2").agg(F.min(here).alias("first"), F.max(here).alias("last")).where(~F.col("first").eqNullSafe(F.col("last"))).drop("last"))
    later = (place.join(repeated, ["w1", "w2"]).where(~here.eqNullSafe(F.col("first")))
             .groupBy("_k1", "_k2").agg(F.collect_set("at").alias("_starts")))
    starts = F.coalesce(F.col("_starts"), F.array().cast("array<int>"))

    def cut(c: Column) -> Column:
        covered = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.sequence(i, F.least(i + window - 1, F.size(c["lines"]) - 1)))))
        gone = let(covered, lambda v: F.transform(v, lambda i: F.get(c["lines"], i)["at"]))
        return let(gone, lambda g: F.struct(
            F.size(c["lines"]).alias("n"), F.size(g).alias("gone"),
            F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(c["all"]) - 1), g), lambda i: F.get(c["all"], i)), "\n").alias("text")))

    both = F.struct(F.split(F.coalesce(the_text, F.lit("")), "\n", -1).alias("all"), numbered_lines(the_text).alias("lines"))
    done = (docs.withColumn("_k1", k1).withColumn("_k2", k2).join(later, ["_k1", "_k2"], "left").withColumn("_cut", let(both, cut)))
    new_text = F.when(F.size(starts) > 0, F.col("_cut.text")).otherwise(the_text)
    own = [c for c in columns if c.lower() not in ("_n_lines", "_n_removed")]
    return done.select(*unpacked(own, **{text: new_text}), F.col("_cut.n").cast("long").alias("_n_lines"), F.col("_cut.gone").cast("long").alias("_n_removed"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), "text")


ORACLE_OP9 = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS raw, text FROM documents),
l AS (SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM (
  SELECT doc_id, pos, trim(regexp_replace(raw[pos + 1], '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS line FROM (SELECT doc_id, raw, unnest(range(0, len(raw))) AS pos FROM d)) WHERE line <> ''),
w AS (SELECT doc_id, i, n, concat_ws(chr(10), line, CASE WHEN n > 1 THEN lead(line) OVER o END, CASE WHEN n > 2 THEN lead(line, 2) OVER o END) || '/' || least(n, 3) AS win
  FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS r FROM w WHERE i + least(n, 3) <= n),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(0, 3)) AS i FROM ranked WHERE r > 1),
cut AS (SELECT l.doc_id, l.pos FROM l JOIN gone USING (doc_id, i)),
n AS (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n, list(pos) AS all_pos FROM cut GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_lines, coalesce(c.n, 0)::BIGINT AS n_removed,
  CASE WHEN c.n IS NULL THEN d.text ELSE array_to_string([raw[j + 1] for j in range(0, len(raw)) if NOT list_contains(c.all_pos, j)], chr(10)) END AS text
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
