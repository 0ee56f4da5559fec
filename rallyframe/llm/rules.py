"""Quality rules: per-document counts and cross-document line frequency (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, ascii_lower, documents, let, settle, without, words

WINDOW = 8
#: A line is boilerplate if more than ``MIN_DOCS`` distinct documents of its host
#: hold it, and more than ``MAX_SHARE`` of them or, for a line of ``LONG_LINE``
#: words, more than ``MAX_DOCS``: a large host makes a long line no less copied.
MIN_DOCS = 10
MAX_SHARE = 0.05
LONG_LINE, MAX_DOCS = 5, 100
#: A document is depleted if fewer words, or a smaller share of them, are left.
LEAST_WORDS = 20
LEAST_SHARE_PCT = 30


def repeated_window_words(w: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that the text holds twice or more.

    Windows are compared by 64-bit hashes of their words' hashes. Only texts
    with a repeat go on to sort (hash, position) pairs; repeated positions are
    then merged in order, so the cost is n log n for any text.
    """
    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(h) - (window - 1)), lambda i: F.xxhash64(F.slice(h, i, window)))

    def covered(x: Column) -> Column:
        pairs = F.sort_array(F.transform(x, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        marked = let(pairs, lambda s: F.sort_array(F.transform(F.filter(s, lambda p, i: F.coalesce(F.get(s, i - 1)["h"] == p["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == p["h"], F.lit(False))), lambda p: p["i"])))
        return let(marked, lambda m: F.aggregate(F.transform(m, lambda p, i: F.least(F.lit(window), F.coalesce(F.get(m, i + 1) - p, F.lit(window)))), F.lit(0).cast("long"), lambda a, n: a + n))

    hashes = F.transform(w, lambda x: F.xxhash64(x))
    return F.when(F.size(w) <= window, F.lit(0).cast("long")).otherwise(
        let(let(hashes, windows), lambda x: F.when(F.size(F.array_distinct(x)) == F.size(x), F.lit(0).cast("long")).otherwise(covered(x))))


def text_counts(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.trim(x, F.lit(SPACE_CHARS)) != "")
    return let(words(t), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_window_words(w).alias("n_repeat_words")))


def line_profile(text: Column) -> Column:
    """(hash, words) of each line with a word; lines are compared in lower case
    with digits as 0 and white space squeezed. All but the trimming is done on
    the whole text, before it is cut into lines."""
    plain = F.regexp_replace(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), "[0-9]+", "0"), r"[\x20\x09\x0B-\x0D]+", " ")
    lines = F.filter(F.transform(F.split(plain, "\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("line"), F.size(F.split(x, " ")).alias("words")))


def judge_documents(docs: DataFrame, text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, max_docs: int = MAX_DOCS, carry: tuple[str, ...] = ("doc_id",), copies: bool = False) -> DataFrame:
    """One row per row of ``docs``: its counts, the words left after boilerplate
    lines go, base_failed and kept.

    Boilerplate: lines held by more than ``min_docs`` distinct documents of the
    host, and by more than ``max_share`` of them or, with ``LONG_LINE`` words,
    more than ``max_docs``. Documents are distinct by their texts, so that a
    document isn't boilerplate for having copies; with ``copies``, each row is a
    document. Null and empty texts have zero counts and fail; a null host is a
    host of its own; repeated rows each get their result; empty tables give
    empty results. A carried column with the name of a result is left out.
    """
    results = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_left")
    carry = without(carry, *results)
    row = F.struct(*[F.col(f"`{c}`") for c in carry], F.lit(0).alias("_")).alias("_row")
    the_text = F.col(f"`{text}`")
    t1, t2 = F.xxhash64(F.coalesce(the_text, F.lit(""))), F.hash(F.coalesce(the_text, F.lit("")))
    parsed = settle(docs.select(row, F.col(f"`{host}`").alias("_host"), t1.alias("_t1"), t2.alias("_t2"), text_counts(the_text).alias("_n"), line_profile(the_text).alias("_lines")))
    distinct = settle(parsed.groupBy("_host", "_t1", "_t2").agg(F.first("_lines").alias("_lines"), F.count(F.lit(1)).alias("_rows")))
    documents_of = F.sum("_rows") if copies else F.count(F.lit(1))
    per_host = distinct.groupBy("_host").agg(documents_of.alias("_of"))
    counted = (distinct.select("_host", "_rows", F.explode(F.array_distinct("_lines")).alias("_l")).select("_host", "_rows", F.col("_l.line").alias("_line"), F.col("_l.words").alias("_words"))
               .groupBy("_host", "_line").agg(documents_of.alias("_docs"), F.first("_words").alias("_words")).where(F.col("_docs") > min_docs))
    above = (F.col("_docs") > F.col("_of") * max_share) | (F.col("_docs") > max_docs) & (F.col("_words") >= LONG_LINE)
    frequent = settle(counted.alias("c").join(per_host.alias("h"), F.expr("c._host <=> h._host")).where(above).select("c._host", "_line"))
    found = distinct.select("_host", "_t1", "_t2", F.explode("_lines").alias("_l")).select("_host", "_t1", "_t2", F.col("_l.line").alias("_line"), F.col("_l.words").alias("_words"))
    gone = (found.alias("f").join(frequent.alias("q"), F.expr("f._line = q._line AND f._host <=> q._host"))
            .groupBy("f._host", "_t1", "_t2").agg(F.sum("_words").alias("_gone")))
    left = F.col("_n.n_words") - F.coalesce(F.col("_gone"), F.lit(0))
    base = (F.col("_n.n_words") < LEAST_WORDS) | (100 * F.col("_n.n_repeat_words") > 30 * F.col("_n.n_words"))
    return (parsed.alias("p").join(gone.alias("g"), F.expr("p._t1 = g._t1 AND p._t2 = g._t2 AND p._host <=> g._host"), "left")
            .select(*[F.col("p._row")[c].alias(c) for c in carry], *[F.col(f"_n.{c}").alias(c) for c in results[:5]],
                    base.alias("base_failed"), (~base & (left >= LEAST_WORDS) & (100 * left >= LEAST_SHARE_PCT * F.col("_n.n_words"))).alias("kept"), left.cast("long").alias("words_left")))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules over all ``documents``, by source; nulls, empty and repeated
    texts as in ``judge_documents``."""
    return judge_documents(documents(spark, sf_dir))


ORACLE_OP5 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM d),
wins AS (SELECT rid, i, array_to_string(w[i:i+7], ' ') AS win FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
marked AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM wins),
gaps AS (SELECT rid, least(8, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 8)) AS c FROM marked WHERE n > 1),
rep AS (SELECT rid, sum(c)::BIGINT AS n FROM gaps GROUP BY rid),
base AS (SELECT w.rid, doc_id, source, t, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep USING (rid)),
texts AS (SELECT DISTINCT source, t FROM d),
ln AS (SELECT source, t, trim(regexp_replace(regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS line
  FROM (SELECT source, t, unnest(string_split(t, chr(10))) AS x FROM texts)),
freq AS (SELECT l.source, l.line FROM (SELECT source, line, count(DISTINCT t) AS n FROM ln WHERE line <> '' GROUP BY ALL HAVING count(DISTINCT t) > 10) l
  JOIN (SELECT source, count(*) AS n FROM texts GROUP BY source) h ON l.source IS NOT DISTINCT FROM h.source
  WHERE l.n > h.n * 0.05 OR l.n > 100 AND len(string_split(l.line, ' ')) >= 5),
gone AS (SELECT ln.source, ln.t, sum(len(string_split(ln.line, ' '))) AS n FROM ln JOIN freq ON ln.line = freq.line AND ln.source IS NOT DISTINCT FROM freq.source GROUP BY ln.source, ln.t),
o AS (SELECT b.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, n_words - coalesce(g.n, 0) AS words_left
  FROM base b LEFT JOIN gone g ON b.t = g.t AND b.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND words_left >= 20 AND 100 * words_left >= 30 * n_words AS kept, words_left::BIGINT AS words_left FROM o
"""
