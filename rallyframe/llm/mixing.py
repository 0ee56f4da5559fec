"""Mixing sources to target weights with Efraimidis-Spirakis keys (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, let, settle, without, words

#: Words in a window of ``quality_weight``.
WINDOW = 16


def uniform(*parts: Column) -> Column:
    """A reproducible number in (0, 1) from the MD5 of the parts."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def source_targets(sizes: DataFrame, cap: float = 3.0, cycle: int = 3) -> DataFrame:
    """Targets for (source, source_size): weights 1..cycle by code point order,
    null last, sharing the total; a target stops at ``cap`` times its source.

    Closed form of "reshare until none is above": in the order of cap / weight,
    the capped sources are a prefix, and the rest share what remains by weight.
    One row per source passes through the single ordered window.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    level = (F.col("total") - F.col("capped_before")) / F.col("weight_from")
    return (
        sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % cycle + 1).cast("double"))
        .withColumn("cap", F.lit(cap) * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("capped_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_from", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.max(F.when(F.col("ratio") >= level, level)).over(everything))
        .withColumn("target", F.round(F.coalesce(F.least(F.col("cap"), F.col("weight") * F.col("level")), F.col("cap")), 6))
        .select("source", "source_size", "target")
    )


def mix(docs: DataFrame, size: Column, weight: Column, source: str = "source", doc_id: str = "doc_id", text: str = "text", seed: int = 0, cap: float = 3.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """How many words the mix takes of each document.

    Each document gets the key -ln(u) / weight, with u from its id and text:
    ascending keys are a weighted draw without replacement. A source whose target
    is e times its size plus a rest gives every document e times, then its
    documents in key order until the rest is spent; the document that crosses
    the rest is taken if that comes nearer to it. The n keys of a source fall
    into the root of n ordered buckets, whose sums fix the bucket where the rest
    ends, so about as many bucket sums as rows of one bucket are sorted.

    Returns doc_id, size, source, source_size, target, taken and ``carry``, less
    its columns of these names. Null or empty texts have size 0 and are taken 0
    times; a null source is a source of its own, last in order; weights that are
    null or not positive count as the smallest, 1e-6. Repeated rows are rows:
    each is counted and may be taken. Rows without an id differ by their texts.
    Ties in the key go by doc_id, then size. An empty table gives none.
    """
    weight = F.greatest(F.coalesce(weight, F.lit(1e-6)), F.lit(1e-6))
    carry = without(carry, "doc_id", "size", "source", "source_size", "target", "taken")
    row = F.struct(*[F.col(f"`{c}`") for c in carry], F.lit(0).alias("_")).alias("_row")
    u = uniform(F.lit(seed), F.col(f"`{doc_id}`"), F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")))
    keyed = settle(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), size.cast("long").alias("size"), (-F.log(u) / weight).alias("key"), *([row] if carry else [])))
    carried = ["_row"] if carry else []
    sources = keyed.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"), F.avg("key").alias("mean_key"))
    plan = settle(source_targets(sources.select("source", "source_size"), cap).alias("t").join(sources.select("source", "n_docs", "mean_key").alias("s"), F.expr("t.source <=> s.source")).select(
        "t.source", "source_size", "target", "mean_key",
        F.ceil(F.sqrt("n_docs")).cast("long").alias("n_buckets"),
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("epochs"))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    # 1 - exp(-key / mean) rises with the key and spreads near-exponential keys evenly.
    bucket = F.least(F.floor((1 - F.exp(-F.col("key") / F.col("mean_key"))) * F.col("n_buckets")), F.col("n_buckets") - 1)
    placed = keyed.alias("k").join(plan.alias("p"), F.expr("k.source <=> p.source")).select("k.*", "source_size", "target", "epochs", "rest", F.coalesce(bucket, F.lit(0)).cast("long").alias("bucket"))
    so_far = Window.partitionBy("source").orderBy("bucket")
    ends = (placed.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"), F.first("rest").alias("rest"))
            .withColumn("through", F.sum("in_bucket").over(so_far))
            .where(F.col("through") > F.col("rest"))
            .groupBy("source").agg(F.min(F.struct("bucket", F.expr("through - in_bucket").alias("before"))).alias("cut"))
            .select("source", F.col("cut.bucket").alias("cut"), F.col("cut.before").alias("before")))
    ends = settle(ends)
    marked = placed.alias("d").join(ends.alias("e"), F.expr("d.source <=> e.source"), "left").select("d.*", "cut", "before")
    whole = marked.where(F.col("cut").isNull() | (F.col("bucket") != F.col("cut"))).withColumn("extra", F.coalesce(F.col("bucket") < F.col("cut"), F.lit(True)))
    in_order = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    used = F.col("before") + F.coalesce(F.sum("size").over(in_order), F.lit(0))
    last = (marked.where(F.col("bucket") == F.col("cut")).withColumn("used", used)
            .withColumn("extra", (F.col("used") < F.col("rest")) & (2 * (F.col("rest") - F.col("used")) >= F.col("size"))).drop("used"))
    taken = F.col("size") * (F.col("epochs") + F.col("extra").cast("long"))
    out = whole.unionByName(last).select("doc_id", "size", "source", "source_size", "target", taken.cast("long").alias("taken"), *carried)
    return out.select("doc_id", "size", "source", "source_size", "target", "taken", *[F.col("_row")[c].alias(c) for c in carry])


def quality_weight(text: Column) -> Column:
    """1 plus the mean share of distinct words in the text's whole windows of 16
    words: varied text is drawn earlier than repetitive text, and a text's length
    doesn't matter, as every window is as long. A text of fewer words is one
    window of its own; 1 for an empty text."""
    distinct = lambda w: F.transform(F.sequence(F.lit(0), F.floor(F.size(w) / WINDOW).cast("int") - 1), lambda i: F.size(F.array_distinct(F.slice(w, i * WINDOW + 1, WINDOW))))
    share = let(words(text), lambda w: F.when(F.size(w) >= WINDOW, F.aggregate(distinct(w), F.lit(0), lambda a, x: a + x) / (F.floor(F.size(w) / WINDOW) * WINDOW))
                .when(F.size(w) > 0, F.size(F.array_distinct(w)) / F.size(w)).otherwise(F.lit(0.0)))
    return F.lit(1.0) + share


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all ``documents``; nulls, empty texts, ties and repeated rows as
    in ``mix``."""
    docs = documents(spark, sf_dir)
    return mix_documents(docs).select("doc_id", "size", "source_size", "target", "taken", "source")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix with the library's sizes and quality weights."""
    return mix(docs, F.size(words(F.col("text"))), quality_weight(F.col("text")))


ORACLE_MIX = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(w), 0)::BIGINT AS size,
         -ln((('0x' || substr(md5('0|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)
           / (1.0 + CASE WHEN coalesce(len(w), 0) = 0 THEN 0.0 WHEN len(w) < 16 THEN len(list_distinct(w))::DOUBLE / len(w)
             ELSE list_sum([len(list_distinct(w[16 * i + 1:16 * i + 16])) for i in range(0, len(w) // 16)])::DOUBLE / (len(w) // 16 * 16) END) AS key
  FROM (SELECT doc_id, source, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM {documents})),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap, (SELECT sum(source_size) FROM totals)::DOUBLE AS total FROM totals),
laid AS (SELECT *, cap / weight AS ratio,
  total - coalesce(sum(cap) OVER o, 0) AS remaining,
  sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS weight_from
  FROM weighed WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lvl AS (SELECT max(CASE WHEN ratio >= remaining / weight_from THEN remaining / weight_from END) AS level FROM laid),
plan AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs
  FROM (SELECT source, source_size, round(coalesce(least(cap, weight * level), cap), 6) AS target FROM laid, lvl)),
ordered AS (SELECT s.doc_id, s.size, p.source, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS rest, s.key,
  coalesce(sum(s.size) OVER (PARTITION BY p.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
chosen AS (SELECT *, (used < rest AND 2 * (rest - used) >= size)::INT AS extra FROM ordered)
SELECT doc_id, size, source_size, target, (size * (epochs + extra))::BIGINT AS taken, source FROM chosen
"""
ORACLE_OP2 = ORACLE_MIX.format(documents="documents")
