"""Secret scans: fixed patterns plus a character Markov log-likelihood ratio (native)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, let, running, without

# The patterns of the base kinds. The last two are the runs of
# [0-9a-f] and AKIA[A-Z0-9]+ that are long enough; runs are maximal, so asking
# for the length in the pattern finds the same ones.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""[A-Za-z0-9+/_.=-]{8,}$"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

#: Strings that the Markov models judge: unbroken runs of at least so many
#: characters, and the parts of a run between / _ = and -.
MIN_LENGTH = 16
RUN, PART = "[A-Za-z0-9+/_=-]", "[A-Za-z0-9+]"
#: Symbol 0 stands for the string's start, 1 for any other character.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
N_SYMBOLS = len(ALPHABET) + 2
#: A candidate is flagged if its mean log-likelihood ratio in nats a character is above this.
THRESHOLD = 0.0
#: Labelled strings of each class that the models are fitted on.
SAMPLES = 20_000


def codes(text: Column) -> Column:
    """Symbol numbers of a string, with the start symbol before it."""
    return F.concat(F.array(F.lit(0)), F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) + F.lit(1)))


def train_markov(samples: DataFrame, text: str = "text", label: str = "label") -> list[float]:
    """Log-likelihood ratios log P(b|a, random) - log P(b|a, ordinary), add-one
    smoothed, as a row-major table over symbol pairs.

    ``samples`` holds labelled strings: 1 random, 0 ordinary; rows with a null
    string or label are left out. The table has a fixed number of entries, so
    collecting the pair counts is bounded whatever the sample's size. With no
    samples all ratios are 0 and nothing is flagged.
    """
    pairs = samples.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(
        F.col(label).cast("int").alias("label"),
        F.explode(let(codes(F.col(text)), lambda c: F.transform(F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))), lambda a, i: a * N_SYMBOLS + F.get(c, i + 1)))).alias("pair"))
    counts = {0: {}, 1: {}}
    for r in pairs.groupBy("label", "pair").count().collect():
        counts[int(r.label == 1)][r.pair] = r["count"]
    table = []
    rows = {k: [sum(c.get(a * N_SYMBOLS + b, 0) for b in range(N_SYMBOLS)) for a in range(N_SYMBOLS)] for k, c in counts.items()}
    for a in range(N_SYMBOLS):
        for b in range(N_SYMBOLS):
            p, q = ((counts[k].get(a * N_SYMBOLS + b, 0) + 1) / (rows[k][a] + N_SYMBOLS) for k in (1, 0))
            table.append(math.log(p / q))
    return table


def llr(text: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio a character; 0 for an empty string."""
    model = F.split(F.lit(",".join(f"{x:.5f}" for x in table)), ",").cast("array<double>")
    total = let(codes(text), lambda c: F.aggregate(
        F.transform(F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))), lambda a, i: F.get(model, a * N_SYMBOLS + F.get(c, i + 1))), F.lit(0.0), lambda s, x: s + x))
    return F.coalesce(total / F.nullif(F.char_length(text), F.lit(0)), F.lit(0.0))


def spans_of(text: Column, pattern: str, kind: str, keep) -> Column:
    """(start, rank, end, value) of the pattern's leftmost non-overlapping
    matches that pass ``keep``; code points, end exclusive.

    The gaps between matches come from split, the matches from
    regexp_extract_all; both walk the same matches, so the running sum of
    gap and match lengths places each one. Texts without a match stop at rlike.
    """
    empty = F.array().cast("array<struct<start:long,rank:int,end:long,value:string>>")
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    long = lambda c: F.char_length(c).cast("long")

    def placed(pair: Column) -> Column:
        lengths = F.zip_with(F.slice(pair["gaps"], 1, F.size(pair["found"])), pair["found"], lambda g, v: F.struct(long(g).alias("gap"), long(v).alias("len")))
        starts = running(lengths, F.lit(0).cast("long"), lambda at, x: at + x["gap"] + x["len"], lambda at, x: at + x["gap"])
        return F.zip_with(starts, pair["found"], lambda s, v: F.struct(s.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (s + long(v)).alias("end"), v.alias("value")))

    located = let(F.struct(gaps.alias("gaps"), found.alias("found")), placed)
    return F.when(text.rlike(pattern), F.filter(located, lambda s: keep(s["value"]))).otherwise(empty)


def apart(spans: Column, others: Column) -> Column:
    """The ``spans`` that overlap none of the ``others``; both sorted by start,
    and no span within another of ``spans``.

    One sweep over all by start knows the last end of the others so far, one
    backwards the first start of the others to come.
    """
    mark = lambda x, own: F.transform(x, lambda s: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s["end"].alias("end"), s.alias("span")))
    low, high = F.lit(-1).cast("long"), F.lit((1 << 62)).cast("long")

    def swept(x: Column) -> Column:
        ended = running(x, low, lambda e, s: F.when(s["own"], e).otherwise(F.greatest(e, s["end"])), lambda e, s: e)
        opened = F.reverse(running(F.reverse(x), high, lambda b, s: F.when(s["own"], b).otherwise(F.least(b, s["start"])), lambda b, s: b))
        met = F.zip_with(x, F.zip_with(ended, opened, lambda e, b: F.struct(e.alias("e"), b.alias("b"))), lambda s, n: F.struct(s["span"].alias("span"), (s["own"] & (n["e"] <= s["start"]) & (n["b"] >= s["end"])).alias("ok")))
        return F.transform(F.filter(met, lambda m: m["ok"]), lambda m: m["span"])

    # At equal starts the others come first: false sorts before true.
    both = F.array_sort(F.concat(mark(spans, True), mark(others, False)))
    return F.when((F.size(spans) == 0) | (F.size(others) == 0), spans).otherwise(let(both, swept))


def scan_secrets(docs: DataFrame, table: list[float], text: str = "text", threshold: float = THRESHOLD, min_length: int = MIN_LENGTH) -> DataFrame:
    """``docs`` with ``base_spans`` and ``random_spans``: arrays of (start, rank,
    end, value) sorted by start, then by kind in the order of ``KINDS``.

    Base spans are the fixed patterns' matches. Random spans are runs of at
    least ``min_length`` characters whose Markov log-likelihood ratio is above
    the threshold, and such parts of other runs; none overlaps a base span.
    Time is near linear in a text's length and matches. Null and empty texts
    have no spans; repeated rows each get theirs. Columns of ``docs`` are kept;
    its own columns of the two names are replaced.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    always = lambda v: F.lit(True)
    assign = spans_of(t, ASSIGN, "assign", lambda v: F.regexp_replace(v, r"^(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?", "").rlike("^" + ASSIGN_VALUE))
    base = F.array_sort(F.concat(assign, spans_of(t, ACCESS, "access", always), spans_of(t, HEX, "hex", always)))
    likely = lambda v: llr(v, table) > threshold
    runs, parts = (spans_of(t, f"{chars}{{{min_length},}}", "random", likely) for chars in (RUN, PART))
    kept = [F.col(f"`{c}`") for c in without(docs.columns, "base_spans", "random_spans")]
    found = docs.select(*kept, base.alias("base_spans"), runs.alias("_runs"), parts.alias("_parts"))
    guess = F.array_sort(F.concat("_runs", apart(F.col("_parts"), F.col("_runs"))))
    return found.withColumn("_guess", guess).select(*kept, "base_spans", apart(F.col("_guess"), F.col("base_spans")).alias("random_spans"))


def random_strings(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """Labelled random strings: base64 and hexadecimal digests of numbers."""
    i = F.col("id").cast("string").cast("binary")
    return spark.range(n).select(
        F.when(F.col("id") % 2 == 0, F.regexp_replace(F.base64(F.unhex(F.sha2(i, 256))), "=", "")).otherwise(F.sha1(i)).alias("text"), F.lit(1).alias("label"))


def ordinary_strings(docs: DataFrame, labelled: DataFrame, n: int = SAMPLES) -> DataFrame:
    """Labelled ordinary strings: identifiers joined from the words of ``n`` / 20
    documents of good quality, drawn by a hash of the id, in lower and upper
    case, and plain numbers. Those few ids are broadcast, so the documents are
    only read."""
    good = labelled.where("quality = 1").select("doc_id").distinct()
    few = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max(1, n // 20))
    w = F.filter(F.split(F.col("text"), r"[^A-Za-z0-9]+"), lambda x: x.rlike("^[A-Za-z]{2,}$"))
    chosen = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id", "left_semi")

    def made(x: Column, i: Column) -> Column:
        three = F.slice(x, i * 3 - 2, 3)
        plain = F.array_join(three, "")
        number = F.when(F.size(three) > 0, F.abs(F.xxhash64(three)).cast("string")).otherwise("")
        return F.get(F.array(*[F.array_join(three, by) for by in "_-/"], plain, F.upper(plain), number), i % 6)

    joined = let(w, lambda x: F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: made(x, i)))
    return chosen.select(F.explode(F.filter(joined, lambda x: F.char_length(x) > 0)).alias("text"), F.lit(0).alias("label"))


def fit(spark: SparkSession, sf_dir: str) -> list[float]:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return train_markov(random_strings(spark).unionByName(ordinary_strings(docs, labels)))


def _digest(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of ``documents``; see ``scan_secrets`` for nulls, empty
    and repeated texts and overlaps."""
    out = scan_secrets(documents(spark, sf_dir).select("doc_id", "text"), fit(spark, sf_dir))
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["rank"] == k)).cast("long")
    return out.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_digest(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"),
        _digest(F.array_sort(F.concat("base_spans", "random_spans"))).alias("spans"),
        F.size("random_spans").cast("long").alias("n_random"))
