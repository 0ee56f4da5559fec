"""Language identification with bit-sliced n-gram filters."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bucket_of_id, documents, made_schema, settle, shipped, without

SIZES = (1, 2, 3, 4)
#: Labelled documents of each language that are learnt from, about.
TRAIN_DOCS = 1500
#: Hash functions of a filter, and its slots for each n-gram of the largest
#: language, at least: the filters grow with what was learnt, nothing is left out.
HASHES, SLOTS_EACH, LEAST_SLOTS = 3, 8, 1 << 16
#: An n-gram is entered for a language if seen so often there, and at least this
#: share as frequent as where it is most frequent.
LEAST, SHARE = 3, 0.3
#: Slices of the range of shares that are counted for a median, and the part of
#: a language's usual share that a text must reach to count as that language.
SLICES, BAR = 4096, 0.5
UNKNOWN = "und"
#: Characters that are coded at once, and n-grams that are hashed at once.
BLOCK, STRIDE = 1 << 20, 1 << 16

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def coded(texts: list[str]):
    """Blocks of (codes, starts, owners, carried): the texts' code points with
    runs of other characters than letters as one space, in lower case, between
    two spaces; where each text of the block starts and which it is.

    A text longer than a block goes on in blocks of its own, which begin with
    the last ``carried`` codes of the block before.
    """
    pending, size, owners = [], 0, []
    over = max(SIZES) - 1

    def squeeze(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        code = np.frombuffer("".join(parts).encode("utf-32-le", "replace"), dtype=np.uint32)
        starts = np.concatenate(([0], np.cumsum([len(p) for p in parts])[:-1]))
        letter = np.zeros(int(code.max()) + 1, dtype=bool)
        letter[[c for c in np.flatnonzero(np.bincount(code)).tolist() if chr(c).isalpha()]] = True
        is_letter = letter[code]
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]
        keep[starts] = True
        code = np.where(is_letter, code, np.uint32(32))[keep]
        return code, np.concatenate(([0], np.cumsum(keep)))[starts]

    for i, text in enumerate(texts):
        if len(text) <= BLOCK:
            pending.append(f"\n{text.lower()}\n")
            owners.append(i)
            size += len(text)
        if size > BLOCK or len(text) > BLOCK and pending:
            yield *squeeze(pending), np.array(owners), 0
            pending, size, owners = [], 0, []
        if len(text) > BLOCK:
            last = np.zeros(0, np.uint32)
            for at in range(0, len(text), BLOCK):
                code, _ = squeeze([("\n" if at == 0 else "") + text[at : at + BLOCK].lower() + ("\n" if at + BLOCK >= len(text) else "")])
                if len(last) and last[-1] == 32 and code[0] == 32:
                    code = code[1:]
                code = np.concatenate((last, code))
                yield code, np.zeros(1, np.int64), np.array([i]), len(last)
                last = code[-over:]
    if pending:
        yield *squeeze(pending), np.array(owners), 0


def hashed(code: np.ndarray, starts: np.ndarray, carried: int):
    """For strides of a block's n-grams: their hashes, and for each where its
    text is among the block's, by the bounds of the texts' runs; n-grams across
    texts, of spaces alone, or of carried codes alone are left out."""
    for n in SIZES:
        valid = np.ones(max(0, len(code) - n + 1), dtype=bool)
        if n == 1:
            valid &= code != 32
        else:
            for j in range(1, n):
                at = starts[1:] - j
                valid[at[(at >= 0) & (at < len(valid))]] = False
        valid[: max(0, carried - n + 1)] = False
        for at in range(0, len(valid), STRIDE):
            wide = code[at : at + STRIDE + n - 1].astype(np.uint64) + _U(1)
            count = len(wide) - n + 1
            h = wide[:count].copy()
            for j in range(1, n):
                h *= _U(0x100000001B3)
                h += wide[j : j + count]
            ok = valid[at : at + count]
            first = np.searchsorted(starts, at, side="right") - 1
            inner = starts[(starts > at) & (starts < at + count)] - at
            runs = np.concatenate(([0], np.concatenate(([0], np.cumsum(ok)))[inner]))
            yield _mix(h[ok] + _U(n * 0x9E3779B97F4A7C15 % (1 << 64))), first, runs


def grams(texts: list[str]) -> np.ndarray:
    """Hashes of the n-grams of letters of all texts."""
    out = [h for code, starts, _, carried in coded(texts) for h, _, _ in hashed(code, starts, carried)]
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def gram_batches(batches):
    """(lang, text) -> (lang, gram, n), summed within blocks of text."""
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            for code, starts, _, carried in coded([t for g, t in zip(langs, texts, strict=True) if g == lang]):
                hashes = [h for h, _, _ in hashed(code, starts, carried)]
                values, counts = np.unique(np.concatenate(hashes), return_counts=True) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values.view(np.int64)), pa.array(counts, pa.int64())], ["lang", "gram", "n"])


class LanguageFilters:
    """A Bloom filter per language, stored by slot: a slot's word has the bit of
    every language whose filter sets it, so one look-up asks all languages."""

    def __init__(self, langs: list[str], sizes: list[int], entries: int = 0):
        self.langs = langs
        self.common = int(np.argmax(sizes)) if sizes else 0
        self.n_slots = max(LEAST_SLOTS, 1 << (SLOTS_EACH * entries).bit_length())
        # Small words keep the table in the processor's cache.
        self.kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if len(langs) <= 8 * k().itemsize or k is np.uint64)
        self.words = max(1, -(-len(langs) // 64))
        self.slots = np.zeros((self.words, self.n_slots), self.kind)
        self.false = np.zeros(len(langs))
        self.level = np.ones(len(langs))

    def places(self, hashes: np.ndarray) -> list[np.ndarray]:
        step, low = (hashes >> _U(32)) | _U(1), _U(self.n_slots - 1)
        return [((hashes + _U(j) * step) & low).astype(np.int64) for j in range(HASHES)]

    def place_columns(self, gram: Column) -> Column:
        """``places`` as columns; the low bits are masked first, so nothing overflows."""
        low = F.lit(self.n_slots - 1).cast("long")
        step = F.shiftrightunsigned(gram, 32).bitwiseOR(F.lit(1).cast("long")).bitwiseAND(low)
        return F.array(*[(gram.bitwiseAND(low) + step * F.lit(j).cast("long")).bitwiseAND(low) for j in range(HASHES)])

    def set(self, word: int, slot: np.ndarray, bits: np.ndarray) -> None:
        self.slots[word, slot] |= bits.astype(np.int64).view(np.uint64).astype(self.kind)

    def enter(self, lang: int, hashes: np.ndarray) -> None:
        for at in self.places(hashes):
            self.set(lang // 64, at, np.full(len(at), 1 << lang % 64, np.uint64))

    def finish(self) -> None:
        """Each language's rate of false positives, from the fill of its slice."""
        for i in range(len(self.langs)):
            fill = float(((self.slots[i // 64] >> self.kind(i % 64)) & self.kind(1)).mean())
            self.false[i] = fill**HASHES

    def shares(self, texts: list[str]) -> np.ndarray:
        """For each text and language the share of the text's n-grams that the
        language holds, less what false positives explain."""
        total, hits = np.zeros(len(texts)), np.zeros((len(texts), len(self.langs)))
        for code, starts, owners, carried in coded(texts):
            for hashes, first, runs in hashed(code, starts, carried):
                if not len(hashes):
                    continue
                # Runs without an n-gram are left out: reduceat would give them one.
                ends = np.append(runs[1:], len(hashes))
                some = ends > runs
                whose, runs = owners[first : first + len(some)][some], runs[some]
                total[whose] += ends[some] - runs
                places = self.places(hashes)
                for w in range(self.words):
                    mask = self.slots[w][places[0]]
                    for at in places[1:]:
                        mask &= self.slots[w][at]
                    for i in range(64 * w, min(64 * w + 64, len(self.langs))):
                        hits[whose, i] += np.add.reduceat((mask >> self.kind(i % 64)) & self.kind(1), runs, dtype=np.int64)
        return np.maximum(0, hits - total[:, None] * self.false) / (np.maximum(total, 1)[:, None] * (1 - self.false))

    def decide(self, texts: list[str]) -> list[tuple[str, float]]:
        """Language and score of each text that has a letter. The score is the
        winner's part of all languages' shares to the fourth power, as related
        languages hold many of each other's n-grams; with no evidence it is 0
        and the most frequent language is returned. Ties go to the first by name."""
        return self.answers(self.shares(texts)) if texts else []

    def answers(self, shares: np.ndarray) -> list[tuple[str, float]]:
        out = []
        for row in shares**4:
            total = float(row.sum())
            best = int(np.argmax(row)) if total else self.common
            out.append((self.langs[best], float(row[best]) / total if total else 0.0))
        return out

    def evidence(self, shares: np.ndarray) -> np.ndarray:
        """The best of a text's shares, each as a part of what texts of that
        language usually reach (``level``)."""
        return (shares / self.level).max(axis=1)


def fit_languages(docs: DataFrame, train: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", n: int = TRAIN_DOCS) -> LanguageFilters:
    """Filters learnt from about ``n`` training documents of each language,
    drawn by a hash of the id, whole texts, in one pass over them. N-grams are
    counted, chosen and laid into slots on the cluster; the driver gets the
    slots, sized by the n-grams of those documents. Null languages and texts are
    not learnt from."""
    known = docs.where(train & F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[lang]: r["count"] for r in known.groupBy(lang).count().collect()}
    langs = sorted(sizes)
    if not langs:
        return LanguageFilters([], [])
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, n / sizes[k]))])
    draw = F.pmod(F.xxhash64(F.col(doc_id)), F.lit(1_000_003)) / F.lit(1_000_003)
    counted = settle(known.where(draw < F.element_at(share, F.col(lang))).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
                     .mapInArrow(gram_batches, "lang string, gram bigint, n bigint").groupBy("gram", "lang").agg(F.sum("n").alias("n")))
    totals = F.create_map(*[F.lit(x) for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect() for x in (r.lang, float(r.n))])
    number = F.create_map(*[F.lit(x) for i, k in enumerate(langs) for x in (k, i)])
    rates = F.collect_list(F.struct((F.col("n") / F.element_at(totals, F.col("lang"))).alias("rate"), "n", F.element_at(number, F.col("lang")).alias("lang")))
    often = F.filter("r", lambda x: (x["n"] >= LEAST) & (x["rate"] >= SHARE * F.array_max(F.transform("r", lambda y: y["rate"]))))
    held = settle(counted.groupBy("gram").agg(rates.alias("r")).select("gram", F.explode(often).alias("x")).select("gram", F.col("x.lang").alias("lang")))
    entries = held.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    filters = LanguageFilters(langs, [sizes[k] for k in langs], entries)
    laid = held.select(F.expr("lang div 64").cast("int").alias("word"), F.expr("shiftleft(1L, cast(lang % 64 as int))").alias("bit"), F.explode(filters.place_columns(F.col("gram"))).alias("slot"))
    for rows in [laid.groupBy("word", "slot").agg(F.bit_or("bit").alias("bits")).toPandas()]:
        for word, part in rows.groupby("word"):
            filters.set(word, part["slot"].to_numpy(), part["bits"].to_numpy())
    filters.finish()
    return filters


def restored(state) -> LanguageFilters:
    filters = LanguageFilters.__new__(LanguageFilters)
    filters.__dict__.update(state.value)
    return filters


def own_share_batches(batches, state):
    """(lang, text) -> (lang, share): the text's share in its labelled language."""
    filters = restored(state)
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        own = filters.shares(texts)[np.arange(len(texts)), [filters.langs.index(g) for g in langs]]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.float64())], ["lang", "share"])


def medians(own: DataFrame) -> dict[str, float]:
    """The exact median share of each language in (lang, share). Shares are counted
    by slices of their range; only different ones in a slice that holds a middle
    place are put in order."""
    sliced = own.withColumn("slice", F.floor(F.col("share") * SLICES).cast("int"))
    counts: dict[str, list[tuple[int, int]]] = {}
    for r in sorted(sliced.groupBy("lang", "slice").agg(F.count(F.lit(1)).alias("n")).collect()):
        counts.setdefault(r.lang, []).append((r.slice, r.n))
    places = []
    for lang, slices in counts.items():
        total = sum(n for _, n in slices)
        for place in ((total - 1) // 2, total // 2):
            for at, n in slices:
                if place < n:
                    places.append((lang, at, place))
                    break
                place -= n
    if not places:
        return {}
    wanted = F.broadcast(own.sparkSession.createDataFrame(places, "lang string, slice int, place long"))
    values = sliced.join(wanted.select("lang", "slice").distinct(), ["lang", "slice"], "left_semi").groupBy("lang", "slice", "share").agg(F.count(F.lit(1)).alias("n"))
    upto = values.withColumn("upto", F.sum("n").over(Window.partitionBy("lang", "slice").orderBy("share")))
    found = upto.join(wanted, ["lang", "slice"]).where((F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("n")))
    return {r.lang: r.level for r in found.groupBy("lang").agg(F.avg("share").alias("level")).collect()}


def fit_levels(docs: DataFrame, filters: LanguageFilters, held: Column, text: str = "text", lang: str = "lang") -> LanguageFilters:
    """``filters`` with each language's level: the median share of all its held-out
    texts; of all its labelled texts, if none is held out. Texts without a letter
    don't count."""
    lettered = F.col(text).rlike(r"\p{L}") & F.col(lang).isin(filters.langs)
    known = docs.where(lettered).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.coalesce(held, F.lit(False)).alias("held"))
    thin = [r.lang for r in known.groupBy("lang").agg(F.max("held").alias("held")).collect() if not r.held]
    state = docs.sparkSession.sparkContext.broadcast(dict(filters.__dict__))
    own = known.where(F.col("held") | F.col("lang").isin(thin)).select("lang", "text").mapInArrow(lambda it: own_share_batches(it, state), "lang string, share double")
    for k, level in medians(settle(own)).items():
        filters.level[filters.langs.index(k)] = level or 1.0
    return filters


def language_batches(batches, state):
    """(row, text, has a letter) -> (row, lang_pred, score, evidence).
    ``state``: the filters' fields, as plain data."""
    filters = restored(state)
    for batch in batches:
        texts, lettered = batch.column(1).to_pylist(), np.array(batch.column(2).to_pylist(), dtype=bool)
        langs, values = [UNKNOWN] * len(texts), np.zeros((len(texts), 2))
        told = np.flatnonzero(lettered) if filters.langs else np.zeros(0, np.int64)
        if len(told):
            shares = filters.shares([texts[i] for i in told])
            for i, (lang, score) in zip(told, filters.answers(shares), strict=True):
                langs[i], values[i, 0] = lang, score
            values[told, 1] = filters.evidence(shares)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(values[:, 0]), pa.array(values[:, 1])], ["_row", "lang_pred", "score", "evidence"])


def identify(docs: DataFrame, filters: LanguageFilters, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry``, lang_pred, score and evidence (see ``LanguageFilters``) for every
    row, from its whole text. A null text, one without a letter, or any text if
    nothing was learnt, is ``und`` with score and evidence 0. Repeated rows each
    get their answer. Carried columns go through unchanged, as one struct; one
    with the name of a result is left out."""
    known = docs.sparkSession.sparkContext.broadcast(dict(filters.__dict__))
    carry = without(carry, "lang_pred", "score", "evidence")
    row = F.struct(*[F.col(f"`{c}`") for c in carry], F.lit(0).alias("_")).alias("_row")
    has_letter = F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False)).alias("_letter")
    given = docs.select(row, F.col(f"`{text}`").alias("_text"), has_letter)
    out = given.mapInArrow(lambda it: language_batches(it, known), made_schema(given, ["_row"], lang_pred="string", score="double", evidence="double"))
    return out.select(*[F.col("_row")[c].alias(c) for c in carry], "lang_pred", "score", "evidence")


def training_fold(doc_id: Column) -> Column:
    return bucket_of_id(doc_id, 3)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every row of ``documents``; nulls, letterless and repeated
    texts as in ``identify``."""
    docs = documents(spark, sf_dir)
    fold = training_fold(F.col("doc_id"))
    out = identify(docs, fit_languages(docs, fold != 1))
    return out.select("doc_id", (fold == 1).alias("held_out"), "lang_pred", "score")


shipped(sys.modules[__name__])
