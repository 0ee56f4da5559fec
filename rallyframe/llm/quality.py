"""Quality classifier: sizes under zstandard dictionaries of good and bad text."""

from __future__ import annotations

import bisect
import math
import sys

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bucket_of_id, documents, made_schema, shipped

#: Labelled documents of each class that are learnt from, about, and their bytes
#: at most: texts of more than ``LONG_PART`` of these are not learnt from.
TRAIN_DOCS, TRAIN_BYTES, LONG_PART = 1500, 8 << 20, 16
#: Each text is compressed in pieces of so many bytes, all of them, so that the
#: dictionaries and not the text's own repetitions explain its size.
PIECE = 512
LEVEL = 6
#: Texts of fewer bytes than these are calibrated apart: the shorter a text, the
#: less its difference can say.
BANDS = (48, 384)
THRESHOLD = 0.3


def _pieces(raw: bytes) -> list[bytes]:
    return [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]


class SizeModel:
    """Two dictionaries and a logistic calibration of the size difference.

    ``weights`` are an intercept for each band of lengths and the slope they
    share; ``blank`` is the score of empty texts.
    """

    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad = good, bad
        self.weights, self.blank = (0.0,) * (len(BANDS) + 2), 0.5

    def _compressors(self):
        if "_made" not in self.__dict__:
            window = max(18, (max(len(self.good), len(self.bad)) + PIECE).bit_length())

            def make(content: bytes):
                # Raw content, so that a dictionary can be as small as its sample.
                kind = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_dict_id=False, window_log=window, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
                kind.precompute_compress(compression_params=params)
                return zstandard.ZstdCompressor(dict_data=kind, compression_params=params)
            self._made = make(self.good or b" "), make(self.bad or b" ")
        return self._made

    def fields(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_made"}

    def sizes(self, raw: bytes) -> tuple[int, int]:
        """Compressed sizes under the good and the bad dictionary, over all pieces."""
        good, bad = self._compressors()
        a = b = 0
        for piece in _pieces(raw):
            a += len(good.compress(piece))
            b += len(bad.compress(piece))
        return a, b

    def difference(self, raw: bytes) -> float:
        """(bad - good) / raw size: the bytes saved on each byte of text. By the
        compressed sizes, a byte of a text that is all repetition would weigh most."""
        a, b = self.sizes(raw)
        return (b - a) / len(raw)

    def score(self, raw: bytes) -> float:
        if not raw:
            return self.blank
        z = self.weights[bisect.bisect(BANDS, len(raw))] + self.weights[-1] * self.difference(raw)
        return 1 / (1 + math.exp(-min(max(z, -500.0), 500.0)))


def calibrate(x: np.ndarray, band: np.ndarray, y: np.ndarray, mass: np.ndarray) -> tuple[float, ...]:
    """An intercept for each band and a slope of a logistic fit by Newton steps;
    ``mass`` weighs the rows. Bands' intercepts are drawn to their common one as
    if by a row, and the slope lightly to 0."""
    design = np.column_stack([np.ones(len(x)), *[band == k for k in range(len(BANDS) + 1)], x]).astype(float)
    n = design.shape[1]
    w, penalty = np.zeros(n), np.diag([1e-6, *[0.25] * (n - 2), 1e-3])
    loss = lambda w: float(mass @ np.logaddexp(0, -(2 * y - 1) * (design @ w)) + w @ penalty @ w / 2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (mass * p * (1 - p))[:, None]) + penalty, design.T @ (mass * (y - p)) - penalty @ w)
        while loss(w + step) > loss(w) and np.abs(step).max() > 1e-12:
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return (*map(float, w[1:-1] + w[0]), float(w[-1]))


def fit_sizes(rows: list[tuple[bytes, int]], totals: dict[int, int] | None = None) -> SizeModel:
    """A model from (text, label): every second document of a class goes whole to
    its dictionary, the others to the calibration, where each class weighs as
    much as in ``totals``, its labelled documents (default: those given). Empty
    texts score the share of label 1 among them and one more of label 0. With a
    class missing, any other text scores the smoothed share of label 1."""
    by = {k: [t for t, label in rows if label == k and t] for k in (0, 1)}
    model = SizeModel(b"\n".join(by[1][::2]), b"\n".join(by[0][::2]))
    rest = {k: by[k][1::2] for k in (0, 1)}
    totals = totals or {k: len(by[k]) for k in (0, 1)}
    if rows:
        empty = [label for t, label in rows if not t]
        model.blank = sum(empty) / (len(empty) + 1)
    if not rest[0] or not rest[1]:
        share = (len(by[1]) + 1) / (len(by[0]) + len(by[1]) + 2)
        model.weights = (*[math.log(share / (1 - share))] * (len(BANDS) + 1), 0.0)
        return model
    texts = [(t, k) for k in (0, 1) for t in rest[k]]
    each = {k: (totals[k] / sum(totals.values())) * len(texts) / len(rest[k]) for k in (0, 1)}
    x, band = np.array([model.difference(t) for t, _ in texts]), np.array([bisect.bisect(BANDS, len(t)) for t, _ in texts])
    model.weights = calibrate(x, band, np.array([k for _, k in texts], dtype=float), np.array([each[k] for _, k in texts]))
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, train: Column, label: str = "quality", n: int = TRAIN_DOCS, n_bytes: int = TRAIN_BYTES) -> tuple[list[tuple[bytes, int]], dict[int, int]]:
    """About ``n`` texts of each class among the training rows, drawn by a hash
    of the id, and each class's labelled documents. In the order of the draw, the
    texts that pass ``n_bytes`` a class are left out, as are those longer than a
    sixteenth of it, so what reaches the driver is bounded in rows and bytes. A
    document labelled both ways counts as label 1 if half of its labels are;
    null texts count as empty."""
    known = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("label")).where(train)
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if not totals:
        return [], {}
    share = F.create_map(*[F.lit(x) for k, v in totals.items() for x in (k, min(1.0, n / v))])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / F.lit(1_000_003)
    chosen = known.where(draw < F.element_at(share, F.col("label"))).withColumn("draw", draw)
    size = F.octet_length("text").cast("long")
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").where(size <= n_bytes // LONG_PART)
    # About 2n rows go through this window.
    so_far = Window.partitionBy("label").orderBy("draw", "doc_id", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = found.withColumn("upto", F.sum(size).over(so_far)).where(F.col("upto") <= n_bytes).select("doc_id", "text", "label").collect()
    return [(r.text.encode(), r.label) for r in sorted(rows, key=lambda r: (r.doc_id, r.text))], {k: totals.get(k, 0) for k in (0, 1)}


def score_batches(batches, state):
    """(id, text) -> (id, score). ``state``: the model's fields, as plain data."""
    model = SizeModel.__new__(SizeModel)
    model.__dict__.update(state.value)
    for batch in batches:
        raw = batch.column(1).cast(pa.binary()).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(x or b"") for x in raw], pa.float64())], ["doc_id", "score"])


def score_quality(docs: DataFrame, model: SizeModel, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, score) of every row, from its whole text. A null or empty text
    gets the model's score of empty texts; repeated rows each get theirs."""
    known = docs.sparkSession.sparkContext.broadcast(model.fields())
    given = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("_text"))
    return given.mapInArrow(lambda it: score_batches(it, known), made_schema(given, ["doc_id"], score="double"))


def op3_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every row of ``documents``; nulls, empty and repeated texts as
    in ``score_quality``."""
    docs = documents(spark, sf_dir)
    fold = bucket_of_id(F.col("doc_id"), 5)
    model = fit_sizes(*labelled_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold != 0))
    return score_quality(docs, model).select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


shipped(sys.modules[__name__])
