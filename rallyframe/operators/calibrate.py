"""Calibrators by segment: Platt and isotonic, with the whole table's as fallback.

A fit is a small table, one row a segment (Platt) or a step (isotonic). The row
with a null segment stands for all rows; it serves segments with too few rows,
with one class only, or not seen at the fit.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLIP = 1e-6


def segment_key(segments: list[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(s).cast("string"), F.lit("")) for s in segments])


def _log_odds(p: Column) -> Column:
    # The greatest of a null and a number is the number.
    q = F.when(p.isNotNull(), F.greatest(F.least(p.cast("double"), F.lit(1 - CLIP)), F.lit(CLIP)))
    return F.ln(q / (1 - q))


def _spread(df: DataFrame, segments: list[str], p: str, y: str, over: float) -> DataFrame:
    """(segment, p, y, w), each row under its segment and under null for all."""
    key = F.array(F.lit(None).cast("string"), *([segment_key(segments)] if segments else []))
    known = df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    return known.select(F.explode(key).alias("segment"), F.col(p).cast("double").alias("p"), F.col(y).cast("int").alias("y"), F.when(F.col(y) == 0, F.lit(over)).otherwise(1.0).alias("w"))


def _fitted(rows: DataFrame, least: int) -> DataFrame:
    """``rows`` of all and of segments with ``least`` rows and both classes."""
    enough = rows.groupBy("segment").agg(F.count(F.lit(1)).alias("_n"), F.min("y").alias("_lo"), F.max("y").alias("_hi"))
    kept = enough.where("_lo < _hi").where(F.col("segment").isNull() | (F.col("_n") >= least)).select(F.col("segment").alias("_k"))
    return rows.join(F.broadcast(kept), F.col("segment").eqNullSafe(F.col("_k"))).drop("_k")


def fit_platt(df: DataFrame, p: str, y: str, segments: list[str] | None = None, least: int = 200, over: float = 1.0, steps: int = 12, digits: int = 4) -> DataFrame:
    """(segment, slope, intercept) of logistic fits on the log odds of ``p``.

    ``over`` weighs losses: above 1, too high scores cost more. Rows are counted
    by score to ``digits`` once; each Newton step is one aggregation over these
    counts for all segments. What the driver holds is a row a segment.
    """
    rows = _fitted(_spread(df, segments or [], p, y, over), least).groupBy("segment", F.round("p", digits).alias("p"), "y").agg(F.sum("w").alias("w")).withColumn("x", _log_odds(F.col("p"))).persist()
    try:
        fits = {r.segment: np.zeros(2) for r in rows.select("segment").distinct().collect()}
        for _ in range(steps):
            table = df.sparkSession.createDataFrame([(k, float(b[0]), float(b[1])) for k, b in fits.items()], "_k string, a double, b double")
            q = 1 / (1 + F.exp(-(F.col("a") + F.col("b") * F.col("x"))))
            gap, curve = F.col("w") * (F.col("y") - q), F.col("w") * q * (1 - q)
            sums = rows.join(F.broadcast(table), F.col("segment").eqNullSafe(F.col("_k"))).groupBy("segment").agg(*[F.sum(c).alias(n) for n, c in {"g0": gap, "g1": gap * F.col("x"), "h0": curve, "h1": curve * F.col("x"), "h2": curve * F.col("x") * F.col("x")}.items()]).collect()
            largest = 0.0
            for r in sums:
                step = np.linalg.solve(np.array([[r.h0, r.h1], [r.h1, r.h2]]) + 1e-9 * np.eye(2), np.array([r.g0, r.g1]))
                step *= min(1.0, 5.0 / max(1e-12, float(np.abs(step).max())))
                fits[r.segment] = fits[r.segment] + step
                largest = max(largest, float(np.abs(step).max()))
            if largest < 1e-10:
                break
    finally:
        rows.unpersist()
    return df.sparkSession.createDataFrame([(k, float(b[1]), float(b[0])) for k, b in fits.items()], "segment string, slope double, intercept double")


def apply_platt(df: DataFrame, fit: DataFrame, p: str, segments: list[str] | None = None, name: str = "calibrated") -> DataFrame:
    """``df`` with the calibrated score; of its segment or else of all."""
    own = fit.where("segment IS NOT NULL").select(F.col("segment").alias("_k"), F.struct("slope", "intercept").alias("_own"))
    every = fit.where("segment IS NULL").select(F.struct("slope", "intercept").alias("_all"))
    out = df.withColumn("_seg", segment_key(segments) if segments else F.lit(None).cast("string")).join(F.broadcast(own), F.col("_seg") == F.col("_k"), "left").join(F.broadcast(every), how="left")
    line = F.coalesce("_own", "_all")
    return out.withColumn(name, F.coalesce(1 / (1 + F.exp(-(line["intercept"] + line["slope"] * _log_odds(F.col(p))))), F.col(p))).drop("_seg", "_k", "_own", "_all")


def _steps(rows: pd.DataFrame) -> pd.DataFrame:
    """Pool adjacent violators over one segment's distinct scores."""
    rows = rows.sort_values("p")
    blocks: list[list[float]] = []
    for p, s, w in zip(rows["p"], rows["s"], rows["w"], strict=True):
        blocks.append([p, p, s, w])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]:
            _, high, s2, w2 = blocks.pop()
            blocks[-1] = [blocks[-1][0], high, blocks[-1][2] + s2, blocks[-1][3] + w2]
    key = rows["segment"].iloc[0]
    return pd.DataFrame({"segment": [key] * len(blocks), "low": [b[0] for b in blocks], "high": [b[1] for b in blocks], "value": [b[2] / b[3] for b in blocks]})


def fit_isotonic(df: DataFrame, p: str, y: str, segments: list[str] | None = None, least: int = 200, over: float = 1.0, digits: int = 4) -> DataFrame:
    """(segment, low, high, value): the steps of isotonic fits, scores rounded to
    ``digits``, so that a segment's task holds 10,000 counts at most."""
    rows = _fitted(_spread(df, segments or [], p, y, over), least)
    counts = rows.groupBy("segment", F.round("p", digits).alias("p")).agg(F.sum(F.col("w") * F.col("y")).alias("s"), F.sum("w").alias("w"))
    return counts.groupBy("segment").applyInPandas(_steps, "segment string, low double, high double, value double")


def apply_isotonic(df: DataFrame, fit: DataFrame, p: str, segments: list[str] | None = None, name: str = "calibrated") -> DataFrame:
    """``df`` with the calibrated score: a step's value, between steps on the line
    from one to the next, beyond them the outermost; of its segment or else of
    all. Steps are an array by segment, of 10,000 at most."""
    arrays = fit.groupBy("segment").agg(F.array_sort(F.collect_list(F.struct("low", "high", "value"))).alias("_steps"))
    own = arrays.where("segment IS NOT NULL").select(F.col("segment").alias("_k"), F.col("_steps").alias("_own"))
    every = arrays.where("segment IS NULL").select(F.col("_steps").alias("_all"))
    out = df.withColumn("_seg", segment_key(segments) if segments else F.lit(None).cast("string")).join(F.broadcast(own), F.col("_seg") == F.col("_k"), "left").join(F.broadcast(every), how="left").withColumn("_steps", F.coalesce("_own", "_all"))
    x = F.col(p).cast("double")
    below, above = F.filter("_steps", lambda s: s["low"] <= x), F.filter("_steps", lambda s: s["high"] >= x)
    left, right = F.try_element_at(below, F.lit(-1)), F.get(above, F.lit(0))
    share = F.try_divide(x - left["high"], right["low"] - left["high"])
    value = F.when(left.isNull(), right["value"]).when(right.isNull() | (x <= left["high"]), left["value"]).otherwise(left["value"] + share * (right["value"] - left["value"]))
    return out.withColumn(name, F.coalesce(value, x)).drop("_seg", "_k", "_own", "_all", "_steps")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
