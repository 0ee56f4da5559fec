"""The metric bundle of binary predictions, over all rows or by keys.

Metrics of single rows and of confidence bands come from one aggregation. Rank
metrics come from the counts of each distinct score: running counts go by score
within slices of the score's range, and the slices' totals are added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The clip of log losses, bands of confidence, the thresholds of the
# weighted Brier score, and the design constants of the tail metrics.
CLIP = 1e-15
BAND_EDGES = (0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95, 1.00)
THRESHOLDS = (0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95)
OVERCONFIDENCE, TAU, COVERAGE, COVERAGE_PENALTY, CORNER = 2.0, 0.15, 0.35, 3.0, 0.2
#: Slices of the score's range for running counts.
SLICES = 1024
#: Terms of the series of the incomplete beta function: below a half they fall by half.
TERMS = 48


def clipped(p: Column) -> Column:
    return F.greatest(F.least(p, F.lit(1 - CLIP)), F.lit(CLIP))


def row_log_loss(p: Column, y: Column) -> Column:
    return -F.when(y == 1, F.ln(clipped(p))).otherwise(F.ln(1 - clipped(p)))


def series(a: float, b: float) -> list[float]:
    """Coefficients c_k of I_x(a, b) = x**a * sum(c_k * x**k)."""
    scale = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
    out, factor = [], 1.0
    for k in range(TERMS):
        out.append(scale * factor / (a + k))
        factor *= (k + 1 - b) / (k + 1)
    return out


def incomplete_beta(x: Column, a: float, b: float) -> Column:
    """The regularised incomplete beta function I_x(a, b)."""
    def low(z: Column, a: float, b: float) -> Column:
        total = F.lit(0.0)
        for c in reversed(series(a, b)):
            total = total * z + F.lit(c)
        return F.pow(z, F.lit(a)) * total
    return F.when(x <= 0.5, low(x, a, b)).otherwise(1 - low(1 - x, b, a))


def beta_tail(p: Column, y: Column, a: float = 0.5, b: float = 0.5) -> Column:
    """Loss of one row under a Beta(a, b) weight of thresholds, which lies in the
    tails for a and b below 1."""
    q = clipped(p)
    return F.when(y == 1, b / (a + b) * (1 - incomplete_beta(q, a, b + 1))).otherwise(a / (a + b) * incomplete_beta(q, a + 1, b))


def threshold_brier(p: Column, y: Column) -> Column:
    """Mean cost of one row over the thresholds outside the middle."""
    t = F.array(*[F.lit(x) for x in THRESHOLDS])
    cost = F.transform(t, lambda x: F.when((y == 1) & (p <= x), 1 - x).when((y == 0) & (p > x), x).otherwise(0.0))
    return F.aggregate(cost, F.lit(0.0), lambda s, x: s + x) / len(THRESHOLDS)


def row_metrics(p: Column, y: Column) -> dict[str, Column]:
    """Aggregates that need no order. Bands hold rows of 0.5 and above; a band's
    gap is its mean outcome less its mean score. 0 where no row counts."""
    sure = F.abs(p - 0.5) > TAU
    covered, high = F.avg(sure.cast("int")), p >= 0.8
    wrong = (p >= 0.5).cast("int") != y
    bands = []
    for low, up in zip(BAND_EDGES, BAND_EDGES[1:], strict=False):
        inside = (p >= low) & ((p <= up) if up == BAND_EDGES[-1] else (p < up))
        bands.append(F.struct(F.count_if(inside).alias("n"), F.avg(F.when(inside, p)).alias("p"), F.avg(F.when(inside, y)).alias("y")))
    held = F.filter(F.array(*bands), lambda b: b["n"] > 0)
    gaps = F.transform(held, lambda b: F.struct(b["n"].alias("n"), (b["y"] - b["p"]).alias("gap")))
    mean = lambda f: F.coalesce(F.try_divide(F.aggregate(gaps, F.lit(0.0), lambda s, g: s + f(g["gap"]) * g["n"]), F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g["n"])), F.lit(0.0))
    most = lambda f: F.coalesce(F.array_max(F.transform(gaps, lambda g: f(g["gap"]))), F.lit(0.0))
    asymmetric = row_log_loss(p, y) * F.when(p > y, F.lit(OVERCONFIDENCE)).otherwise(1.0)
    return {
        "n": F.count(F.lit(1)), "accuracy": F.avg((~wrong).cast("int")), "log_loss": F.avg(row_log_loss(p, y)), "brier_score": F.avg((p - y) * (p - y)),
        "calibration_error": mean(F.abs), "calibration_error_max": most(F.abs), "overconfidence_max": F.greatest(most(lambda g: -g), F.lit(0.0)), "signed_calibration": mean(lambda g: g),
        "error_rate_80plus": F.coalesce(F.try_divide(F.count_if(high & wrong), F.count_if(high)), F.lit(0.0)), "asymmetric_logloss": F.avg(asymmetric),
        "beta_tail_score": F.avg(beta_tail(p, y)), "beta_tail_score_sharp": F.avg(beta_tail(p, y, 0.25, 0.25)), "threshold_weighted_brier": F.avg(threshold_brier(p, y)),
        "restricted_logloss": F.coalesce(F.avg(F.when(sure, row_log_loss(p, y))), F.lit(0.0)) + COVERAGE_PENALTY * F.greatest(COVERAGE - covered, F.lit(0.0)),
    }


def score_counts(df: DataFrame, p: str, y: str, by: list[str]) -> DataFrame:
    """One row a distinct score: by, p, pos, neg, pos_below, neg_below, n_pos and
    n_neg. No task holds more than a slice of a key's scores."""
    per = df.groupBy(*by, F.col(p).cast("double").alias("p")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")).withColumn("_slice", F.floor(F.col("p") * SLICES))
    slices = per.groupBy(*by, "_slice").agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    before = Window.partitionBy(*by or [F.lit(1)]).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*by or [F.lit(1)])
    offsets = slices.select(*by, "_slice", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}_before") for c in ("pos", "neg")], *[F.sum(f"_{c}").over(every).alias(f"n_{c}") for c in ("pos", "neg")])
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, "_slice"]]
    run = Window.partitionBy(*[f"a.{c}" for c in [*by, "_slice"]]).orderBy("a.p").rowsBetween(Window.unboundedPreceding, -1)
    both = per.alias("a").join(offsets.alias("b"), same)
    below = lambda c: (F.coalesce(F.sum(f"a.{c}").over(run), F.lit(0)) + F.col(f"b._{c}_before")).alias(f"{c}_below")
    return both.select(*[F.col(f"a.{c}").alias(c) for c in by], "a.p", "a.pos", "a.neg", below("pos"), below("neg"), "b.n_pos", "b.n_neg")


def rank_metrics() -> dict[str, Column]:
    """Aggregates over ``score_counts``: the area under the ROC curve, ties by
    half (null for one class), and the concordance of pairs weighted by their
    distance from a half (0 for one class)."""
    c = F.abs(F.col("p") - 0.5)
    above = lambda x: F.col(f"n_{x}") - F.col(f"{x}_below") - F.col(x)
    agree = F.sum(c * (F.col("pos") * F.col("neg_below") + F.col("neg") * above("pos")))
    differ = F.sum(c * (F.col("pos") * above("neg") + F.col("neg") * F.col("pos_below")))
    whole = F.sum(c * (F.col("pos") * F.col("n_neg") + F.col("neg") * F.col("n_pos")))
    return {
        "roc_auc": F.try_divide(F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)), F.first("n_pos") * F.first("n_neg")),
        "weighted_concordance": F.coalesce(F.when((F.first("n_pos") > 0) & (F.first("n_neg") > 0), F.try_divide(agree - differ, whole)), F.lit(0.0)),
    }


def partial_auc(counts: DataFrame, by: list[str], flip: bool = False, corner: float = CORNER) -> DataFrame:
    """(by, area): area under the ROC curve up to a false positive rate of
    ``corner``, rescaled so that chance is a half and the best 1; a half for one
    class. ``flip``: of the problem with scores and outcomes turned around.

    Points of equal rate count as their highest. The window of a key holds the
    points up to the corner and one beyond.
    """
    neg, pos = ("pos", "neg") if flip else ("neg", "pos")
    at_least = lambda x: F.col(f"{x}_below") + F.col(x) if flip else F.col(f"n_{x}") - F.col(f"{x}_below")
    usable = counts.where((F.col("n_pos") > 0) & (F.col("n_neg") > 0))
    points = usable.groupBy(*by, (at_least(neg) / F.col(f"n_{neg}")).alias("x")).agg(F.max(at_least(pos) / F.col(f"n_{pos}")).alias("y"))
    # The first point beyond the corner bounds the last piece.
    beyond = points.where(F.col("x") > corner).groupBy(*by).agg(F.min(F.struct("x", "y")).alias("_p")).select(*by, "_p.x", "_p.y")
    order = Window.partitionBy(*by or [F.lit(1)]).orderBy("x")
    pieces = points.where(F.col("x") <= corner).unionByName(beyond).withColumns({"x0": F.coalesce(F.lag("x").over(order), F.lit(0.0)), "y0": F.coalesce(F.lag("y").over(order), F.lit(0.0))})
    end = F.least("x", F.lit(corner))
    height = F.col("y0") + (F.col("y") - F.col("y0")) * F.try_divide(end - F.col("x0"), F.col("x") - F.col("x0"))
    area = F.sum(F.when(end > F.col("x0"), (F.col("y0") + height) / 2 * (end - F.col("x0"))).otherwise(0.0))
    chance = corner * corner / 2
    found = pieces.groupBy(*by).agg((0.5 * (1 + (area - chance) / (corner - chance))).alias("area"))
    keys = counts.select(*by).distinct() if by else counts.groupBy().agg(F.count(F.lit(1)).alias("_n")).select(F.lit(0).alias("_k"))
    joined = keys.join(found, by, "left") if by else keys.join(F.broadcast(found), how="left")
    return joined.select(*by, F.coalesce("area", F.lit(0.5)).alias("area"))


def metrics(df: DataFrame, p: str, y: str, by: list[str] | None = None) -> DataFrame:
    """The whole bundle by keys: n, accuracy, log_loss, brier_score, roc_auc, the
    calibration and tail metrics. Keys must not be null; rows with a null score or
    outcome are left out."""
    by = by or []
    known = df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    out = known.groupBy(*by).agg(*[c.alias(n) for n, c in row_metrics(F.col(p), F.col(y)).items()])
    counts = score_counts(known, p, y, by)
    ranks = counts.groupBy(*by).agg(*[c.alias(n) for n, c in rank_metrics().items()])
    corners = [partial_auc(counts, by, flip).withColumnRenamed("area", f"_{i}") for i, flip in enumerate((False, True))]
    for part in (ranks, *corners):
        out = out.join(part, by) if by else out.join(F.broadcast(part))
    return out.withColumn("partial_auc_tail", (F.col("_0") + F.col("_1")) / 2).drop("_0", "_1")
