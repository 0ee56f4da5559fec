"""Reports on predictions and bets: segments, stability, agreement, confidence."""

from __future__ import annotations

import sys
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import quantiles
from .evaluate import favourite, metric_columns


def by_segment(df: DataFrame, segments: dict[str, Column], p: str, y: str) -> DataFrame:
    """Metrics of every value of every segment: each row is spread over its
    segments and summed before the shuffle."""
    spread = F.array(*[F.struct(F.lit(n).alias("segment"), c.cast("string").alias("value")) for n, c in segments.items()])
    rows = df.select(F.col(p).alias("_p"), F.col(y).alias("_y"), F.explode(spread).alias("_s")).select("_p", "_y", "_s.*")
    return rows.groupBy("segment", "value").agg(*metric_columns(F.col("_p"), F.col("_y")))


def yearly_drift(df: DataFrame, time: str, p: str, y: str) -> DataFrame:
    """Accuracy of each year against that of all years, and the largest drift."""
    _, right = favourite(F.col(p), F.col(y))
    per = df.groupBy(F.year(time).alias("year")).agg(F.count(F.lit(1)).alias("n"), F.sum(right.cast("int")).alias("_r"))
    every = Window.partitionBy(F.lit(1))
    out = per.withColumn("accuracy", F.col("_r") / F.col("n")).withColumn("overall", F.sum("_r").over(every) / F.sum("n").over(every))
    return out.withColumn("drift", F.abs(F.col("accuracy") - F.col("overall"))).withColumn("max_drift", F.max("drift").over(every)).drop("_r")


def agreement(df: DataFrame, models: list[str], y: str) -> DataFrame:
    """For each pair of models: how often they pick the same side, how often
    that is right, the correlation of their scores and their mean distance."""
    parts = []
    for i, a in enumerate(models):
        for b in models[i + 1 :]:
            same = (F.col(a) >= 0.5) == (F.col(b) >= 0.5)
            right = (F.col(a) >= 0.5) == (F.col(y) == 1)
            parts.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.avg(same.cast("int")).alias("same"), F.avg(F.when(same, right.cast("int"))).alias("right_if_same"), F.corr(a, b).alias("corr"), F.avg(F.abs(F.col(a) - F.col(b))).alias("distance")))
    out = df.agg(F.array(*parts).alias("_p"))
    return out.select(F.explode("_p").alias("_p")).select("_p.*")


def consensus(df: DataFrame, models: list[str], y: str) -> DataFrame:
    """Accuracy by the number of models that pick side 1."""
    votes = sum(((F.col(m) >= 0.5).cast("int") for m in models), F.lit(0))
    mean = sum((F.col(m) for m in models), F.lit(0.0)) / len(models)
    return df.groupBy(votes.alias("votes")).agg(F.count(F.lit(1)).alias("n"), F.avg(((mean >= 0.5) == (F.col(y) == 1)).cast("int")).alias("accuracy"))


def coverage_curve(df: DataFrame, p: str, y: str, bars: list[float]) -> DataFrame:
    """Share of rows and their accuracy at or above each confidence."""
    conf, right = favourite(F.col(p), F.col(y))
    rows = df.select(conf.alias("_c"), right.cast("int").alias("_r"), F.explode(F.array(*[F.lit(b) for b in bars])).alias("bar"))
    kept = F.col("_c") >= F.col("bar")
    return rows.groupBy("bar").agg(F.avg(kept.cast("int")).alias("coverage"), F.avg(F.when(kept, F.col("_r"))).alias("accuracy"))


def leave_one_out(df: DataFrame, models: list[str], y: str) -> DataFrame:
    """Brier score of the mean of all models, and of all but one."""
    total = sum((F.col(m) for m in models), F.lit(0.0))
    of = lambda c, n: F.avg((c - F.col(y)) * (c - F.col(y))).alias(n)
    parts = [of(total / len(models), "_all"), *[of((total - F.col(m)) / (len(models) - 1), m) for m in models]]
    row = df.agg(*parts)
    return row.select(F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("brier_without"), (F.col(m) - F.col("_all")).alias("contribution")) for m in models])).alias("_m")).select("_m.*")


def threshold_conditions(df: DataFrame, columns: list[str], p: str, y: str, levels: tuple[float, ...] = (0.9, 0.95, 0.99)) -> DataFrame:
    """Metrics where a feature is extreme: |x| at or above its 90th, 95th and
    99th percentile, nulls as 0. The bounds are one row; conditions overlap."""
    filled = df.select(F.col(p).alias("_p"), F.col(y).alias("_y"), *[F.abs(F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in columns])
    edges = reduce(lambda a, b: a.join(F.broadcast(b)), [quantiles(filled, c, list(levels)).withColumnRenamed("q", f"_{c}") for c in columns])
    hits = F.filter(F.array(*[F.when(F.col(c) >= F.col(f"_{c}")[i], F.lit(f"|{c}|>=p{round(100 * v)}")) for c in columns for i, v in enumerate(levels)]), lambda x: x.isNotNull())
    rows = filled.join(F.broadcast(edges)).select("_p", "_y", F.explode(hits).alias("condition"))
    return rows.groupBy("condition").agg(*metric_columns(F.col("_p"), F.col("_y")))


def signed_buckets(df: DataFrame, column: str, p: str, y: str) -> DataFrame:
    """Metrics in five parts of a signed feature, cut at its 10th, 25th, 75th and
    90th percentile; nulls as 0. The tails hold their ends."""
    filled = df.select(F.col(p).alias("_p"), F.col(y).alias("_y"), F.coalesce(F.col(column).cast("double"), F.lit(0.0)).alias("_x"))
    rows = filled.join(F.broadcast(quantiles(filled, "_x", [0.1, 0.25, 0.75, 0.9])))
    x, q = F.col("_x"), [F.col("q")[i] for i in range(4)]
    bucket = F.when(x <= q[0], "<=p10").when(x <= q[1], "p10-p25").when(x < q[2], "p25-p75").when(x < q[3], "p75-p90").otherwise(">=p90")
    return rows.groupBy(bucket.alias("bucket")).agg(*metric_columns(F.col("_p"), F.col("_y")))


def error_tiers(df: DataFrame, p: str, y: str, bars: tuple[float, ...] = (0.6, 0.7, 0.8, 0.9)) -> DataFrame:
    """For each bar the rows scored at or above it, the wrong ones among them and
    their share (0 without any): one aggregation, then a row a bar."""
    wrong = (F.col(p) >= 0.5).cast("int") != F.col(y)
    tiers = [F.struct(F.lit(b).alias("bar"), F.count_if(F.col(p) >= b).alias("n"), F.count_if((F.col(p) >= b) & wrong).alias("errors")) for b in bars]
    out = df.agg(F.array(*tiers).alias("_t")).select(F.explode("_t").alias("_t")).select("_t.*")
    return out.withColumn("error_rate", F.coalesce(F.try_divide("errors", "n"), F.lit(0.0)))


def ensemble_outcomes(df: DataFrame, models: list[str], y: str) -> DataFrame:
    """Rows by whether all models agree and whether their mean is right, with shares."""
    votes = sum(((F.col(m) >= 0.5).cast("int") for m in models), F.lit(0))
    mean = sum((F.col(m) for m in models), F.lit(0.0)) / len(models)
    right = (mean >= 0.5).cast("int") == F.col(y)
    kind = F.concat(F.when(votes.isin(0, len(models)), "all_agree_").otherwise("disagree_"), F.when(right, "correct").otherwise("wrong"))
    counts = df.groupBy(kind.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def lone_dissenters(df: DataFrame, models: list[str], y: str) -> DataFrame:
    """For each model the rows where it alone differs from the majority, and how
    often it and the majority are right there (0 without any)."""
    sides = [(F.col(m) >= 0.5).cast("int") for m in models]
    votes = sum(sides, F.lit(0))
    majority = (votes / len(models) >= 0.5).cast("int")
    parts = []
    for m, side in zip(models, sides, strict=True):
        alone = (side != majority) & (votes - side == majority * (len(models) - 1))
        rate = lambda pick, alone=alone: F.coalesce(F.avg(F.when(alone, (pick == F.col(y)).cast("int"))), F.lit(0.0))
        parts.append(F.struct(F.lit(m).alias("model"), F.count_if(alone).alias("n"), rate(side).alias("dissenter_correct"), rate(majority).alias("majority_correct")))
    return df.agg(F.array(*parts).alias("_p")).select(F.explode("_p").alias("_p")).select("_p.*")


def regression_metrics(df: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    e = predicted - actual
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), (1 - F.try_divide(F.sum(e * e), F.var_pop(actual) * F.count(actual))).alias("r2"))


def crps(df: DataFrame, key: str, pmf: str, actual: str) -> DataFrame:
    """Continuous ranked probability score of a distribution over 0, 1, ..."""
    cum = F.aggregate(F.col(pmf), F.struct(F.lit(0.0).alias("cum"), F.lit(0.0).alias("score"), F.lit(0).alias("k")), lambda a, x: F.struct(
        (a["cum"] + x).alias("cum"), (a["score"] + F.pow(a["cum"] + x - (F.col(actual) <= a["k"]).cast("int"), F.lit(2.0))).alias("score"), (a["k"] + 1).alias("k")), lambda a: a["score"])
    beyond = F.greatest(F.col(actual) - F.size(pmf), F.lit(0))
    return df.select(key, (cum + beyond).alias("crps"))


def _resample(rows: pd.DataFrame, draws: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    n = len(rows)
    sums, counts = rows["s"].to_numpy(), rows["n"].to_numpy()
    out = np.empty(draws)
    for i in range(draws):
        pick = rng.integers(0, n, n)
        out[i] = sums[pick].sum() / counts[pick].sum()
    return out


def clustered_bootstrap(df: DataFrame, cluster: str, x: str, group: str, draws: int = 500, seed: int = 42) -> DataFrame:
    """Mean of ``x`` by group with a 95% interval from resampling clusters.
    Rows are first summed by cluster, so a task holds clusters, not rows."""
    def interval(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("c")
        means = _resample(rows, draws, seed)
        return pd.DataFrame({"g": [rows["g"].iloc[0]], "mean": [rows["s"].sum() / rows["n"].sum()], "low": [np.quantile(means, 0.025)], "high": [np.quantile(means, 0.975)], "clusters": [len(rows)]})

    per = df.groupBy(F.col(group).alias("g"), F.col(cluster).alias("c")).agg(F.sum(x).cast("double").alias("s"), F.count(x).cast("double").alias("n")).where("n > 0")
    kind = df.schema[group].dataType.simpleString()
    return per.groupBy("g").applyInPandas(interval, f"g {kind}, mean double, low double, high double, clusters long").withColumnRenamed("g", group)


def recent_sequences(df: DataFrame, key: str, order: list[str], fields: list[str], length: int = 20) -> DataFrame:
    """Each row with its key's last ``length`` earlier rows, oldest first."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-length, -1)
    return df.withColumn("history", F.collect_list(F.struct(*fields)).over(w))


def bet_report(bets: DataFrame, time: str, unit: str, groups: list[str]) -> DataFrame:
    """Bets, wins, profit and yield by period and group."""
    return bets.groupBy(F.date_trunc(unit, F.col(time)).cast("date").alias("period"), *groups).agg(
        F.count("pnl").alias("n_bets"), F.count_if(F.col("pnl") > 0).alias("n_won"), F.sum("pnl").alias("profit"), F.avg("pnl").alias("yield"))


def bet_metrics(gate: float = 0.0) -> list[Column]:
    """One aggregation over picked bets (edge, won, pnl, clv): all of them, and of
    those from ``gate`` on their number, hit rate (pushes aside), return, units,
    mean edge and value against the close."""
    gated = F.col("edge") >= gate
    of = lambda c: F.when(gated, c)
    return [
        F.count(F.lit(1)).alias("n"), F.count_if(gated).alias("n_gated"), F.avg(of(F.col("won").cast("int"))).alias("hit_rate"), F.avg(of(F.col("pnl"))).alias("roi"), F.sum(of(F.col("pnl"))).alias("units_gated"), F.sum("pnl").alias("units_all"),
        F.avg(of(F.col("edge"))).alias("avg_edge"), F.avg(of(F.col("clv"))).alias("avg_clv"), F.avg(of((F.col("clv") > 0).cast("int"))).alias("clv_pos_rate"), F.count(of(F.col("clv"))).alias("n_clv")]


# Bands of edge, low end included. The first holds all others.
EDGE_BANDS = (("all", -1.0, 1.0), ("<0", -1.0, 0.0), ("0-2pp", 0.0, 0.02), ("2-5pp", 0.02, 0.05), ("5-10pp", 0.05, 0.10), ("10pp+", 0.10, 1.0))


def band_curve(bets: DataFrame, on: str = "edge") -> DataFrame:
    """Bets, hit rate, return, units and mean edge by band of ``on``; each bet is
    spread over its bands and summed before the shuffle."""
    bands = F.array(*[F.struct(F.lit(n).alias("band"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for n, lo, hi in EDGE_BANDS])
    met = F.filter(bands, lambda b: (F.col(on) >= b["lo"]) & (F.col(on) < b["hi"]))
    rows = bets.select("won", "pnl", "edge", F.explode(F.transform(met, lambda b: b["band"])).alias("band"))
    return rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("won").cast("int")).alias("hit_rate"), F.avg("pnl").alias("roi"), F.sum("pnl").alias("units"), F.avg("edge").alias("avg_edge"))


def period_start(time: Column, months: int) -> Column:
    """First day of the calendar period of 1, 3, 6 or 12 months."""
    if months not in (1, 3, 6, 12):
        raise ValueError(f"periods have 1, 3, 6 or 12 months, not {months}")
    return F.make_date(F.year(time), F.floor((F.month(time) - 1) / months).cast("int") * months + 1, F.lit(1))


def segment_calibration(df: DataFrame, segments: list[str], p: str, y: str) -> DataFrame:
    """Calibration in five bands of confidence from 0.5 for every combination of
    segment values, empty bands as zeros: one row a segment and band. Scores
    below 0.5 count for the segment's n_overall only."""
    key = F.concat_ws("|", *[F.coalesce(F.col(s).cast("string"), F.lit("")) for s in segments])
    band = F.when(F.col(p) >= 0.5, F.least(F.floor((F.col(p) - 0.5) / 0.1 + 1e-9), F.lit(4)).cast("int"))
    per = df.groupBy(key.alias("segment"), band.alias("_b")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("p"), F.avg(y).alias("y"))
    held = per.groupBy("segment").agg(F.sum("n").alias("n_overall"), F.map_from_entries(F.collect_list(F.when(F.col("_b").isNotNull(), F.struct("_b", F.struct("n", "p", "y"))))).alias("_m"))
    each = held.select("segment", "n_overall", "_m", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("band")).withColumn("_v", F.try_element_at("_m", F.col("band")))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return each.select("segment", "band", "n_overall", F.coalesce("_v.n", F.lit(0)).alias("n"), zero(F.col("_v.p")).alias("predicted"), zero(F.col("_v.y")).alias("actual"), zero(F.col("_v.y") - F.col("_v.p")).alias("err"))


def rule_votes(rules: dict[str, Column]) -> Column:
    """Net votes: +1 for each rule that points to the player, -1 against."""
    return sum((F.when(c, 1).when(~c, -1).otherwise(0) for c in rules.values()), F.lit(0))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
