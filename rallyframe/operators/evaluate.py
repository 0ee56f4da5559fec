"""Evaluation of probabilities: splits, metrics, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import quantiles
from .metrics import score_counts

EPS = 1e-15


def log_loss(p: Column, y: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - EPS)), F.lit(EPS))
    return -(F.when(y == 1, F.ln(q)).otherwise(F.ln(1 - q)))


def brier(p: Column, y: Column) -> Column:
    return (p - y) * (p - y)


def favourite(p: Column, y: Column) -> tuple[Column, Column]:
    """Probability of the likelier side, and whether it won."""
    return F.greatest(p, 1 - p), F.when(p >= 0.5, y == 1).otherwise(y == 0)


def metric_columns(p: Column, y: Column) -> list[Column]:
    conf, right = favourite(p, y)
    sure = conf >= 0.8
    return [
        F.count(F.lit(1)).alias("n"), F.avg(right.cast("int")).alias("accuracy"), F.avg(log_loss(p, y)).alias("log_loss"), F.avg(brier(p, y)).alias("brier"),
        (F.avg(conf) - F.avg(right.cast("int"))).alias("signed_calibration"), F.try_divide(F.count_if(sure & ~right), F.count_if(sure)).alias("err80"),
    ]


def auc(df: DataFrame, p: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve; ties get half. Null for a single class. See
    ``metrics.score_counts`` for how ranks are counted."""
    by = by or []
    counts = score_counts(df.where(F.col(p).isNotNull()), p, y, by)
    area = F.try_divide(F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)), F.first("n_pos") * F.first("n_neg"))
    return counts.groupBy(*by).agg(area.alias("auc"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def calibration(df: DataFrame, p: Column, y: Column) -> DataFrame:
    """Bands of five points of confidence from 0.50, the last one closed."""
    conf, right = favourite(p, y)
    band = F.least(F.floor((conf - 0.5) / 0.05 + 1e-9), F.lit(9)).cast("int")
    return df.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.avg(conf).alias("confidence"), F.avg(right.cast("int")).alias("accuracy")).withColumn("gap", F.abs(F.col("confidence") - F.col("accuracy")))


def calibration_error(bands: DataFrame) -> DataFrame:
    return bands.agg((F.sum(F.col("gap") * F.col("n")) / F.sum("n")).alias("ece"), F.max("gap").alias("max_gap"))


def decile_calibration(df: DataFrame, p: str, y: str) -> DataFrame:
    """Tenths of the score: edges by percentile, then one aggregation; a value
    on an edge belongs below. The edges are nine numbers."""
    edges = quantiles(df, p, [i / 10 for i in range(1, 10)]).withColumnRenamed("q", "e")
    placed = df.join(F.broadcast(edges)).withColumn("decile", F.size(F.filter("e", lambda x: x < F.col(p))) + 1)
    return placed.groupBy("decile").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("mean_y"))


def months_ahead(df: DataFrame, time: str, p: str, y: str, months: int) -> DataFrame:
    """Mean score and outcome over the ``months`` up to and with each month:
    sums by month first, then a window over months."""
    month = F.date_trunc("month", F.col(time)).cast("date")
    per = df.groupBy(month.alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("sp"), F.sum(y).alias("sy"))
    w = Window.orderBy(F.year("month") * 12 + F.month("month")).rangeBetween(-(months - 1), 0)
    n, sp, sy = (F.sum(c).over(w) for c in ("n", "sp", "sy"))
    return per.select("month", n.alias("n"), (sp / n).alias("mean_p"), (sy / n).alias("mean_y"), (sp / n - sy / n).alias("drift"))


def walk_forward(df: DataFrame, time: str, train_months: int | None, test_months: int, step_months: int) -> DataFrame:
    """Rows of every fold, each with fold and part. Test spans of ``test_months``
    follow each other by ``step_months``; the training part is all that comes
    before (None: expanding) or the last ``train_months`` (sliding). Bounds come
    from the months present, a small table joined by month, so rows meet
    folds by an equal join."""
    ordinal = F.year(time) * 12 + F.month(time) - 1
    span = df.agg(F.min(ordinal).alias("lo"), F.max(ordinal).alias("hi"))
    first = F.col("lo") + (train_months or 1)
    starts = F.when(first <= F.col("hi"), F.sequence(first, F.col("hi"), F.lit(step_months)))
    folds = span.select("lo", "hi", F.posexplode(starts).alias("fold", "start"))
    least = F.greatest(F.col("lo"), F.col("start") - train_months) if train_months else F.col("lo")
    train = F.transform(F.sequence(least, F.col("start") - 1), lambda m: F.struct(m.alias("month"), F.lit("train").alias("part")))
    test = F.transform(F.sequence(F.col("start"), F.least("hi", F.col("start") + test_months - 1)), lambda m: F.struct(m.alias("month"), F.lit("test").alias("part")))
    months = folds.select("fold", F.explode(F.concat(train, test)).alias("_m")).select("fold", "_m.month", "_m.part")
    return df.withColumn("month", ordinal).join(months, "month").drop("month")


def isotonic_fit(df: DataFrame, p: str, y: str):
    """Isotonic calibration on a score column."""
    from pyspark.ml.regression import IsotonicRegression

    return IsotonicRegression(featuresCol=p, labelCol=y, predictionCol=f"{p}_calibrated").fit(df.select(F.col(p).cast("double").alias(p), F.col(y).cast("double").alias(y)))


def platt_fit(df: DataFrame, p: str, y: str):
    """Logistic calibration on the log odds of a score column: (slope, intercept)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    q = F.greatest(F.least(F.col(p), F.lit(1 - 1e-6)), F.lit(1e-6))
    rows = VectorAssembler(inputCols=["_z"], outputCol="_x").transform(df.select(F.ln(q / (1 - q)).alias("_z"), F.col(y).cast("double").alias("_y")))
    m = LogisticRegression(featuresCol="_x", labelCol="_y").fit(rows)
    return float(m.coefficients[0]), float(m.intercept)
