"""Folds in time: by rows or by months, with growing or sliding training parts.

Every splitter returns the rows of each fold with ``fold`` and ``part`` (train or
test). Folds by months are a short list; those by rows are evenly spaced, so that
the run of folds a row lies in follows from its place, however many there are.
"""

from __future__ import annotations

from datetime import date
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def positions(df: DataFrame, time: str, tie: list[str], sums: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with _at, its place from 0 in the order of time and ``tie``, and _to_x,
    the total of each of ``sums`` up to and with the row. Rows are numbered within
    their date; only a row a date goes through the window without keys."""
    day, totals = F.to_date(time), {f"_to_{k}": c for k, c in (sums or {}).items()}
    per = df.groupBy(day.alias("_day")).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(k) for k, c in totals.items()])
    earlier = Window.orderBy(F.col("_day").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    before = per.select("_day", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), *[F.sum(k).over(earlier).alias(f"_before{k}") for k in totals])
    dated = df.withColumn("_day", day).alias("d").join(before.alias("b"), F.col("d._day").eqNullSafe(F.col("b._day"))).select("d.*", "_before", *[f"_before{k}" for k in totals])
    within = Window.partitionBy("_day").orderBy(time, *tie)
    nil = F.lit(0)
    placed = {"_at": F.col("_before") + F.row_number().over(within) - 1} | {k: F.coalesce(f"_before{k}", nil) + F.coalesce(F.sum(c).over(within.rowsBetween(Window.unboundedPreceding, 0)), nil) for k, c in totals.items()}
    return dated.withColumns(placed).drop("_day", "_before", *[f"_before{k}" for k in totals])


def spread(df: DataFrame, at: Column, folds: list[tuple]) -> DataFrame:
    """Rows with ``at`` in [train from, train to) or [test from, test to) of each fold."""
    if not folds:
        return df.withColumns({"fold": F.lit(0), "part": F.lit("")}).limit(0)
    spans = F.array(*[F.struct(F.lit(i).alias("fold"), F.lit(part).alias("part"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a0, b0, a1, b1) in enumerate(folds) for part, a, b in (("train", a0, b0), ("test", a1, b1))])
    met = F.filter(spans, lambda s: (at >= s["a"]) & (at < s["b"]))
    return df.withColumn("_s", F.explode(met)).withColumns({"fold": F.col("_s.fold"), "part": F.col("_s.part")}).drop("_s")


def spread_even(df: DataFrame, at: Column, number: int, first: tuple, step: tuple) -> DataFrame:
    """``spread`` for ``number`` folds whose bounds grow by ``step`` from ``first``
    on: a row's folds are a run of numbers, and no list of all folds is held."""
    def met(bound: int, by: int, bare: Column) -> Column:
        """The last fold whose bound isn't above ``at``; ``bare`` where all have the same."""
        x = at - F.lit(bound)
        return ((x - F.pmod(x, F.lit(by))) / F.lit(by)).cast("long") if by else bare

    runs = []
    for part, a, b, by_a, by_b in (("train", *first[:2], *step[:2]), ("test", *first[2:], *step[2:])):
        low = met(b, by_b, F.when(at < b, -1).otherwise(number)) + 1
        high = met(a, by_a, F.when(at >= a, number - 1).otherwise(-1))
        runs.append(F.struct(F.lit(part).alias("part"), F.greatest(low, F.lit(0)).cast("long").alias("low"), F.least(high, F.lit(number - 1)).cast("long").alias("high")))
    some = F.filter(F.array(*runs), lambda r: r["low"] <= r["high"])
    return df.withColumn("_s", F.explode(some)).withColumn("fold", F.explode(F.sequence("_s.low", "_s.high"))).withColumns({"fold": F.col("fold").cast("int"), "part": F.col("_s.part")}).drop("_s")


def even_expanding(n: int, *, n_splits: int | None = None, min_train_size: int | None = None, test_size: int | None = None, initial_train_size: int | None = None, step_size: int | None = None) -> tuple[int, tuple, tuple]:
    """Folds over ``n`` rows whose training part starts at the first row: either
    ``n_splits`` evenly spaced ones, or as many steps as fit. Returns their number,
    the first one's bounds and what each bound grows by."""
    if (n_splits is None) == (step_size is None):
        raise ValueError("give either n_splits or step_size")
    if n_splits is not None:
        if min_train_size is None or test_size is None:
            raise ValueError("n_splits needs min_train_size and test_size")
        spare = n - min_train_size - test_size
        if spare < 0:
            raise ValueError(f"{n} rows are fewer than {min_train_size + test_size}")
        step = 0 if n_splits == 1 else spare // n_splits
        return n_splits, (0, min_train_size, min_train_size, min_train_size + test_size), (0, step, step, step)
    if initial_train_size is None:
        raise ValueError("step_size needs initial_train_size")
    e = initial_train_size
    return len(range(e, n - step_size + 1, step_size)), (0, e, e, e + step_size), (0, step_size, step_size, step_size)


def even_sliding(n: int, train_size: int, test_size: int, step_size: int | None = None) -> tuple[int, tuple, tuple]:
    """Folds over ``n`` rows with a training part of fixed size, as above."""
    step = step_size or test_size
    return len(range(0, n - train_size - test_size + 1, step)), (0, train_size, train_size, train_size + test_size), (step,) * 4


def listed(number: int, first: tuple, step: tuple) -> list[tuple]:
    return [tuple(a + i * by for a, by in zip(first, step, strict=True)) for i in range(number)]


def expanding_rows(n: int, **sizes) -> list[tuple]:
    """Folds over ``n`` rows whose training part starts at the first row."""
    return listed(*even_expanding(n, **sizes))


def sliding_rows(n: int, train_size: int, test_size: int, step_size: int | None = None) -> list[tuple]:
    """Folds over ``n`` rows with a training part of fixed size."""
    return listed(*even_sliding(n, train_size, test_size, step_size))


def month_folds(first: date, last: date, train_months: int, test_months: int, sliding: bool) -> list[tuple]:
    """Folds in months: test spans follow each other from ``train_months`` after the
    first month on, as long as whole ones fit; the training part is the months
    before, all of them or the last ``train_months``."""
    if train_months <= 0 or test_months <= 0:
        raise ValueError("spans of months must be positive")
    month = lambda k: date(k // 12, k % 12 + 1, 1)
    low, high = first.year * 12 + first.month - 1, last.year * 12 + last.month
    starts = range(low + train_months, high - test_months + 1, test_months)
    return [(month(s - train_months if sliding else low), month(s), month(s), month(s + test_months)) for s in starts]


def row_folds(df: DataFrame, kind: str, sizes: dict) -> tuple[int, tuple, tuple]:
    return (even_sliding if kind == "sliding_window" else even_expanding)(df.count(), **sizes)


def split_totals(df: DataFrame, kind: str, sums: dict[str, Column], time: str = "effective_match_date", tie: list[str] | None = None, **sizes) -> DataFrame:
    """(fold, part, n and the total of each of ``sums``) of the rows that ``split``
    gives for a kind by rows. Growing training parts hold a row as often as there
    are folds after it; here a part's total is the difference of running totals
    at its bounds, exact for whole numbers and decimals."""
    number, first, step = row_folds(df, kind, sizes)
    known = {f"_n_{k}": F.when(c.isNotNull(), 1) for k, c in sums.items()}
    rows = positions(df, time, tie or [], sums | known).withColumn("_end", F.col("_at") + 1)
    is_bound = [F.pmod(F.col("_end") - a, F.lit(by)) == 0 if by else F.col("_end") == a for a, by in set(zip(first, step, strict=True))]
    ends = rows.where(reduce(or_, is_bound)).select("_end", *[f"_to_{k}" for k in sums | known])
    bounds = F.array(*[F.struct(F.lit(part).alias("part"), F.lit(sign).alias("sign"), (F.lit(a) + F.col("fold") * F.lit(by)).cast("long").alias("end")) for part, sign, a, by in zip(("train", "train", "test", "test"), (-1, 1, -1, 1), first, step, strict=True)])
    cuts = df.sparkSession.range(number).withColumnRenamed("id", "fold").select(F.col("fold").cast("int").alias("fold"), F.explode(bounds).alias("_b")).select("fold", "_b.part", F.col("_b.sign").alias("_sign"), F.col("_b.end").alias("_end"))
    # No row ends at 0, where all totals are 0.
    met = cuts.join(ends, "_end", "left")
    out = met.groupBy("fold", "part").agg(F.sum(F.col("_sign") * F.col("_end")).alias("n"), *[F.sum(F.col("_sign") * F.coalesce(f"_to_{k}", F.lit(0))).alias(f"_to_{k}") for k in sums | known])
    return out.where("n > 0").select("fold", "part", "n", *[F.when(F.col(f"_to__n_{k}") > 0, F.col(f"_to_{k}")).alias(k) for k in sums])


def split(df: DataFrame, kind: str, time: str = "effective_match_date", tie: list[str] | None = None, **sizes) -> DataFrame:
    """Rows of every fold with fold and part. ``kind``: walk_forward or
    expanding_window (by rows, growing), sliding_window (by rows), date_sliding,
    date_expanding (by months) or date_window (one split at ``test_start``).

    By months, folds without rows on either side are left out; a date window
    with an empty side is an error when rows are read. The bounds cost one small
    aggregation.
    """
    if kind in ("walk_forward", "expanding_window", "sliding_window"):
        return spread_even(positions(df, time, tie or []), F.col("_at"), *row_folds(df, kind, sizes)).drop("_at")
    at = F.to_date(time)
    if kind == "date_window":
        cut = sizes["test_start"]
        sides = df.agg(F.count_if(at < cut).alias("train"), F.count_if(at >= cut).alias("test")).first()
        if not sides.train or not sides.test:
            raise ValueError(f"no rows {'before' if not sides.train else 'from'} {cut}")
        return df.where(at.isNotNull()).withColumns({"fold": F.lit(0), "part": F.when(at < cut, "train").otherwise("test")})
    if kind not in ("date_sliding", "date_expanding"):
        raise ValueError(f"unknown split: {kind!r}")
    first, last = df.agg(F.min(at), F.max(at)).first()
    folds = month_folds(first, last, sizes["train_months"], sizes["test_months"], kind == "date_sliding") if first else []
    rows = spread(df, at, folds)
    both = rows.groupBy("fold").agg(F.countDistinct("part").alias("_parts")).where("_parts = 2").select("fold")
    return rows.join(F.broadcast(both), "fold", "left_semi")
