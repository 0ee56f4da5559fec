"""Temporally safe window expressions.

Rolling forms cover [t - N days, t): rows tied with the current one at t never
count. They order by microseconds so that the range frame ends one microsecond
before t. Cumulative forms cover the rows before the current one in a total
order, whose last key must be unique within the group.

Expressions that share keys and order share one shuffle and one sort: build
them with the same ``Over`` and put them in one select.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000


def micros(ts: Column) -> Column:
    """Microseconds of a date or time; zone-less times are read in the session's zone."""
    return F.unix_micros(ts.cast("timestamp"))


@dataclass(frozen=True)
class Over:
    """Keys, time and tie-breaking order of a family of window expressions."""

    keys: tuple[str, ...]
    time: str
    order: tuple[str, ...] = ()

    def rolling(self, days: int):
        return Window.partitionBy(*self.keys).orderBy(micros(F.col(self.time))).rangeBetween(-days * DAY, -1)

    def same_day(self, days: int, offset: str):
        """Earlier rows of the same date count too: time plus an offset in
        microseconds, in a window one second longer."""
        key = micros(F.col(self.time)) + F.coalesce(F.col(offset), F.lit(0))
        return Window.partitionBy(*self.keys).orderBy(key).rangeBetween(-(days * DAY + 1_000_000), -1)

    def ordered(self):
        return Window.partitionBy(*self.keys).orderBy(self.time, *self.order)

    def before(self):
        return self.ordered().rowsBetween(Window.unboundedPreceding, -1)

    def whole(self):
        return Window.partitionBy(*self.keys)


def _filled(c: Column, fill) -> Column:
    return c if fill is None else F.coalesce(c, F.lit(fill))


def rolling_sum(x: Column, over: Over, days: int, fill=0) -> Column:
    return _filled(F.sum(x).over(over.rolling(days)), fill)


def rolling_count(over: Over, days: int) -> Column:
    """Rows in the window; 0 for a row without a time."""
    return F.when(F.col(over.time).isNull(), F.lit(0)).otherwise(F.count(F.lit(1)).over(over.rolling(days)))


def rolling_mean(x: Column, over: Over, days: int) -> Column:
    return F.avg(x).over(over.rolling(days))


def rolling_max(x: Column, over: Over, days: int) -> Column:
    return F.max(x).over(over.rolling(days))


def rolling_std(x: Column, over: Over, days: int) -> Column:
    """Sample deviation; null for fewer than two values."""
    return F.stddev_samp(x).over(over.rolling(days))


def same_day_sum(x: Column, over: Over, days: int, offset: str) -> Column:
    return F.sum(x).over(over.same_day(days, offset))


def same_day_std(x: Column, over: Over, days: int, offset: str) -> Column:
    return F.stddev_samp(x).over(over.same_day(days, offset))


def cumulative_sum(x: Column, over: Over, fill=None) -> Column:
    """Sum of the earlier rows; null right after a row whose value is null, and
    on the first row, before ``fill`` applies."""
    prior = F.when(F.lag(x).over(over.ordered()).isNotNull(), F.sum(x).over(over.before()))
    return _filled(prior, fill)


def cumulative_count(over: Over) -> Column:
    return F.count(F.lit(1)).over(over.before())


def cumulative_mean(x: Column, over: Over) -> Column:
    return F.avg(x).over(over.before())


def cumulative_std(x: Column, over: Over) -> Column:
    return F.stddev_samp(x).over(over.before())


def cumulative_max(x: Column, over: Over) -> Column:
    return F.max(x).over(over.before())


def masked_rate(num: Column, den: Column, over: Over) -> Column:
    """Ratio of earlier totals over rows where both sides are known; null until
    one is, and where the denominator is not positive."""
    known = num.isNotNull() & den.isNotNull()
    n, d = (F.sum(F.when(known, c)).over(over.before()) for c in (num, den))
    return F.when(d > 0, n / d)


def pooled_ratio(df: DataFrame, num: str, den: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Ratio of totals, overall or for each stratum; a table of one row a stratum."""
    g = df.groupBy(*by) if by else df.groupBy()
    return g.agg(F.try_divide(F.sum(num), F.sum(den)).alias("pooled"))


def with_prior(df: DataFrame, known: DataFrame, num: str, den: str, by: str) -> DataFrame:
    """``df`` with ``pooled``, the ratio of its stratum in ``known``, or of all of
    it where that has none. One pass over ``known``; a row a stratum is joined."""
    sums = known.groupBy(by).agg(F.sum(num).alias("_n"), F.sum(den).alias("_d"))
    strata = sums.select(F.col(by).alias("_k"), F.try_divide("_n", "_d").alias("_own"))
    every = sums.agg(F.try_divide(F.sum("_n"), F.sum("_d")).alias("_every"))
    out = df.join(F.broadcast(strata), F.col(by).eqNullSafe(F.col("_k")), "left").join(F.broadcast(every))
    return out.withColumn("pooled", F.coalesce("_own", "_every")).drop("_k", "_own", "_every")


def shrunk_ratio(n: Column, d: Column, k: float = 0.0, pooled: Column | None = None) -> Column:
    """n / d, pulled to ``pooled`` with the weight of ``k`` observations; null
    without history or with a denominator that is not positive."""
    if not k:
        return F.when(d > 0, n / d)
    return F.when(d > 0, (n + F.lit(k) * pooled) / (d + F.lit(k)))


def last_known(x: Column, when: Column, over: Over) -> Column:
    """The last earlier non-null ``x`` among rows where ``when`` holds."""
    return F.last(F.when(when, x), ignorenulls=True).over(over.before())


def days_since_last(over: Over) -> Column:
    t = F.col(over.time)
    return F.datediff(t, F.lag(t).over(over.ordered()))


def interleaved(x: Column, over: Over, days: int) -> Column:
    """Whether this row, the next and the one after read A, B, A within ``days``."""
    w = over.ordered()
    span = micros(F.lead(F.col(over.time), 2).over(w)) - micros(F.col(over.time))
    return F.coalesce((F.lead(x, 2).over(w) == x) & (F.lead(x, 1).over(w) != x) & (span <= days * DAY), F.lit(False))


def instance_average(df: DataFrame, x: Column, over: Over, instance: str, name: str = "instance_avg") -> DataFrame:
    """``df`` with the mean of the totals of the key's instances that have ended
    before the row; null before the first has. A total counts from the row after
    the instance's last one, so that of an instance which runs on isn't known
    early. All windows split by the same keys: one shuffle."""
    whole = Window.partitionBy(*over.keys, instance)
    last = F.row_number().over(whole.orderBy(F.desc(over.time), *[F.desc(o) for o in over.order])) == 1
    marked = df.withColumn("_total", F.sum(x).over(whole)).withColumn("_ended", F.when(last, F.col("_total")))
    return marked.withColumn(name, F.avg("_ended").over(over.before())).drop("_total", "_ended")


def population_window(df: DataFrame, time: str, x: str, days: int) -> DataFrame:
    """Count, sum and sum of squares of all rows in [d - N days, d) for each
    date d. Rows are reduced to dates first, so the window without keys runs
    over one row a date, not over the table."""
    day = F.to_date(time)
    per_day = df.groupBy(day.alias("day")).agg(F.count(x).alias("n"), F.sum(x).alias("s"), F.sum(F.col(x) * F.col(x)).alias("q"))
    w = Window.orderBy(F.unix_date("day")).rangeBetween(-days, -1)
    return per_day.select("day", *[F.sum(c).over(w).alias(f"pop_{c}") for c in "nsq"])


def others_field(df: DataFrame, key: str, time: str, x: str, days: int) -> DataFrame:
    """(key, day, mean, std): of everybody else's values in the days before; null
    with fewer than two of those or where they are all equal."""
    day = F.to_date(time)
    own = df.groupBy(F.col(key), day.alias("day")).agg(F.count(x).alias("n"), F.sum(x).alias("s"), F.sum(F.col(x) * F.col(x)).alias("q"))
    w = Window.partitionBy(key).orderBy(F.unix_date("day")).rangeBetween(-days, -1)
    own = own.select(key, "day", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"own_{c}") for c in "nsq"])
    both = own.join(population_window(df, time, x, days), "day")
    n, s, q = (F.col(f"pop_{c}") - F.col(f"own_{c}") for c in "nsq")
    # Sums of squares leave rounding noise where all values are equal.
    var = F.greatest(F.try_divide(q - F.try_divide(s * s, n), n - 1), F.lit(0.0))
    known = (n >= 2) & (var > 1e-12)
    return both.select(key, "day", F.when(known, s / n).alias("mean"), F.when(known, F.sqrt(var)).alias("std"))


def leave_one_out_z(df: DataFrame, key: str, time: str, x: str, days: int) -> DataFrame:
    """``df`` with loo_z: the row's own value against ``others_field``."""
    field = others_field(df, key, time, x, days)
    return df.withColumn("day", F.to_date(time)).join(field, [key, "day"], "left").withColumn("loo_z", (F.col(x) - F.col("mean")) / F.col("std")).drop("mean", "std")


def rolling_population_quantile(df: DataFrame, time: str, x: str, days: int, q: float, slices: int = 256) -> DataFrame:
    """Nearest-rank quantile of all values in [d - N days, d) for each date d.

    Values are counted by date and slice of their range (of its inverse hyperbolic
    sine, so that long tails spread). Windows by slice over a row a date find the
    slice that holds the rank; each date then meets the distinct values of that
    slice only, by an equal join on the window's dates.
    """
    known = df.select(F.to_date(time).alias("of"), F.col(x).cast("double").alias("v")).where(F.col("of").isNotNull() & F.col("v").isNotNull())
    scale = F.asinh("v")
    span = known.agg(F.min(scale).alias("_lo"), F.max(scale).alias("_hi"))
    place = F.least(F.floor(F.coalesce(F.try_divide(scale - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0)) * slices), F.lit(slices - 1)).cast("int")
    held = known.join(F.broadcast(span)).groupBy("of", place.alias("slice"), "v").agg(F.count(F.lit(1)).alias("n"))
    days_at = df.select(F.to_date(time).alias("day")).where("day IS NOT NULL").distinct()
    grid = days_at.select("day", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")).withColumn("n", F.lit(None).cast("long"))
    seen = grid.unionByName(held.groupBy(F.col("of").alias("day"), "slice").agg(F.sum("n").alias("n")))
    earlier = Window.partitionBy("slice").orderBy(F.unix_date("day")).rangeBetween(-days, -1)
    counts = seen.withColumn("k", F.coalesce(F.sum("n").over(earlier), F.lit(0))).where("n IS NULL")
    every, run = Window.partitionBy("day"), Window.partitionBy("day").orderBy("slice")
    rank = F.floor((F.sum("k").over(every) - 1) * F.lit(q) + 0.5) + 1
    chosen = counts.withColumns({"rank": rank, "through": F.sum("k").over(run)}).where((F.col("k") > 0) & (F.col("through") >= F.col("rank")) & (F.col("through") - F.col("k") < F.col("rank"))).select("day", "slice", (F.col("rank") - F.col("through") + F.col("k")).alias("need"))
    window = chosen.select("day", "slice", "need", F.explode(F.sequence(F.date_sub("day", days), F.date_sub("day", 1))).alias("of"))
    values = window.join(held, ["of", "slice"]).groupBy("day", "need", "v").agg(F.sum("n").alias("n"))
    found = values.withColumn("through", F.sum("n").over(Window.partitionBy("day").orderBy("v"))).where("through >= need").groupBy("day").agg(F.min("v").alias("quantile"))
    return days_at.join(found, "day", "left")


def concurrency(df: DataFrame, keys: tuple[str, ...], time: str, change: Column, order: tuple[str, ...]) -> Column:
    """How many are live after each +1/-1 transition, in order."""
    w = Window.partitionBy(*keys).orderBy(time, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.sum(change).over(w)
