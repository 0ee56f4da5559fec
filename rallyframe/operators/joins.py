"""Joins in time, enrichment and identity joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import events_agree, quotient
from ..functions.windows import micros


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, take: list[str]) -> DataFrame:
    """``left`` with the ``take`` columns of the last right row at or before its
    time, by key; null where there is none.

    Both sides go through one shuffle by key and one sort, and a running
    "last value" carries right rows to the left ones: no row meets a range of
    others, as a join on inequality would make it. Right rows of equal time are
    ordered by their ``take`` values, so the result is defined.
    """
    row = F.struct(*[F.col(c) for c in left.columns])
    value = F.struct(*[F.col(c) for c in take])
    l = left.select(*keys, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), row.alias("_row"))
    r = right.where(F.col(right_time).isNotNull()).select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), value.alias("_value"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side", "_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = l.unionByName(r, allowMissingColumns=True).withColumn("_found", F.last("_value", ignorenulls=True).over(w))
    return both.where("_side = 1").select("_row.*", *[F.col("_found")[c].alias(c) for c in take])


def latest_before(snapshots: DataFrame, times: DataFrame, key: str, time: str, at: str, take: list[str], by: list[str] | None = None) -> DataFrame:
    """For each row of ``times`` (key, at) and each group ``by`` of its key: the
    ``take`` values of the last snapshot at or before ``at``; none without one.
    Ties go to the largest ``take`` values.

    The moments are spread over the key's groups and meet the snapshots in one
    ordered pass (``asof_backward``), so a history isn't read once a moment.
    """
    by = by or []
    asked = times.select(key, at).join(snapshots.select(key, *by).distinct(), key) if by else times.select(key, at)
    found = asof_backward(asked.distinct(), snapshots.withColumn("_seen", F.col(time)), [key, *by], at, "_seen", [time, *take])
    return found.where(F.col(time).isNotNull()).select(key, *by, at, time, *take)


def before_anchor(snapshots: DataFrame, anchors: DataFrame, key: str, time: str, anchor: str, hours: list[int], take: str) -> DataFrame:
    """For each anchor and each N in ``hours``: the last value at or before
    anchor - N hours, and how many minutes earlier it is. One ordered pass over
    the snapshots and all cuts."""
    steps = F.explode(F.array(*[F.lit(h) for h in hours])).alias("hours")
    cuts = anchors.select(key, anchor, steps).withColumn("_cut", micros(F.col(anchor)) - F.col("hours").cast("long") * 3_600_000_000)
    seen = snapshots.select(key, micros(F.col(time)).alias("_at"), F.col(take).alias(take))
    found = asof_backward(cuts, seen.withColumn("_seen", F.col("_at")), [key], "_cut", "_seen", ["_at", take]).where("_at IS NOT NULL")
    return found.select(key, anchor, "hours", take, ((F.col("_cut") - F.col("_at")) / 60_000_000).alias("lag_minutes"))


def nearest_in_time(left: DataFrame, right: DataFrame, key: str, left_id: str, left_time: str, right_time: str, take: list[str], hours: int = 24) -> DataFrame:
    """For each left row the right row of its key nearest in time within
    ``hours``; ties go to the earlier row, then to the least values. Rows meet
    by key and day, each right row under its day and the two beside it."""
    day = lambda c: F.to_date(c)
    span = hours // 24 + (1 if hours % 24 else 0)
    near = right.withColumn("_day", F.explode(F.sequence(F.date_sub(day(right_time), span), F.date_add(day(right_time), span))))
    gap = F.abs(micros(F.col(right_time)) - micros(F.col(left_time)))
    met = left.withColumn("_day", day(left_time)).join(near.select(key, "_day", right_time, *take), [key, "_day"]).withColumn("_gap", gap).where(F.col("_gap") <= hours * 3_600_000_000)
    best = met.groupBy(left_id).agg(F.min(F.struct("_gap", right_time, *take)).alias("_m"))
    return left.join(best, left_id, "left").select(left["*"], F.col("_m")[right_time].alias(right_time), *[F.col("_m")[c].alias(c) for c in take])


def range_pairs(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, days: int) -> DataFrame:
    """Pairs with equal key and right time in [left - days, left). Each side is
    also keyed by windows of ``days``, a left row under its own and the one
    before, so a long history of one key is split over many tasks."""
    width = days * 86_400_000_000
    slot = lambda c: F.floor(micros(F.col(c)) / width)
    l = left.withColumn("_slot", F.explode(F.array(slot(left_time), slot(left_time) - 1)))
    r = right.withColumn("_slot", slot(right_time))
    gap = micros(F.col(left_time)) - micros(F.col(right_time))
    return l.join(r, [key, "_slot"]).where((gap > 0) & (gap <= width)).drop("_slot")


def kernel_mean(pairs: DataFrame, keys: list[str], weight: Column, value: Column, shrink: float) -> DataFrame:
    """Weighted mean pulled to 0 by ``shrink``, and the effective sample size,
    not a number if no weight can be told from 0."""
    p = pairs.withColumns({"_w": weight, "_v": value})
    w, w2, wv = F.sum("_w"), F.sum(F.col("_w") * F.col("_w")), F.sum(F.col("_w") * F.col("_v"))
    return p.groupBy(*keys).agg(quotient(wv, w + F.lit(shrink)).alias("kernel_mean"), quotient(w * w, w2).alias("effective_n"), F.count(F.lit(1)).alias("n"))


def waterfall(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Full outer join on ``keys`` with each field taken from the left side
    first, then the right: conflicting sources in order of priority."""
    r = right.select(*keys, *[F.col(f).alias(f"_r_{f}") for f in fields])
    joined = left.select(*keys, *fields).join(r, keys, "full")
    return joined.select(*keys, *[F.coalesce(F.col(f), F.col(f"_r_{f}")).alias(f) for f in fields])


def mirror(df: DataFrame, pair: str, side: str, fields: list[str], prefix: str = "opp_") -> DataFrame:
    """Each row with the other row's fields, for pairs of rows. Both rows of a
    pair stand in one window, so there is one shuffle and no join; a pair of
    one row has nulls."""
    w = Window.partitionBy(pair).orderBy(side)
    both = F.struct(*[F.col(f) for f in fields])
    met = df.withColumn("_both", both).withColumn("_other", F.when(F.row_number().over(w) == 1, F.lead("_both").over(w)).otherwise(F.lag("_both").over(w)))
    return met.select(*df.columns, *[F.col("_other")[f].alias(f"{prefix}{f}") for f in fields])


def enrich_roles(df: DataFrame, dim: DataFrame, key: str, roles: dict[str, str], fields: list[str]) -> DataFrame:
    """One dimension joined once for each role: ``roles`` maps a column of
    ``df`` to the prefix of the fields it brings."""
    for column, prefix in roles.items():
        side = dim.select(F.col(key).alias(column), *[F.col(f).alias(f"{prefix}{f}") for f in fields])
        df = df.join(side, column, "left")
    return df


def unique_or_rejected(candidates: DataFrame, event: str, target: str) -> DataFrame:
    """Events with exactly one candidate target."""
    return candidates.groupBy(event).agg(F.countDistinct(target).alias("_n"), F.min(target).alias(target)).where("_n = 1").drop("_n")


def resolve_pairs(events: DataFrame, matches: DataFrame, event: str, match: str, sides: tuple[str, str], time: str, days: int) -> DataFrame:
    """Events matched to the one match of the same unordered pair of names
    within ``days``; ambiguous events are left out."""
    pair = lambda: F.array_sort(F.array(*[F.col(s) for s in sides])).alias("_pair")
    e = events.select(event, pair(), F.col(time).alias("_et"))
    m = matches.select(match, pair(), F.col(time).alias("_mt"))
    near = F.abs(F.datediff("_et", "_mt")) <= days
    return unique_or_rejected(e.join(m, "_pair").where(near), event, match)


#: Days that stand for an unknown distance, above all known ones.
NO_GAP = 2**31 - 1


def map_events(events: DataFrame, matches: DataFrame, days: int | None = None) -> DataFrame:
    """(event, match, outcome): each event's match, narrowed in stages.

    ``events`` has event, a and b (players' ids, null if unknown), at, and
    tournament (name, may be null); ``matches`` has match, a, b, date, year and
    tournament, names normalised on both sides. Candidates share the unordered
    pair. Those of the event's year are kept if there are any, then those whose
    tournament's words agree, then the nearest in time, if within ``days``.

    outcome: mapped; unresolved (a player unknown), no_match (the pair never
    met), tournament_rejected, ambiguous (several are as near) or too_far.

    Events don't meet their candidates one by one: the nearest matches before and
    after are running last values over the days of a pair, name and year.
    """
    pair = lambda: F.array_sort(F.array("a", "b")).alias("_pair")
    known = F.col("a").isNotNull() & F.col("b").isNotNull()
    e = events.select("event", F.when(known, pair()).alias("_pair"), F.to_date("at").alias("_day"), F.coalesce("tournament", F.lit("")).alias("_name"))
    m = matches.where(F.col("match").isNotNull()).groupBy(pair(), F.to_date("date").alias("_day"), F.col("year").cast("int").alias("_year"), F.coalesce("tournament", F.lit("")).alias("_of")).agg(F.min("match").alias("_low"), F.max("match").alias("_high"))
    # What decides an event is its pair, day and name: each of these is told once.
    moments = e.where(F.col("_pair").isNotNull()).select("_pair", "_day", "_name").distinct()
    years = m.groupBy("_pair").agg(F.collect_set("_year").alias("_years"))
    moments = moments.join(years, "_pair").withColumn("_some", F.coalesce(F.array_contains("_years", F.year("_day")), F.lit(False))).drop("_years")
    # A scope is a year, or null for all matches of the pair.
    moments = moments.withColumn("_scope", F.when(F.col("_some"), F.year("_day")))
    names = moments.select("_pair", "_name").distinct().join(m.select("_pair", "_of").distinct(), "_pair").where(events_agree(F.col("_name"), F.col("_of")))
    scope = F.explode(F.array_distinct(F.array("_year", F.lit(None).cast("int")))).alias("_scope")
    fit = m.join(names, ["_pair", "_of"]).select("_pair", "_name", "_day", "_low", "_high", scope)
    dated = fit.withColumn("_some", F.lit(None).cast("boolean")).unionByName(moments.withColumns({c: F.lit(None).cast(fit.schema[c].dataType) for c in ("_low", "_high")}))
    dated = dated.groupBy("_pair", "_name", "_scope", "_day").agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"), F.max("_some").alias("_some"))
    every = Window.partitionBy("_pair", "_name", "_scope")
    held = F.when(F.col("_low").isNotNull() & F.col("_day").isNotNull(), F.struct("_day", "_low", "_high"))
    near = {"_all_low": F.min("_low").over(every), "_all_high": F.max("_high").over(every)}
    for side, order in (("_before", F.col("_day").asc_nulls_first()), ("_after", F.col("_day").desc_nulls_first())):
        near[side] = F.when(F.col("_day").isNotNull(), F.last(held, ignorenulls=True).over(every.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    told = dated.withColumns(near).where(F.col("_some").isNotNull())
    gaps = {side: F.abs(F.datediff("_day", F.col(side)["_day"])) for side in ("_before", "_after")}
    told = told.withColumn("_gap", F.least(*gaps.values()))
    # Without any distance all that fit are as near.
    end = lambda pick, c: F.when(F.col("_gap").isNull(), F.col(f"_all{c}")).otherwise(pick(*[F.when(g == F.col("_gap"), F.col(side)[c]) for side, g in gaps.items()]))
    told = told.select("_pair", "_name", "_day", "_some", "_gap", end(F.least, "_low").alias("_low"), end(F.greatest, "_high").alias("_high"))
    same = [F.col(f"e.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ("_pair", "_name", "_day")]
    met = e.alias("e").join(told.alias("t"), same[0] & same[1] & same[2], "left").select("event", F.col("e._pair").isNull().alias("_unknown"), "_some", "_gap", "_low", "_high")
    # An event of several rows: those of its year if any has one, then the nearest.
    far = F.coalesce("_gap", F.lit(NO_GAP))
    best = {}
    for name, of in (("year", F.col("_some")), ("any", ~F.col("_some"))):
        held = of & F.col("_low").isNotNull()
        best |= {f"_{name}_low": F.min(F.when(held, F.struct(far.alias("gap"), F.col("_low").alias("match")))), f"_{name}_high": F.max(F.when(held, F.struct((-far).alias("gap"), F.col("_high").alias("match"))))}
    out = met.groupBy("event").agg(F.max("_unknown").alias("_unknown"), F.max("_some").alias("_same_year"), *[c.alias(k) for k, c in best.items()])
    low, high = (F.when(F.col("_same_year"), F.col(f"_year_{c}")).otherwise(F.col(f"_any_{c}")) for c in ("low", "high"))
    outcome = F.when(F.col("_unknown"), "unresolved").when(F.col("_same_year").isNull(), "no_match").when(low.isNull(), "tournament_rejected").when(low["match"] != high["match"], "ambiguous")
    outcome = outcome.when((low["gap"] > days) & (low["gap"] < NO_GAP), "too_far") if days is not None else outcome
    told = out.select("event", low["match"].alias("match"), outcome.otherwise("mapped").alias("outcome"))
    return told.select("event", F.when(F.col("outcome") == "mapped", F.col("match")).alias("match"), "outcome")


def stale_rows(planned: DataFrame, known: DataFrame, keys: list[str], field: str) -> DataFrame:
    """``planned`` without rows that ``known`` contradicts: equal keys, other ``field``."""
    other = known.select(*keys, F.col(field).alias("_known"))
    wrong = planned.join(other, keys).where(F.col(field) != F.col("_known")).select(*keys, field).distinct()
    return planned.join(wrong, [*keys, field], "left_anti")
