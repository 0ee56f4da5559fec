"""Integration: fields from several sources, rounds, dates, weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Order of rounds within a draw, qualifying first.
ROUND_ORDER = {"Q1": 1, "Q2": 2, "Q3": 3, "RR": 4, "R128": 5, "R64": 6, "R32": 7, "R16": 8, "QF": 9, "SF": 10, "F": 11}


def round_ordinal(round_: Column) -> Column:
    """Place of a round; null for an unknown one."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in ROUND_ORDER.items() for x in kv]), F.upper(round_))


def swap_sides(df: DataFrame, disagree: Column, first: str, second: str, fields: list[str]) -> DataFrame:
    """Exchange the two sides' fields where a source names them the other way."""
    swap = F.coalesce(disagree, F.lit(False))
    both = {}
    for f in fields:
        a, b = F.col(f"{first}{f}"), F.col(f"{second}{f}")
        both |= {f"{first}{f}": F.when(swap, b).otherwise(a), f"{second}{f}": F.when(swap, a).otherwise(b)}
    return df.withColumns(both)


#: Circuits whose listed span may merge several weeks, and the days they last.
SHORT_CIRCUITS, SHORT_DAYS = ("itf", "chal"), 6


def effective_date(df: DataFrame, tournament: list[str], draw: str, round_order: str, start: str, end: str, scheduled: str, circuit: str | None = None, event_type: str | None = None, strict: bool = True) -> DataFrame:
    """``df`` with effective_match_date.

    A match without a schedule takes the latest one of its tournament, draw and
    round. If then all of the tournament's matches have one, that is the date.
    Otherwise rounds are laid evenly over the tournament's days (six at most on
    short circuits) from its start; qualifying rounds of a Grand Slam (round
    order 3 and below) lie on the days before it. A match that gets no date is an
    error when rows are read, or null if not ``strict``. One shuffle by tournament.
    """
    t = Window.partitionBy(*tournament)
    peers = F.max(scheduled).over(Window.partitionBy(*tournament, draw, round_order))
    placed = df.withColumn("_known", F.coalesce(F.col(scheduled), peers)).withColumn("_offset", F.when(F.col(round_order).isNotNull(), F.dense_rank().over(t.orderBy(F.col(round_order).asc_nulls_last())) - 1))
    days = F.datediff(end, start)
    days = F.when(F.col(circuit).isin(*SHORT_CIRCUITS) & (days > SHORT_DAYS), SHORT_DAYS).otherwise(days) if circuit else days
    last = F.max("_offset").over(t)
    share = F.when(last > 0, F.round(F.col("_offset") * days / last)).otherwise(0).cast("int")
    if event_type:
        share = F.when((F.col(event_type) == "GS") & (F.col(round_order) <= 3), F.col(round_order) - 4).otherwise(share).cast("int")
    whole = F.count("_known").over(t) == F.count(F.lit(1)).over(t)
    moment = lambda c: c.cast("timestamp_ntz")
    found = F.when(whole, moment(F.col("_known"))).otherwise(moment(F.date_add(F.col(start).cast("date"), share)))
    if strict:
        found = F.coalesce(found, F.raise_error(F.lit("a match has no effective date")).cast("timestamp_ntz"))
    return placed.withColumn("effective_match_date", found).drop("_known", "_offset")


def odds_movement(snapshots: DataFrame, keys: list[str], time: str, price: str, tie: str) -> DataFrame:
    """Changes of a price from one snapshot to the next, without repeats."""
    w = Window.partitionBy(*keys).orderBy(time, tie)
    return snapshots.withColumn("_before", F.lag(price).over(w)).where(F.col("_before").isNull() | (F.col(price) != F.col("_before"))).withColumn("change", F.col(price) - F.col("_before")).drop("_before")


#: Minutes that a match on a court is taken to last, and the notes
#: that set a court's clock.
SLOT_MINUTES, CLOCKS = 90, ("Starts At", "Not Before")


def court_times(df: DataFrame, court: list[str], place: str, scheduled: str, note: str) -> DataFrame:
    """``df`` with scheduled_datetime and is_time_estimated: a match that follows
    others on its court is put as many slots after the last one with a clock time
    as it lies places behind."""
    w = Window.partitionBy(*court).orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    clock = F.when(F.col(scheduled).isNotNull() & F.col(note).isin(*CLOCKS), F.struct(F.col(scheduled).alias("t"), F.col(place).alias("p")))
    last = F.last(clock, ignorenulls=True).over(w)
    follows = F.col(scheduled).isNull() & (F.col(note) == "Followed By")
    guess = F.when(follows, last["t"] + F.make_dt_interval(mins=((F.col(place) - last["p"]) * SLOT_MINUTES).cast("int")))
    return df.withColumn("_guess", guess).withColumns({"is_time_estimated": F.col(scheduled).isNull(), "scheduled_datetime": F.coalesce(F.col(scheduled), "_guess")}).drop("_guess")
