"""Markets: the board at a moment, main lines, entry anchors, policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import micros


#: Books whose prices serve as a reference and can't be taken, and
#: how long before the start the close is read.
REFERENCE_BOOKS = ("pinnacle",)
CLOSE_LEAD_MINUTES = 15
NOT_STARTED = "NOT_STARTED"
SIDES = ("over", "under")


def quotes(ticks: DataFrame, books: list[str] | None = None, prematch: bool = True, match: str = "match_uid") -> DataFrame:
    """Ticks of known matches with a price above 1, of ``books`` and before the start."""
    kept = ticks.where(F.col(match).isNotNull() & (F.col("odds") > 1.0))
    kept = kept.where(F.col("status") == NOT_STARTED) if prematch else kept
    return kept.where(F.col("book").isin(books)) if books is not None else kept


def board_at(ticks: DataFrame, times: DataFrame, books: list[str] | None = None, prematch: bool = True, match: str = "match_uid", at: str = "t", time: str = "ts") -> DataFrame:
    """What every book had on the board of each match at the match's moment: one
    row a (match, book, points) with both sides' last price at or before it.

    p_over is the over side's share of the implied chances, overround their sum
    and imbalance the distance of p_over from a half; null for a one-sided rung.
    Prices carry on after a book stops a side: live_over and live_under tell, live
    is both. quote_age_s is the age of the older side, last_change_s of the newer.
    Each book's main line is its live two-sided rung with the least imbalance, the
    lowest one at a tie; n_two_sided counts those it was chosen from and
    separation is the runner-up's imbalance less its own.

    A match may have one moment only: with more this fails. Ticks of equal time
    go by price. The moments meet the ticks by match and one aggregation finds
    both sides, combined before its shuffle.
    """
    one = times.groupBy(match).agg(F.min(at).alias(at), F.count(F.lit(1)).alias("_n"))
    one = one.select(match, F.when(F.col("_n") == 1, F.col(at)).otherwise(F.raise_error(F.lit("a match may have one moment only"))).alias(at))
    seen = quotes(ticks, books, prematch, match).join(one, match).where(F.col(time) <= F.col(at))
    last = F.struct(F.col(time).alias("ts"), "odds", "active")
    side = lambda s: F.max(F.when(F.col("side") == s, last)).alias(f"_{s}")
    rungs = seen.groupBy(match, "book", "points").agg(F.first(at).alias(at), *[side(s) for s in SIDES])
    over, under = F.col("_over.odds"), F.col("_under.odds")
    live = [F.coalesce(F.col(f"_{s}.active"), F.lit(False)) for s in SIDES]
    age = lambda c: F.floor((micros(F.col(at)) - micros(c)) / 1_000_000).cast("long")
    two = (1 / over) / (1 / over + 1 / under)
    out = rungs.select(
        match, "book", "points", over.alias("over_odds"), under.alias("under_odds"), two.alias("p_over"), (1 / over + 1 / under).alias("overround"), F.abs(two - 0.5).alias("imbalance"),
        (live[0] & live[1]).alias("live"), live[0].alias("live_over"), live[1].alias("live_under"), age(F.least("_over.ts", "_under.ts")).alias("quote_age_s"), age(F.greatest("_over.ts", "_under.ts")).alias("last_change_s"))
    return flag_main_lines(out, match)


def flag_main_lines(board: DataFrame, match: str = "match_uid") -> DataFrame:
    """``board`` with is_main_line, n_two_sided and separation; see ``board_at``."""
    eligible = F.col("imbalance").isNotNull() & F.col("live")
    book = Window.partitionBy(match, "book")
    order = book.orderBy(F.when(eligible, 0).otherwise(1), "imbalance", "points")
    main = eligible & (F.row_number().over(order) == 1)
    following = F.lead(F.when(eligible, F.col("imbalance"))).over(order)
    return board.withColumns({"is_main_line": main, "n_two_sided": F.count_if(eligible).over(book), "separation": F.when(main, following - F.col("imbalance"))})


def main_line_support(board: DataFrame, match: str = "match_uid") -> DataFrame:
    """One row a (match, points) that some book has as its main line: which books
    and how many, and over the match how many have one and how far they spread."""
    lines = board.where("is_main_line").groupBy(match, "points").agg(F.countDistinct("book").alias("n_books_on_line"), F.array_sort(F.collect_set("book")).alias("books"))
    every = Window.partitionBy(match)
    return lines.withColumns({"n_books_live": F.sum("n_books_on_line").over(every), "line_spread": F.max("points").over(every) - F.min("points").over(every)})


def formed(ticks: DataFrame, n_books: int, match: str = "match_uid", time: str = "ts", tie: str = "tick_id") -> DataFrame:
    """(match, formed_at): when each match first has ``n_books`` books with a rung
    whose two sides are live; matches that never have are left out. A sweep over
    events: the last state of each side makes a rung live or not, changes of
    state count live rungs of a book, and changes between none and some count
    books. Changes of one instant are summed first, so that a book swapping one
    rung for another leaves no gap."""
    rung = Window.partitionBy(match, "book", "points").orderBy(time, tie)
    live = lambda s: F.coalesce(F.last(F.when(F.col("side") == s, F.col("active")), ignorenulls=True).over(rung), F.lit(False))
    state = ticks.withColumn("_live", live("over") & live("under"))
    step = F.col("_live").cast("int") - F.coalesce(F.lag("_live").over(rung), F.lit(False)).cast("int")
    moves = state.withColumn("_step", step).where("_step <> 0").groupBy(match, "book", time).agg(F.sum("_step").alias("_step"))
    book = Window.partitionBy(match, "book").orderBy(time)
    rungs = moves.withColumn("_rungs", F.sum("_step").over(book.rowsBetween(Window.unboundedPreceding, 0)))
    up = (F.col("_rungs") > 0).cast("int") - F.coalesce((F.lag("_rungs").over(book) > 0).cast("int"), F.lit(0))
    books = rungs.withColumn("_up", up).where("_up <> 0").groupBy(match, time).agg(F.sum("_up").alias("_up"))
    run = Window.partitionBy(match).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    return books.withColumn("_books", F.sum("_up").over(run)).where(F.col("_books") >= n_books).groupBy(match).agg(F.min(time).alias("formed_at"))


def anchor(name: str, ticks: DataFrame, starts: DataFrame, match: str = "match_uid", time: str = "ts", tie: str = "tick_id") -> DataFrame:
    """(match, t) of a named moment: open (the first book), formedN (N books live
    together), close (a fixed lead before the start) or offsetH (H hours before
    it). Of a match's several starts the latest counts; matches without one are
    left out."""
    takeable = quotes(ticks, match=match).where(~F.col("book").isin(*REFERENCE_BOOKS))
    if name == "open" or name.startswith("formed"):
        n = 1 if name == "open" else int(name.removeprefix("formed") or 2)
        if n < 1:
            raise ValueError("a market is formed by one book at least")
        return formed(takeable, n, match, time, tie).withColumnRenamed("formed_at", "t")
    if name != "close" and not name.startswith("offset"):
        raise ValueError(f"unknown anchor: {name!r}")
    seconds = CLOSE_LEAD_MINUTES * 60 if name == "close" else int(float(name.removeprefix("offset")) * 3600)
    start = starts.where(F.col(match).isNotNull() & F.col("start").isNotNull()).groupBy(match).agg(F.max("start").alias("start"))
    return start.select(match, (F.col("start") - F.expr(f"INTERVAL '{seconds}' SECOND")).alias("t"))


def pick(candidates: DataFrame, keys: list[str], policy: str, tie: str) -> DataFrame:
    """One candidate a key by policy: main (most books, then best price),
    safest (highest model_p) or max_edge; nulls last."""
    orders = {"main": [F.desc_nulls_last("n_books"), F.desc_nulls_last("price")], "safest": [F.desc_nulls_last("model_p")], "max_edge": [F.desc_nulls_last("edge")]}
    w = Window.partitionBy(*keys).orderBy(*orders[policy], tie)
    return candidates.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def settle_bets(bets: DataFrame) -> DataFrame:
    """Profit of one unit staked at ``price``: over or under ``points`` against
    ``total``; equal is a push and returns the stake, a null total is open."""
    diff = F.when(F.col("side") == "over", F.col("total") - F.col("points")).otherwise(F.col("points") - F.col("total"))
    return bets.withColumn("pnl", F.when(diff > 0, F.col("price") - 1).when(diff < 0, F.lit(-1.0)).when(diff == 0, F.lit(0.0)))
