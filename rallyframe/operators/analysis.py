"""The analysis dataset: predictions with outcomes, prices, edges and bets, one
row a match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregates import cross_book, first_live, open_close
from .joins import nearest_in_time
from .prices import NOT_STARTED

#: Prices of a side by name: over books, of closes, openings and extremes.
PRICES = {"best_closing_odds": "best_close", "worst_closing_odds": "worst_close", "avg_closing_odds": "avg_close", "best_intraday_odds": "best_intraday", "worst_intraday_odds": "worst_intraday", "best_opening_odds": "best_open"}
#: Prices of the predicted side, and the edges taken from some of them.
PREDICTED = {"pred_odds_best_close": "best_closing_odds", "pred_odds_worst_close": "worst_closing_odds", "pred_odds_avg_close": "avg_closing_odds", "pred_odds_open": "best_opening_odds", "pred_odds_best_intraday": "best_intraday_odds", "pred_odds_worst_intraday": "worst_intraday_odds"}
EDGES = {"model_edge_best_close": "pred_odds_best_close", "model_edge_avg_close": "pred_odds_avg_close", "model_edge_open": "pred_odds_open"}


def book_prices(snapshots: DataFrame, tie: str) -> DataFrame:
    """(match_uid, player_id) and ``PRICES`` over books, from prices before the
    start; of each book its first, last, least and highest."""
    before = snapshots.where(F.col("status") == NOT_STARTED)
    closes = open_close(before, ["match_uid", "player_id", "book"], "at", "odds", tie)
    keys = ["match_uid", "player_id"]
    return cross_book(closes, keys).join(closes.groupBy(*keys).agg(F.max("open").alias("best_open")), keys)


def of_sides(prices: DataFrame, predictions: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(match_uid) and each column for p1 and p2, from one aggregation."""
    met = prices.join(predictions.select("match_uid", "p1_id", "p2_id"), "match_uid")
    side = lambda s, c, n: F.max(F.when(F.col("player_id") == F.col(f"{s}_id"), F.col(c))).alias(f"{n}_{s}")
    return met.groupBy("match_uid").agg(*[side(s, c, n) for n, c in columns.items() for s in ("p1", "p2")])


def _pick(which: Column, name: str) -> Column:
    return F.when(which == "P1", F.col(f"{name}_p1")).when(which == "P2", F.col(f"{name}_p2"))


def market_at_bets(bets: DataFrame, snapshots: DataFrame, books: list[str], hours: int = 24) -> DataFrame:
    """(match_uid) with the mean and range over books of the price nearest to the
    bet's moment, within ``hours``, on the bet's player, and their number; bets
    without one are left out."""
    key = lambda: F.concat_ws("|", "match_uid", "player_id", "book")
    asked = bets.where(F.col("placed_at").isNotNull() & F.col("player_id").isNotNull()).select("match_uid", "player_id", "placed_at", F.explode(F.array(*[F.lit(b) for b in books])).alias("book"))
    seen = snapshots.where(F.col("status") == NOT_STARTED).select(key().alias("_key"), "at", "odds")
    near = nearest_in_time(asked.withColumn("_key", key()), seen, "_key", "_key", "placed_at", "at", ["odds"], hours).where("odds IS NOT NULL")
    return near.groupBy("match_uid").agg(F.avg("odds").alias("market_avg_at_bet"), (F.max("odds") - F.min("odds")).alias("market_range_at_bet"), F.count(F.lit(1)).alias("n_books_at_bet"))


def analysis_dataset(predictions: DataFrame, results: DataFrame, snapshots: DataFrame, bets: DataFrame, books: list[str], tie: str = "tick_id") -> DataFrame:
    """One row a prediction, with everything else joined to it by match.

    ``predictions``: match_uid, p1_id, p2_id, p1_win_prob, p2_win_prob; ``results``:
    match_uid, winner_id; ``snapshots``: match_uid, book, player_id, odds, at,
    status; ``bets``: one a match with bet_side (P1, P2), bet_odds, placed_at.

    Adds result, status and model_correct; the cross-book prices of both sides;
    pred_side, pred_prob, and that side's prices and edges; bet_edge_open, the
    value of the bet against closes, and the market at its moment;
    first_live_at. What is missing is null.
    """
    p = predictions.withColumns({"pred_side": F.when(F.col("p1_win_prob") > 0.5, "P1").otherwise("P2"), "pred_prob": F.greatest("p1_win_prob", "p2_win_prob")})
    known = results.groupBy("match_uid").agg(F.max("winner_id").alias("winner_id"))
    out = p.join(known, "match_uid", "left").withColumn("result", F.when(F.col("winner_id") == F.col("p1_id"), "P1").when(F.col("winner_id") == F.col("p2_id"), "P2")).drop("winner_id")
    out = out.withColumns({"status": F.when(F.col("result").isNotNull(), "resolved").otherwise("pending"), "model_correct": F.when(F.col("result").isNotNull(), F.col("pred_side") == F.col("result"))})
    out = out.join(of_sides(book_prices(snapshots, tie), predictions, PRICES), "match_uid", "left").withColumns({n: _pick(F.col("pred_side"), c) for n, c in PREDICTED.items()})
    out = out.withColumns({n: F.col("pred_prob") - 1 / F.col(c) for n, c in EDGES.items()})
    placed = bets.join(predictions.select("match_uid", "p1_id", "p2_id"), "match_uid").withColumn("player_id", F.when(F.col("bet_side") == "P1", F.col("p1_id")).when(F.col("bet_side") == "P2", F.col("p2_id")))
    out = out.join(bets.select("match_uid", "bet_side", "bet_odds"), "match_uid", "left")
    side = F.col("bet_side")
    chance = F.when(side == "P1", F.col("p1_win_prob")).when(side == "P2", F.col("p2_win_prob"))
    out = out.withColumn("bet_edge_open", chance - 1 / _pick(side, "best_opening_odds"))
    against = lambda c: F.when(_pick(side, c) > 0, (F.col("bet_odds") - _pick(side, c)) / _pick(side, c))
    out = out.withColumns({f"clv_vs_{n}": against(f"{n}_closing_odds") for n in ("best", "worst", "avg")})
    out = out.join(market_at_bets(placed, snapshots, books), "match_uid", "left").withColumn("bet_vs_market_at_bet", F.when(F.col("market_avg_at_bet") > 0, (F.col("bet_odds") - F.col("market_avg_at_bet")) / F.col("market_avg_at_bet")))
    return out.join(first_live(snapshots, "match_uid", "at", "status").withColumnRenamed("anchor_at", "first_live_at"), "match_uid", "left")


# Bands of edge, a point wide and open beyond ten; from above 0 the
# low end is included, from 0 down the high end.
BANDS = (*[(f"edge_{k}pct", k / 100, (k + 1) / 100 if k < 10 else None) for k in range(10, -1, -1)], *[(f"neg_{k}pct", -(k + 1) / 100 if k < 10 else None, -k / 100) for k in range(11)])


def edge_bands(edge: Column) -> Column:
    """The names of the bands that an edge lies in: one, or none for a null."""
    def inside(name: str, low: float | None, high: float | None) -> Column:
        if name.startswith("neg"):
            return (edge <= high) & (edge > low) if low is not None else edge <= high
        above = edge > low if low == 0 else edge >= low
        return above & (edge < high) if high is not None else above
    return F.filter(F.array(*[F.when(inside(*b), F.lit(b[0])) for b in BANDS]), lambda x: x.isNotNull())


def scenario_grid(rows: DataFrame, bases: dict[str, tuple[str, str]], flats: dict[str, str], chosen: dict[str, tuple[Column, str]], segments: list[str], won: str = "model_correct") -> DataFrame:
    """Flat stakes of one unit in every scenario and segment: one pass.

    ``bases`` gives each basis its price and edge: a bet lies in the scenario of
    its edge's band there. ``flats`` are scenarios of all rows at a price,
    ``chosen`` of those that meet a condition. A row is spread over its scenarios
    and segments and summed before the shuffle; rows without a price in a
    scenario are left out there, as are null segment values. Unsettled rows don't
    belong in ``rows``.
    """
    def banded(name: str, odds: str, edge: str) -> Column:
        suffix = F.lit(f"_{name}" if name else "")
        return F.transform(edge_bands(F.col(edge)), lambda b: F.struct(F.concat(b, suffix).alias("scenario"), F.col(odds).alias("odds")))

    each = [banded(name, *columns) for name, columns in bases.items()]
    each.append(F.array(*[F.struct(F.lit(n).alias("scenario"), F.col(o).alias("odds")) for n, o in flats.items()]))
    each += [F.when(c, F.array(F.struct(F.lit(n).alias("scenario"), F.col(o).alias("odds")))).otherwise(F.array().cast("array<struct<scenario:string,odds:double>>")) for n, (c, o) in chosen.items()]
    scenarios = F.filter(F.flatten(F.array(*each)), lambda s: s["odds"].isNotNull())
    places = F.filter(F.array(F.struct(F.lit("overall").alias("segment"), F.lit("all").alias("value")), *[F.struct(F.lit(s).alias("segment"), F.col(s).cast("string").alias("value")) for s in segments]), lambda x: x["value"].isNotNull())
    spread = rows.select(F.col(won).alias("_won"), places.alias("_p"), F.explode(scenarios).alias("_s")).select("_won", "_s.*", F.explode("_p").alias("_p")).select("_won", "scenario", "odds", "_p.*")
    out = spread.groupBy("scenario", "segment", "value").agg(F.count(F.lit(1)).alias("n_bets"), F.count_if("_won").alias("n_wins"), F.coalesce(F.sum(F.when(F.col("_won"), F.col("odds"))), F.lit(0.0)).alias("total_returned"))
    return out.withColumns({"accuracy": F.col("n_wins") / F.col("n_bets"), "net_pnl": F.col("total_returned") - F.col("n_bets"), "roi": (F.col("total_returned") - F.col("n_bets")) / F.col("n_bets")})
