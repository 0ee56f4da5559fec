"""The price ledger: model chances against every rung on offer, settled.

Rungs are priced by the model's distribution of the total, settled against the
outcome and unpivoted to one row a side; all selection is left to the reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prices import REFERENCE_BOOKS, anchor, board_at, quotes

# The version of the ledger's columns and its usual anchors.
SCHEMA_VERSION = 1
ANCHORS = ("open", "formed2", "close")


def price(board: DataFrame, pmf: DataFrame, match: str = "match_uid", chances: str = "pmf") -> DataFrame:
    """``board`` with the model's chances and edges on both sides.

    ``pmf`` has one row a match; element i of ``chances`` is P(total = i).
    model_p_over is P(total > points) and p_push P(total = points), 0 for half
    lines. edge_* is against the price taken (p - 1 / odds), edge_novig_* against
    the book's own chance p_over. A rung of a match without a distribution, or
    whose line lies outside its range, is left out. The chances are read from
    the match's array: no row is made of it.
    """
    p = F.col("_pmf")
    place = F.floor("points").cast("int")
    priced = board.join(pmf.select(match, F.col(chances).alias("_pmf")), match).where((place >= 0) & (place < F.size(p)))
    below = F.aggregate(F.slice(p, 1, place + 1), F.lit(0.0), lambda a, x: a + x)
    push = F.when(F.col("points") == place, F.get(p, place)).otherwise(F.lit(0.0))
    priced = priced.withColumns({"_below": below, "p_push": F.coalesce(push, F.lit(0.0))}).drop("_pmf")
    priced = priced.withColumns({"model_p_over": 1 - F.col("_below"), "model_p_under": F.col("_below") - F.col("p_push")}).drop("_below")
    return priced.withColumns({
        "edge_over": F.col("model_p_over") - 1 / F.col("over_odds"), "edge_under": F.col("model_p_under") - 1 / F.col("under_odds"),
        "edge_novig_over": F.col("model_p_over") - F.col("p_over"), "edge_novig_under": F.col("model_p_under") - (1 - F.col("p_over"))})


def settle(priced: DataFrame, outcomes: DataFrame, match: str = "match_uid") -> DataFrame:
    """``priced`` with is_push, over_won and each side's profit on one unit. A push
    returns the stake; matches without a known ``actual_total`` are left out."""
    out = priced.join(outcomes.where("actual_total IS NOT NULL").select(match, "actual_total"), match)
    push, over = F.col("actual_total") == F.col("points"), F.col("actual_total") > F.col("points")
    pnl = lambda won, odds: F.when(push, 0.0).when(won, F.col(odds) - 1).otherwise(-1.0)
    return out.withColumns({"is_push": push, "over_won": F.when(~push, over), "pnl_over": pnl(over, "over_odds"), "pnl_under": pnl(~over, "under_odds")})


def bets(settled: DataFrame, min_edge: float = 0.0) -> DataFrame:
    """The side of each rung that the model likes, from ``min_edge`` on: side, odds,
    model_p, edge, edge_novig and pnl. Reference books are left out, as are sides
    that are not quoted or no longer live; with one side left, it is taken."""
    can = {s: F.col(f"edge_{s}").isNotNull() & F.col(f"live_{s}") for s in ("over", "under")}
    over = F.when(can["over"] & can["under"], F.col("edge_over") >= F.col("edge_under")).otherwise(can["over"])
    taken = lambda name: F.when(over, F.col(name.format("over"))).otherwise(F.col(name.format("under")))
    out = settled.where(~F.col("book").isin(*REFERENCE_BOOKS) & (can["over"] | can["under"])).withColumns({
        "side": F.when(over, "over").otherwise("under"), "edge": F.greatest("edge_over", "edge_under"), "odds": taken("{}_odds"),
        "model_p": taken("model_p_{}"), "edge_novig": taken("edge_novig_{}"), "pnl": taken("pnl_{}")})
    return out.where(F.col("odds").isNotNull() & (F.col("edge") >= min_edge))


def by_side(settled: DataFrame) -> DataFrame:
    """One row a side of every rung, whatever its edge; won is null on a push."""
    pair = [c for c in settled.columns if c not in PAIRED]

    def row(s: str, won: Column) -> Column:
        return F.struct(F.lit(s).alias("side"), F.col(f"{s}_odds").alias("odds"), F.col(f"model_p_{s}").alias("model_p"), F.col(f"edge_{s}").alias("edge"), F.col(f"edge_novig_{s}").alias("edge_novig"),
                        F.col(f"pnl_{s}").alias("pnl"), won.alias("won"), F.col(f"live_{s}").alias("live_side"))

    both = F.array(row("over", F.col("over_won")), row("under", ~F.col("over_won")))
    return settled.select(*pair, F.explode(both).alias("_s")).select(*pair, "_s.*")


PAIRED = frozenset([f"{a}_{s}" for a in ("model_p", "edge", "edge_novig", "pnl", "live") for s in ("over", "under")] + ["over_odds", "under_odds", "over_won"])


def mean_covers(ledger: DataFrame, pmf: DataFrame, match: str = "match_uid", chances: str = "pmf") -> DataFrame:
    """``ledger`` with the model's expected total and whether it lies on the side's
    own side of the line; null without a distribution."""
    mean = F.aggregate(F.transform(F.col(chances), lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    out = ledger.join(pmf.select(match, mean.alias("expected_total")), match, "left")
    return out.withColumn("mean_covers", F.when(F.col("side") == "over", F.col("expected_total") > F.col("points")).otherwise(F.col("expected_total") < F.col("points")))


def line_offset(board: DataFrame, match: str = "match_uid") -> DataFrame:
    """``board`` with the distance of each rung from its own book's main line."""
    main = F.max(F.when(F.col("is_main_line"), F.col("points"))).over(Window.partitionBy(match, "book"))
    return board.withColumn("line_offset", F.col("points") - main)


def closing_value(ledger: DataFrame, reference: DataFrame, match: str = "match_uid") -> DataFrame:
    """``ledger`` with p_ref_close, the reference books' margin-free chance of the
    side on the same rung at the close, and clv, that less 1 / odds; null where
    no reference book has the rung. Of several, the first by name counts."""
    fair = reference.where("p_over IS NOT NULL").groupBy(match, "points").agg(F.min_by("p_over", "book").alias("_p"))
    out = ledger.join(fair, [match, "points"], "left")
    return out.withColumn("p_ref_close", F.when(F.col("side") == "over", F.col("_p")).otherwise(1 - F.col("_p"))).drop("_p").withColumn("clv", F.col("p_ref_close") - 1 / F.col("odds"))


def build_ledger(ticks: DataFrame, starts: DataFrame, pmf: DataFrame, market: str = "total_games", anchors: tuple[str, ...] = ANCHORS, match: str = "match_uid") -> DataFrame:
    """Every rung that takeable books offered at every anchor, one row a side.

    ``pmf`` (match, pmf, actual_total) has the model's distribution and the
    outcome. Selection by edge, main line or side is the reader's. Value against
    the close is measured at the close whatever the row's anchor.
    """
    known = ticks.join(pmf.select(match).distinct(), match, "left_semi")
    takeable = known.where(~F.col("book").isin(*REFERENCE_BOOKS))
    parts = []
    for name in anchors:
        board = line_offset(board_at(takeable, anchor(name, known, starts, match), match=match), match)
        rows = by_side(settle(price(board, pmf, match), pmf, match))
        parts.append(mean_covers(rows, pmf, match).withColumn("anchor", F.lit(name)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    reference = board_at(quotes(known, list(REFERENCE_BOOKS), match=match), anchor("close", known, starts, match), match=match)
    out = out.withColumns({"market": F.lit(market), "role": F.when(F.col("book").isin(*REFERENCE_BOOKS), "reference").otherwise("entry"), "schema_version": F.lit(SCHEMA_VERSION)})
    return closing_value(out, reference, match)
