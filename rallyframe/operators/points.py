"""Points within games: scores before each point, and columns of the score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Points won at a score as it is called; in a tiebreak it is a count.
CALLED = {"0": 0, "15": 1, "30": 2, "40": 3, "D": 3, "AD": 4}


def before_points(df: DataFrame, match: list[str], set_: str = "set_num", game: str = "game_num", point: str = "point_num") -> DataFrame:
    """``df`` (one row a point, scores as of after it) with the server's view of
    the score before it: server_id, returner_id, game_score_server and _returner
    ("0" at a game's first point), set_score_server_games and _returner_games
    (games of the set won before this one), sets_won_server and _returner.

    Games and sets are told on each of their points: the first point of a game
    counts it, and one of a set. All windows split by match: one shuffle.
    """
    in_game = Window.partitionBy(*match, set_, game).orderBy(point)
    in_set = Window.partitionBy(*match, set_).orderBy(game, point)
    in_match = Window.partitionBy(*match).orderBy(set_, game, point)
    serving = F.col("server") == "1"
    first_of_game = F.row_number().over(in_game) == 1
    marked = df.withColumns({"_p1": F.coalesce(F.lag("p1_game_score").over(in_game), F.lit("0")), "_p2": F.coalesce(F.lag("p2_game_score").over(in_game), F.lit("0")), "_game": first_of_game, "_set": F.row_number().over(in_set) == 1})

    def won_before(winner: str, who: str, once: str, window) -> Column:
        """Units won by ``who`` up to this one, less this one itself."""
        mine = F.coalesce(F.col(winner) == who, F.lit(False)).cast("int")
        return F.coalesce(F.sum(F.when(F.col(once), mine)).over(window.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)) - mine

    games = {w: won_before("game_winner", w, "_game", in_set) for w in ("1", "2")}
    sets = {w: won_before("set_winner", w, "_set", in_match) for w in ("1", "2")}
    side = lambda a, b: F.when(serving, a).otherwise(b)
    return marked.withColumns({
        "server_id": side(F.col("p1_id"), F.col("p2_id")), "returner_id": side(F.col("p2_id"), F.col("p1_id")), "game_score_server": side(F.col("_p1"), F.col("_p2")), "game_score_returner": side(F.col("_p2"), F.col("_p1")),
        "set_score_server_games": side(games["1"], games["2"]).cast("int"), "set_score_returner_games": side(games["2"], games["1"]).cast("int"), "sets_won_server": side(sets["1"], sets["2"]).cast("int"), "sets_won_returner": side(sets["2"], sets["1"]).cast("int"),
    }).drop("_p1", "_p2", "_game", "_set")


def _at_game_point(own: str, other: str) -> Column:
    return (F.col(own) == "AD") | (F.col(own) == "40") & F.col(other).isin("0", "15", "30")


def _won(score: str) -> Column:
    """Points won in the game; null for a score that can't be read."""
    called = F.element_at(F.create_map(*[F.lit(x) for kv in CALLED.items() for x in kv]), F.col(score))
    return F.when(F.coalesce("is_tiebreak", F.lit(False)), F.col(score).try_cast("int")).otherwise(called)


def point_columns() -> dict[str, Column]:
    """The derived columns of a point, over those of ``before_points`` and
    is_set_point, is_match_point, is_tiebreak, serve and surface."""
    tiebreak = F.coalesce("is_tiebreak", F.lit(False))
    server, returner = _won("game_score_server"), _won("game_score_returner")
    inside = lambda c: F.coalesce(F.when(tiebreak, c).otherwise(0), F.lit(0))
    mine, theirs = _at_game_point("game_score_server", "game_score_returner"), _at_game_point("game_score_returner", "game_score_server")
    return {
        "is_server_set_point": F.col("is_set_point") & mine, "is_returner_set_point": F.col("is_set_point") & theirs, "is_server_match_point": F.col("is_match_point") & mine, "is_returner_match_point": F.col("is_match_point") & theirs,
        "set_score_asymmetry": F.col("set_score_server_games") - F.col("set_score_returner_games"), "sets_won_asymmetry": F.col("sets_won_server") - F.col("sets_won_returner"), "is_second_serve": F.col("serve") == 2,
        "game_points_server": server, "game_points_returner": returner, "game_points_diff": server - returner, "tiebreak_point_diff": inside(server - returner), "tiebreak_points_played": inside(server + returner),
        "is_surface_hard": F.col("surface") == "hard", "is_surface_clay": F.col("surface") == "clay", "is_surface_grass": F.col("surface") == "grass",
    }
