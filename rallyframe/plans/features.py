"""The feature library, declared by families over a table of two rows a match.

``library()`` returns a registry. Windows order by date, tournament start,
round and match; ``days`` asks for a rolling window instead of the whole past.
Shrunk ratios need the ratio over the whole table: the engine computes those
of all requested features in one aggregation beforehand (``pool``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import windows as W
from .feature_families import FAMILIES
from .registry import Registry

TIME, ORDER = "effective_match_date", ("tournament_start_date", "round_order", "match_uid")
BASE = (TIME, *ORDER, "player_id")
PLAYER, SURFACE = ("player_id",), ("player_id", "surface")
TOURNAMENT, HISTORY, RIVALRY = ("player_id", "tournament_id", "year", "draw"), ("player_id", "tournament_id", "draw"), ("player_id", "opp_id")

# Shrunk ratios as name: (numerator, denominator, observations of prior).
RATIOS = {
    "win_pct": ("won", "played", 13.0), "pts_total_won_pct": ("pts_total_pts_won", "pts_total_pts_played", 194.0), "pts_service_won_pct": ("pts_service_pts_won", "pts_service_pts_played", 82.0), "pts_return_won_pct": ("pts_return_pts_won", "pts_return_pts_played", 144.0),
    "ret_first_serve_win_pct": ("ret_first_serve_pts_won", "ret_first_serve_pts_played", 126.0), "ret_second_serve_win_pct": ("ret_second_serve_pts_won", "ret_second_serve_pts_played", 137.0), "ret_bp_convert_pct": ("ret_bp_converted", "ret_bp_opportunities", 180.0),
    "svc_first_serve_win_pct": ("svc_first_serve_pts_won", "svc_first_serve_pts_played", 56.0), "svc_second_serve_win_pct": ("svc_second_serve_pts_won", "svc_second_serve_pts_played", 114.0), "svc_ace_pct": ("svc_aces", "svc_first_serve_att", 77.0), "svc_df_pct": ("svc_double_faults", "svc_first_serve_att", 80.0),
    "svc_bp_save_pct": ("svc_bp_saved", "svc_bp_faced", 64.0), "svc_first_serve_in_pct": ("svc_first_serve_in", "svc_first_serve_att", 95.0), "hold_pct": ("holds", "svc_games_played", 12.0), "net_points_won_pct": ("sp_net_points_won", "sp_net_points_played", 0.0), "blowout_set_pct": ("blowout_sets", "sets_played", 0.0),
    "tight_set_pct": ("tight_sets", "sets_played", 0.0), "straight_sets_win_pct": ("straight_set_win", "won", 0.0), "tiebreak_win_pct": ("tiebreaks_won", "tiebreaks_played", 0.0), "tiebreak_pct": ("tiebreaks_played", "sets_played", 0.0), "deciding_set_pct": ("deciding_set", "played", 0.0), "deciding_set_win_pct": ("deciding_set_won", "deciding_set", 0.0),
    "retirement_rate": ("retired", "played", 0.0), "minutes_per_point": ("minutes", "pts_total_pts_played", 0.0), "minutes_per_game": ("minutes", "games_played", 0.0), "minutes_per_set": ("minutes", "sets_played", 0.0), "minutes_per_match": ("minutes", "played", 0.0),
}
# Prior observations of the surface forms where they differ.
SURFACE_PRIOR = {"net_points_won_pct": 81.0, "blowout_set_pct": 8.0}
NO_SURFACE_FORM = {"straight_sets_win_pct", "tight_set_pct", "tiebreak_win_pct", "tiebreak_pct", "deciding_set_pct", "deciding_set_win_pct", "retirement_rate", "minutes_per_point", "minutes_per_game", "minutes_per_set", "minutes_per_match"}
# Means of a column over the past, with a surface form.
MEANS = {
    "sets_per_match": "sets_played", "games_won_per_set": "games_won_per_set", "games_lost_per_set": "games_lost_per_set", "games_margin_per_set": "games_margin_per_set", "games_margin_per_set_won": "games_margin_per_set_won", "games_margin_per_set_lost": "games_margin_per_set_lost",
    "games_per_set": "games_per_set", "total_games_won": "games_won", "total_games_lost": "games_lost", "total_games": "games_played", "net_points_won": "sp_net_points_won", "net_points_lost": "sp_net_points_lost", "svc_rating": "svc_serve_rating", "ret_rating": "ret_return_rating", "avg_opp_ranking": "opp_rank", "opp_elo_faced_avg": "opp_elo",
}
SUMS = {"recent_games_load": "games_played", "tiebreaks_played_total": "tiebreaks_played", "minutes_played": "minutes"}
# Columns that are features as they are, for either side.
COLUMNS = ["elo", "serve_elo", "return_elo", "elo_rd", "serve_elo_rd", "return_elo_rd", "hard_adj", "clay_adj", "grass_adj", "indoor_adj", "first_serve_power", "second_serve_reliability", "ace_resistance", "serve_clutch", "return_clutch", "tb_clutch", "overall_clutch", "glicko_mu", "glicko_rd", "rank", "rankings_points", "height_cm"]
FLAGS = {
    "is_tour": ("circuit", ["tour"]), "is_chal": ("circuit", ["chal"]), "is_itf": ("circuit", ["itf"]), "is_hard": ("surface", ["hard"]), "is_clay": ("surface", ["clay"]), "is_grass": ("surface", ["grass"]), "is_qualifying": ("round", ["q1", "q2", "q3"]),
    "is_grand_slam": ("tournament_level", ["gs"]), "is_atp_1000": ("tournament_level", ["1000"]), "is_atp_500": ("tournament_level", ["500"]), "is_atp_250": ("tournament_level", ["250"]), "is_futures": ("tournament_level", ["fu"]), "is_challenger_175": ("tournament_level", ["ch175"]), "is_challenger_125": ("tournament_level", ["ch125"]),
    "is_challenger_100": ("tournament_level", ["ch100"]), "is_challenger_75": ("tournament_level", ["ch75"]), "is_challenger_50": ("tournament_level", ["ch50"]), "is_challenger_high": ("tournament_level", ["ch175", "ch125", "ch100"]), "is_challenger_low": ("tournament_level", ["ch75", "ch50"]), "is_challenger_any": ("tournament_level", ["ch175", "ch125", "ch100", "ch75", "ch50"]),
}
#: What is counted within a tournament and over a tournament's editions.
RECORDS = {"sets_won": "sets_won", "sets_lost": "sets_lost", "games_won": "games_won", "games_lost": "games_lost", "matches_won": "won"}
MARGINS = {"sets_margin": ("sets_won", "sets_lost"), "games_margin": ("games_won", "games_lost")}
POINTS = {"pts_service": ("pts_service_pts_won", "pts_service_pts_played", "svc_games_played"), "pts_return": ("pts_return_pts_won", "pts_return_pts_played", "ret_games_played"), "pts_total": ("pts_total_pts_won", "pts_total_pts_played", "games_played")}
PER = {"per_set": "sets_played", "per_match": "played"}


def over(keys: tuple[str, ...]) -> W.Over:
    return W.Over(keys, TIME, ORDER)


def _total(x: Column, keys: tuple[str, ...], days) -> Column:
    return W.rolling_sum(x, over(keys), days, None) if days else F.sum(x).over(over(keys).before())


def _mean(x: Column, keys: tuple[str, ...], days) -> Column:
    return W.rolling_mean(x, over(keys), days) if days else W.cumulative_mean(x, over(keys))


def _count(keys: tuple[str, ...], days) -> Column:
    return W.rolling_count(over(keys), days) if days else W.cumulative_count(over(keys))


def score_columns(df: DataFrame, sets: int = 5) -> DataFrame:
    """Set and game counts from columns player_s1.. and opp_s1.. (games of each
    set), player_tb1.. (tiebreak points, null without one) and minutes."""
    pairs = F.filter(F.array(*[F.struct(F.col(f"player_s{i}").alias("a"), F.col(f"opp_s{i}").alias("b")) for i in range(1, sets + 1)]), lambda s: s["a"].isNotNull() & s["b"].isNotNull())
    count = lambda test: F.size(F.filter("_sets", test))
    total = lambda f: F.aggregate(F.transform("_sets", f), F.lit(0).cast("long"), lambda x, y: x + y)
    df = df.withColumn("_sets", pairs)
    df = df.withColumns({
        "sets_played": F.nullif(F.size("_sets"), F.lit(0)), "sets_won": count(lambda s: s["a"] > s["b"]), "sets_lost": count(lambda s: s["a"] < s["b"]), "games_won": total(lambda s: s["a"].cast("long")), "games_lost": total(lambda s: s["b"].cast("long")),
        "tight_sets": count(lambda s: F.greatest(s["a"], s["b"]) >= 7), "blowout_sets": count(lambda s: F.abs(s["a"] - s["b"]) >= 4), "tiebreaks_played": count(lambda s: (s["a"] + s["b"]) == 13), "tiebreaks_won": count(lambda s: (s["a"] == 7) & (s["b"] == 6)),
        "_won_margin": total(lambda s: F.when(s["a"] > s["b"], s["a"] - s["b"]).otherwise(0).cast("long")), "_lost_margin": total(lambda s: F.when(s["a"] < s["b"], s["b"] - s["a"]).otherwise(0).cast("long")),
    })
    n = F.col("sets_played")
    return df.withColumns({
        "games_played": F.col("games_won") + F.col("games_lost"), "games_won_per_set": F.col("games_won") / n, "games_lost_per_set": F.col("games_lost") / n, "games_margin_per_set": (F.col("games_won") - F.col("games_lost")) / n, "games_per_set": (F.col("games_won") + F.col("games_lost")) / n,
        "games_margin_per_set_won": F.try_divide("_won_margin", "sets_won"), "games_margin_per_set_lost": F.try_divide("_lost_margin", "sets_lost"), "straight_set_win": ((F.col("won") == 1) & (F.col("sets_lost") == 0)).cast("int"),
        "deciding_set": (n == F.coalesce("best_of", F.lit(3))).cast("int"), "deciding_set_won": ((n == F.coalesce("best_of", F.lit(3))) & (F.col("won") == 1)).cast("int"), "played": F.when(F.col("won").isNotNull(), 1),
    }).drop("_sets", "_won_margin", "_lost_margin")


def _ratios(reg: Registry) -> None:
    def declare(name: str, num: str, den: str, prior: float, keys: tuple[str, ...], by: tuple[str, ...]) -> None:
        def build(ctx, days=None, k=prior):
            # Only rows that know both sides count.
            both = F.col(num).isNotNull() & F.col(den).isNotNull()
            n, d = (_total(F.when(both, F.col(c)), keys, days) for c in (num, den))
            return W.shrunk_ratio(n, d, k, ctx.pooled(num, den, by)) if k else W.shrunk_ratio(n, d)
        reg.declare(name, build, (num, den, *BASE, *by), {"days": None, "k": prior}, pool=(num, den, by) if prior else None)
        reg.diff(name)
        reg.sum(name)
        reg.opponent(name)

    for name, (num, den, k) in RATIOS.items():
        declare(name, num, den, k, PLAYER, ())
        if name not in NO_SURFACE_FORM:
            declare(f"surface_{name}", num, den, SURFACE_PRIOR.get(name, k), SURFACE, ("surface",))
    for form in ("", "surface_"):
        reg.matchup(f"{form}svc_first_serve_win_pct_matchup", f"{form}svc_first_serve_win_pct", f"{form}ret_first_serve_win_pct")
        reg.matchup(f"{form}svc_pts_won_pct_matchup", f"{form}pts_service_won_pct", f"{form}pts_return_won_pct")
    reg.matchup("svc_bp_pct_matchup", "svc_bp_save_pct", "ret_bp_convert_pct")

    @reg.feature("pts_service_won_pct(days={days})", "pts_return_won_pct(days={days})")
    def dominance_ratio(ctx, days=None):
        lost = 1 - ctx.column(f"pts_service_won_pct(days={days})")
        return F.when(lost > 0, ctx.column(f"pts_return_won_pct(days={days})") / lost)

    @reg.feature("pts_service_won_pct(days={days})")
    def iid_hold_prob(ctx, days=None):
        return S.hold_probability(ctx.column(f"pts_service_won_pct(days={days})"))

    for name in ("dominance_ratio", "iid_hold_prob"):
        reg.diff(name)
        reg.sum(name)


def _moments(reg: Registry) -> None:
    def declare(name: str, x: str, keys: tuple[str, ...], make) -> None:
        reg.declare(name, lambda ctx, days=None: make(F.col(x), keys, days), (x, *BASE, *[k for k in keys if k != "player_id"]), {"days": None})
        reg.diff(name)
        reg.sum(name)
        reg.opponent(name)

    for name, x in MEANS.items():
        declare(name, x, PLAYER, _mean)
        declare(f"surface_{name}", x, SURFACE, _mean)
    for name, x in SUMS.items():
        declare(name, x, PLAYER, _total)
    for name, keys in (("matches_played", PLAYER), ("surface_matches", SURFACE), ("h2h_matches", RIVALRY)):
        reg.declare(name, lambda ctx, days=None, keys=keys: _count(keys, days), (*BASE, *[k for k in keys if k != "player_id"]), {"days": None})
        reg.diff(name)
        reg.sum(name)
        reg.opponent(name)
    for name, keys in (("h2h", RIVALRY), ("h2h_surface", (*RIVALRY, "surface"))):
        needs = ("won", *BASE, "opp_id", *(["surface"] if len(keys) > 2 else []))
        reg.declare(f"{name}_wins", lambda ctx, days=None, keys=keys: _total(F.col("won"), keys, days), needs, {"days": None})
        reg.declare(f"{name}_win_pct", lambda ctx, days=None, keys=keys: F.try_divide(_total(F.col("won"), keys, days), _total(F.col("won").isNotNull().cast("int"), keys, days)), needs, {"days": None})
    surprise = F.col("won") - S.logistic_expectation(F.col("player_elo"), F.col("opp_elo"))
    for name, keys in (("form_volatility", PLAYER), ("surface_form_volatility", SURFACE)):
        reg.declare(name, lambda ctx, days=None, keys=keys: W.rolling_std(surprise, over(keys), days) if days else W.cumulative_std(surprise, over(keys)), ("won", "player_elo", "opp_elo", *BASE, "surface"), {"days": None})

    @reg.feature("minutes", "round_order", *BASE)
    def minutes_std(ctx, days=365):
        return W.same_day_std(F.col("minutes"), over(PLAYER), days, "round_order")

    @reg.feature("won", "opp_elo", *BASE)
    def quality_win_rate(ctx, days=None):
        elo = F.when(F.col("won").isNotNull(), F.col("opp_elo"))
        return F.try_divide(_total(F.col("won") * elo, PLAYER, days), _total(elo, PLAYER, days))

    @reg.feature("won", "opp_elo", *BASE)
    def opp_elo_beaten_avg(ctx, days=None):
        return _mean(F.when(F.col("won") == 1, F.col("opp_elo")), PLAYER, days)


def _static(reg: Registry) -> None:
    for c in COLUMNS:
        reg.declare(c, lambda ctx, c=c: F.col(f"player_{c}").cast("double"), (f"player_{c}",), {})
        reg.declare(f"{c}_diff", lambda ctx, c=c: F.col(f"player_{c}").cast("double") - F.col(f"opp_{c}"), (f"player_{c}", f"opp_{c}"), {})
        reg.declare(f"{c}_sum", lambda ctx, c=c: F.col(f"player_{c}").cast("double") + F.col(f"opp_{c}"), (f"player_{c}", f"opp_{c}"), {})
    for name, (column, values) in FLAGS.items():
        reg.declare(name, lambda ctx, column=column, values=values: F.lower(column).isin(*values).cast("double"), (column,), {})
    adj = lambda side: F.coalesce(F.when(F.lower("surface") == "hard", F.col(f"{side}_hard_adj")).when(F.lower("surface") == "clay", F.col(f"{side}_clay_adj")).when(F.lower("surface") == "grass", F.col(f"{side}_grass_adj")), F.lit(0.0))
    inside = lambda side: F.when(F.col("indoor"), F.coalesce(F.col(f"{side}_indoor_adj"), F.lit(0.0))).otherwise(0.0)
    sided = [f"{s}_{c}" for s in ("player", "opp") for c in ("elo", "hard_adj", "clay_adj", "grass_adj", "indoor_adj")]
    forms = {"elo_surface": lambda s: F.col(f"{s}_elo") + adj(s), "elo_indoor": lambda s: F.col(f"{s}_elo") + inside(s), "elo_surface_indoor": lambda s: F.col(f"{s}_elo") + adj(s) + inside(s), "surface_adj": adj}
    for name, make in forms.items():
        reg.declare(name, lambda ctx, make=make: make("player"), (*sided, "surface", "indoor"), {})
        reg.declare(f"{name}_diff", lambda ctx, make=make: make("player") - make("opp"), (*sided, "surface", "indoor"), {})
    crossed = {"svc_elo_matchup": ("serve_elo", "return_elo", -1), "ret_elo_matchup": ("return_elo", "serve_elo", -1), "svc_elo_matchup_rd": ("serve_elo_rd", "return_elo_rd", 1), "ret_elo_matchup_rd": ("return_elo_rd", "serve_elo_rd", 1)}
    for name, (a, b, sign) in crossed.items():
        reg.declare(name, lambda ctx, a=a, b=b, sign=sign: F.col(f"player_{a}") + sign * F.col(f"opp_{b}"), (f"player_{a}", f"opp_{b}"), {})
    elo = (F.col("player_elo"), F.col("opp_elo"))
    both = ("player_elo", "opp_elo", "player_elo_rd", "opp_elo_rd")
    joint = {
        "elo_avg": (elo[0] + elo[1]) / 2, "elo_avg_sq": ((elo[0] + elo[1]) / 2) * ((elo[0] + elo[1]) / 2), "elo_min": F.least(*elo), "elo_diff_x_elo_avg": (elo[0] - elo[1]) * (elo[0] + elo[1]) / 2, "elo_diff_x_rd_sum": (elo[0] - elo[1]) * (F.col("player_elo_rd") + F.col("opp_elo_rd")), "elo_win_prob": S.logistic_expectation(*elo),
    }
    for name, c in joint.items():
        reg.declare(name, lambda ctx, c=c: c, both, {})
    mu, rd = F.col("player_glicko_mu") - F.col("opp_glicko_mu"), F.col("player_glicko_rd") + F.col("opp_glicko_rd")
    for name, c in {"glicko_diff_abs": F.abs(mu), "glicko_diff_sq": mu * mu, "glicko_diff_x_rd_sum": mu * rd}.items():
        reg.declare(name, lambda ctx, c=c: c, ("player_glicko_mu", "opp_glicko_mu", "player_glicko_rd", "opp_glicko_rd"), {})

    @reg.feature("player_rank", "opp_rank")
    def ranking_ratio(ctx):
        a, b = F.col("player_rank"), F.col("opp_rank")
        return F.when((a > 0) & (b > 0), a / b)

    @reg.feature("ranking_ratio")
    def ranking_ratio_capped(ctx, cap=10.0):
        return F.least(F.greatest(ctx.column("ranking_ratio"), F.lit(1 / cap)), F.lit(cap))

    @reg.feature("player_birth_date", TIME)
    def age(ctx):
        years = F.datediff(TIME, "player_birth_date") / 365.25
        return F.when(years.between(14, 55), years)

    @reg.feature("player_pro_year", TIME)
    def years_pro(ctx):
        return (F.year(TIME) - F.col("player_pro_year")).cast("double")

    @reg.feature("player_right_handed", "opp_right_handed")
    def handedness_match(ctx):
        return (F.col("player_right_handed") == F.col("opp_right_handed")).cast("double")

    @reg.feature("player_right_handed", "opp_right_handed")
    def lefty_vs_righty(ctx):
        a, b = F.col("player_right_handed"), F.col("opp_right_handed")
        return F.when(~a & b, 1.0).when(a & ~b, -1.0).otherwise(0.0)

    @reg.feature("player_seed")
    def is_seeded(ctx):
        return F.col("player_seed").isNotNull().cast("double")

    @reg.feature("player_seed", "opp_seed")
    def seed_diff(ctx):
        return (F.col("player_seed") - F.col("opp_seed")).cast("double")

    @reg.feature("prize_money")
    def prize_money_log(ctx):
        return F.log1p(F.col("prize_money").cast("double"))

    @reg.feature(TIME)
    def match_period(ctx):
        return F.year(TIME) + (F.month(TIME) - 1) / 12

    @reg.feature(TIME)
    def match_season(ctx):
        return (F.month(TIME) - 1) / 12

    @reg.feature("best_of")
    def best_of_sets(ctx):
        return F.coalesce("best_of", F.lit(3)).cast("double")

    for name in ("age", "years_pro", "is_seeded"):
        reg.diff(name)


def _sequence(reg: Registry) -> None:
    @reg.feature(*BASE)
    def days_since_last_match(ctx):
        return W.days_since_last(over(PLAYER)).cast("double")

    @reg.feature(*BASE, "surface")
    def days_since_surface(ctx):
        return W.days_since_last(over(SURFACE)).cast("double")

    @reg.feature(*BASE, "surface")
    def surface_switch(ctx):
        return (F.col("surface") != F.lag("surface").over(over(PLAYER).ordered())).cast("double")

    @reg.feature(*BASE, "retired")
    def last_match_retirement(ctx):
        return F.lag("retired").over(over(PLAYER).ordered()).cast("double")

    @reg.feature(*BASE, "tournament_id")
    def prev_tourn_round_reached(ctx):
        w = over(PLAYER).ordered()
        moved = F.col("tournament_id") != F.lag("tournament_id").over(w)
        return F.when(moved, F.lag("round_order").over(w).cast("double"))

    @reg.feature("matches_played(days={days})", "surface_matches(days={days})")
    def pct_matches_on_surface(ctx, days=None):
        return F.try_divide(ctx.column(f"surface_matches(days={days})"), ctx.column(f"matches_played(days={days})"))

    for flag in ("is_tour", "is_chal", "is_itf", "is_grand_slam"):
        name = f"{flag.removeprefix('is_')}_match_pct"
        reg.declare(name, lambda ctx, days=None, flag=flag: _mean(ctx.column(flag), PLAYER, days), (flag, *BASE), {"days": None})
        reg.diff(name)
    for name in ("days_since_last_match", "days_since_surface", "last_match_retirement"):
        reg.diff(name)
        reg.opponent(name)


def _tournaments(reg: Registry) -> None:
    for prefix, keys in (("tourn_", TOURNAMENT), ("tourn_history_", HISTORY)):
        needs = (*BASE, *[k for k in keys if k != "player_id"])
        reg.declare(f"{prefix}matches_played", lambda ctx, keys=keys: W.cumulative_count(over(keys)), needs, {})
        for name, x in RECORDS.items():
            reg.declare(f"{prefix}{name}", lambda ctx, keys=keys, x=x: W.cumulative_sum(F.col(x), over(keys)), (x, *needs), {})
            reg.diff(f"{prefix}{name}")
            if prefix == "tourn_history_":
                reg.declare(f"{prefix}{name}_avg_per_match", lambda ctx, keys=keys, x=x: W.cumulative_mean(F.col(x), over(keys)), (x, *needs), {})
        for name, (a, b) in MARGINS.items():
            reg.declare(f"{prefix}{name}", lambda ctx, keys=keys, a=a, b=b: W.cumulative_sum(F.col(a) - F.col(b), over(keys)), (a, b, *needs), {})
            reg.diff(f"{prefix}{name}")
    needs = (*BASE, "tournament_id", "year", "draw")
    for name, (won, played, games) in POINTS.items():
        lost = F.col(played) - F.col(won)
        for kind, x in {"won": F.col(won), "lost": lost, "played": F.col(played)}.items():
            reg.declare(f"tourn_{name}_{kind}", lambda ctx, x=x: W.cumulative_sum(x, over(TOURNAMENT)), (won, played, *needs), {})
            for per, by in {"per_game": games, **PER}.items():
                reg.declare(f"tourn_{name}_{kind}_{per}", lambda ctx, x=x, by=by: W.masked_rate(x, F.col(by), over(TOURNAMENT)), (won, played, by, *needs), {})
        reg.declare(f"tourn_{name}_won_pct", lambda ctx, won=won, played=played: W.masked_rate(F.col(won), F.col(played), over(TOURNAMENT)), (won, played, *needs), {})
        reg.diff(f"tourn_{name}_won_pct")


def library() -> Registry:
    """All declared features; needs an active session."""
    reg = Registry()
    for family in (_ratios, _moments, _static, _sequence, _tournaments, *FAMILIES):
        family(reg)
    return reg
