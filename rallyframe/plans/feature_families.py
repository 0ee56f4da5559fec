"""More families of the feature library: context, rating interactions, tiers,
editions and points within a tournament, workload, and styles of play."""

from __future__ import annotations

from functools import reduce
from math import comb
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import windows as W
from .registry import Feature, Registry

TIME, ORDER = "effective_match_date", ("tournament_start_date", "round_order", "match_uid")
BASE = (TIME, *ORDER, "player_id")
PLAYER, SURFACE, DRAW = ("player_id",), ("player_id", "surface"), ("player_id", "draw")
TOURNAMENT, WORKLOAD, HISTORY = ("player_id", "tournament_id", "year", "draw"), ("player_id", "tournament_id", "year"), ("player_id", "tournament_id", "draw")

# Tiers with their place and the winner's points.
TIERS = {"FU": (0, 30), "CH50": (1, 50), "CH75": (2, 75), "CH100": (3, 100), "CH125": (4, 125), "CH175": (5, 175), "250": (6, 250), "500": (7, 500), "1000": (8, 1000), "GS": (9, 2000)}
# Scale of the rating, slope of the normal distribution's logistic
# approximation, ridge of volatility, usual minutes a point, half sample of a style.
SCALE, SLOPE, RIDGE, MINUTES_PER_POINT, HALF_SAMPLE = 173.7178, 1.702, 0.1, 0.678, 10.0
STYLE_DAYS, RADAR_DAYS, FIELD_DAYS = 365, 1095, 730


def over(keys: tuple[str, ...]) -> W.Over:
    return W.Over(keys, TIME, ORDER)


def _total(x: Column, keys: tuple[str, ...], days) -> Column:
    return W.rolling_sum(x, over(keys), days, None) if days else F.sum(x).over(over(keys).before())


def _count(keys: tuple[str, ...], days) -> Column:
    return W.rolling_count(over(keys), days) if days else W.cumulative_count(over(keys))


def _mean(x: Column, keys: tuple[str, ...], days) -> Column:
    return W.rolling_mean(x, over(keys), days) if days else W.cumulative_mean(x, over(keys))


def _ratio(num: Column, den: Column, keys: tuple[str, ...], days) -> Column:
    """Ratio of totals over rows that know both sides; null without a positive denominator."""
    known = num.isNotNull() & den.isNotNull()
    n, d = (_total(F.when(known, c.cast("double")), keys, days) for c in (num, den))
    return F.when(d > 0, n / d)


def _extra(keys: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(k for k in keys if k != "player_id")


def _plain(reg: Registry, name: str, column: Column, *needs: str) -> None:
    reg.declare(name, lambda ctx: column, needs, {})


def _windowed(reg: Registry, name: str, make, needs: tuple[str, ...], days=None) -> None:
    reg.declare(name, lambda ctx, days=days: make(days), (*needs, *BASE), {"days": days})


def _sides(reg: Registry, *names: str) -> None:
    for n in names:
        reg.diff(n)
        reg.opponent(n)


def _context(reg: Registry) -> None:
    for name, by in (("venue_win_pct", "indoor"), ("circuit_win_pct", "circuit")):
        keys = ("player_id", by)
        _windowed(reg, name, lambda days, keys=keys: F.when(_count(keys, days) > 0, F.coalesce(_total(F.col("won").cast("double"), keys, days), F.lit(0.0)) / _count(keys, days)), ("won", by))
        _sides(reg, name)
    seeded = [F.col(f"{s}_seed").isNotNull() for s in ("player", "opp")]
    _plain(reg, "both_seeded", (seeded[0] & seeded[1]).cast("double"), "player_seed", "opp_seed")
    _plain(reg, "neither_seeded", (~seeded[0] & ~seeded[1]).cast("double"), "player_seed", "opp_seed")
    _plain(reg, "best_of", F.coalesce("best_of", F.lit(3)).cast("double"), "best_of")
    _plain(reg, "is_indoor", F.col("indoor").cast("double"), "indoor")
    _plain(reg, "round_ordinal", F.col("round_order").cast("double"), "round_order")
    _plain(reg, "tournament_round_ordinal", F.col("tournament_round_ordinal").cast("double"), "tournament_round_ordinal")
    _plain(reg, "is_draw_opener", (F.col("tournament_round_ordinal") == 1).cast("double"), "tournament_round_ordinal")
    quarter = F.floor((F.month(TIME) - 1) / 3).cast("double") / 4
    _plain(reg, "match_period_qtr", F.year(TIME) + quarter, TIME)
    _plain(reg, "match_season_qtr", quarter, TIME)
    _plain(reg, "ranking_points_diff", (F.col("player_rankings_points") - F.col("opp_rankings_points")).cast("double"), "player_rankings_points", "opp_rankings_points")
    _plain(reg, "ranking_rank_diff", (F.col("player_rank") - F.col("opp_rank")).cast("double"), "player_rank", "opp_rank")
    _plain(reg, "height_diff", (F.col("player_height_cm") - F.col("opp_height_cm")).cast("double"), "player_height_cm", "opp_height_cm")
    _plain(reg, "is_right_handed", F.col("player_right_handed").cast("double"), "player_right_handed")
    reg.pair("experience_diff", "years_pro", lambda a, b: a - b)


def _ratings(reg: Registry) -> None:
    # Differences of a rating of both sides, by name.
    differences = {
        "svc_elo_diff": "serve_elo", "ret_elo_diff": "return_elo", "svc_first_serve_power_diff": "first_serve_power", "svc_second_serve_reliability_diff": "second_serve_reliability", "ret_ace_resistance_diff": "ace_resistance",
        "svc_clutch_diff": "serve_clutch", "ret_clutch_diff": "return_clutch", "elo_tb_clutch_diff": "tb_clutch", "elo_clutch_diff": "overall_clutch", "elo_indoor_adj_diff": "indoor_adj", "glicko_diff": "glicko_mu",
    }
    crossed = {"svc_first_serve_power_matchup": ("first_serve_power", "ace_resistance"), "svc_clutch_matchup": ("serve_clutch", "return_clutch"), "ret_clutch_matchup": ("return_clutch", "serve_clutch")}
    for name, (a, b) in ({n: (c, c) for n, c in differences.items()} | crossed).items():
        _plain(reg, name, (F.col(f"player_{a}") - F.col(f"opp_{b}")).cast("double"), f"player_{a}", f"opp_{b}")
    reg.both("elo_surface_diff_abs", "elo_surface", lambda a, b: F.abs(a - b), days=False)
    reg.both("elo_surface_diff_sq", "elo_surface", lambda a, b: (a - b) * (a - b), days=False)
    adj = {s: F.col(f"player_{s}_adj") for s in ("hard", "clay", "grass")}
    raw = tuple(f"player_{s}_adj" for s in adj)
    for name, (a, b) in {"clay": ("clay", "hard"), "grass": ("grass", "hard"), "hard": ("hard", "clay")}.items():
        _plain(reg, f"elo_{name}_specialist", adj[a] - adj[b], *raw)
    mean = (adj["hard"] + adj["clay"] + adj["grass"]) / 3
    _plain(reg, "elo_surface_consistency", F.sqrt(reduce(add, [(x - mean) * (x - mean) for x in adj.values()]) / 3), *raw)
    _sides(reg, "elo_clay_specialist", "elo_grass_specialist", "elo_hard_specialist", "elo_surface_consistency")

    mu, rd, sigma = ([F.col(f"{s}_glicko_{c}") for s in ("player", "opp")] for c in ("mu", "rd", "sigma"))
    needs = tuple(f"{s}_glicko_{c}" for s in ("player", "opp") for c in ("mu", "rd", "sigma"))
    gap, rd_sum = mu[0] - mu[1], rd[0] + rd[1]
    rd_sq = rd[0] * rd[0] + rd[1] * rd[1]
    joint, total = F.sqrt(rd_sq), F.sqrt(rd_sq + sigma[0] * sigma[0] + sigma[1] * sigma[1])
    logistic = lambda z: 1 / (1 + F.exp(-z))
    own = {"glicko_mu_over_rd": mu[0] / rd[0], "glicko_mu_x_rd": mu[0] * rd[0], "glicko_log_rd": F.ln(rd[0]), "glicko_precision": 1 / rd[0]}
    for name, c in own.items():
        _plain(reg, name, c, *needs)
        _sides(reg, name)
    pairwise = {
        "glicko_rd_max": F.greatest(*rd), "glicko_rd_min": F.least(*rd), "glicko_rd_ratio": F.when(F.least(*rd) > 0, F.greatest(*rd) / F.least(*rd)).otherwise(1.0), "glicko_joint_rd": joint, "glicko_joint_total": total,
        "glicko_zscore_rd": gap / joint, "glicko_zscore_total": gap / total, "glicko_diff_over_rd_sum": gap / rd_sum, "glicko_truesk_pwin_rd": logistic(SLOPE * gap / joint), "glicko_truesk_pwin_total": logistic(SLOPE * gap / total),
        "glicko_mu_diff_x_player_rd": gap * rd[0], "glicko_mu_diff_x_opp_rd": gap * rd[1], "glicko_mu_diff_x_rd_asymmetry": gap * (rd[0] - rd[1]), "glicko_shrunk_diff_rd": gap / (1 + rd_sum), "glicko_shrunk_diff_rdsq": gap / (1 + rd_sq),
        "glicko_logistic_diff": logistic(gap / SCALE), "glicko_bhattacharyya_rd": F.sqrt(2 * rd[0] * rd[1] / rd_sq) * F.exp(-(gap * gap) / (4 * rd_sq)), "glicko_overlap_coefficient_rd": 2 * logistic(-SLOPE * F.abs(gap) / (2 * F.sqrt(rd_sq / 2))),
    }
    for name, c in pairwise.items():
        _plain(reg, name, c, *needs)
    on = lambda s: F.coalesce(*[F.when(F.lower("surface") == x, F.col(f"{s}_glicko_{x}_rd")) for x in adj], F.when(F.lower("surface").isin(*adj), F.lit(None)).otherwise(F.col(f"{s}_glicko_rd")))
    _plain(reg, "glicko_surface_rd_sum", on("player") + on("opp"), "surface", *[f"{s}_glicko_{x}rd" for s in ("player", "opp") for x in ("", "hard_", "clay_", "grass_")])
    volatile = {
        "glicko_shrunk_diff_formvol": lambda a, b: gap / (1 + a + b), "glicko_zscore_formvol": lambda a, b: gap / F.sqrt(a * a + b * b + RIDGE), "glicko_diff_over_formvol_sum": lambda a, b: gap / (a + b + RIDGE),
        "glicko_mu_diff_x_player_formvol": lambda a, b: gap * a, "glicko_mu_diff_x_opp_formvol": lambda a, b: gap * b, "glicko_mu_diff_x_formvol_asymmetry": lambda a, b: gap * (a - b),
    }
    for name, combine in volatile.items():
        reg.both(name, "form_volatility", combine, needs[:1] + needs[3:4])
    reg.both("glicko_rd_x_match_count", "match_count", lambda a, b: rd_sum * (a + b), ("player_glicko_rd", "opp_glicko_rd"))
    reg.both("glicko_rd_x_days_since_last_match", "days_since_last_match", lambda a, b: rd_sum * (a + b), ("player_glicko_rd", "opp_glicko_rd"), days=False)


def _tiers(reg: Registry) -> None:
    tier = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in TIERS.items() for x in (k, float(v[i]))]), F.col("tournament_level"))
    place, points, prize = tier(0), tier(1), F.log1p(F.col("prize_money").cast("double"))
    _plain(reg, "tournament_tier_ordinal", place, "tournament_level")
    # Over the whole past unknown tiers count as 0, in a window of days not at all.
    average = lambda x, days: W.rolling_mean(x, over(PLAYER), days) if days else F.when(W.cumulative_count(over(PLAYER)) > 0, F.coalesce(F.sum(F.coalesce(x, F.lit(0.0))).over(over(PLAYER).before()), F.lit(0.0)) / W.cumulative_count(over(PLAYER)))
    _windowed(reg, "high_tier_match_pct", lambda days: F.when(_count(PLAYER, days) > 0, F.coalesce(_total((place >= 7).cast("double"), PLAYER, days), F.lit(0.0)) / _count(PLAYER, days)), ("tournament_level",))
    _windowed(reg, "tier_ordinal_avg", lambda days: average(place, days), ("tournament_level",))
    _windowed(reg, "prize_money_log_avg", lambda days: average(prize, days), ("prize_money",))
    _windowed(reg, "level_gap", lambda days: place - average(place, days), ("tournament_level",))
    _windowed(reg, "level_gap_pts", lambda days: points - average(points, days), ("tournament_level",))
    _sides(reg, "high_tier_match_pct", "tier_ordinal_avg", "prize_money_log_avg", "level_gap", "level_gap_pts")
    joint = {"disp": lambda a, b: F.abs(a) + F.abs(b), "asym": lambda a, b: F.abs(a) - F.abs(b), "prod": lambda a, b: a * b, "minabs": lambda a, b: F.least(F.abs(a), F.abs(b))}
    for base in ("level_gap", "level_gap_pts"):
        for suffix, combine in joint.items():
            reg.both(f"{base}_{suffix}", base, combine)
    for form in ("elo_surface", "elo_surface_indoor"):
        def build(ctx, days=None, form=form):
            gap = f"level_gap(days={days})"
            return (ctx.column(form) - ctx.opponent(form)) * (F.abs(ctx.column(gap)) + F.abs(ctx.opponent(gap)))
        reg._add(Feature(f"{form}_diff_x_level_disp", build, (form, "level_gap(days={days})"), {"days": None}, True))


def _workload(reg: Registry) -> None:
    _windowed(reg, "match_count", lambda days: _count(PLAYER, days), ())
    _sides(reg, "match_count")
    reg.sum("match_count")
    reg.both("match_count_max", "match_count", F.greatest)
    minutes = F.col("minutes").cast("double")
    _windowed(reg, "singles_minutes_played", lambda days: _total(minutes, DRAW, days), ("minutes", "draw"))
    last = lambda x, keys: F.last(F.when(minutes.isNotNull(), x), ignorenulls=True).over(over(keys).before())
    for name, keys in (("last_match_minutes_per_rest_day", PLAYER), ("singles_last_match_minutes_per_rest_day", DRAW)):
        _plain(reg, name, last(minutes, keys) / (F.datediff(TIME, last(F.col(TIME), keys)) + 1.0), "minutes", *BASE, *_extra(keys))
        _sides(reg, name)
    singles = F.lower("draw").isin("s", "singles")
    carried = lambda x: W.last_known(x, singles, over(PLAYER))
    _plain(reg, "days_since_singles", F.datediff(TIME, carried(F.col(TIME))).cast("double"), "draw", *BASE)
    _plain(reg, "days_since_surface_singles", F.datediff(TIME, W.last_known(F.col(TIME), singles, over(SURFACE))).cast("double"), "draw", *BASE, "surface")
    _plain(reg, "surface_switch_singles", (F.col("surface") != carried(F.col("surface"))).cast("double"), "draw", "surface", *BASE)
    _windowed(reg, "tiebreaks_played", lambda days: _total(F.col("tiebreaks_played"), PLAYER, days), ("tiebreaks_played",))
    _sides(reg, "singles_minutes_played", "days_since_singles", "days_since_surface_singles", "surface_switch_singles")

    lasting = {"tourn_minutes_played": WORKLOAD, "tourn_singles_minutes_played": TOURNAMENT}
    for name, keys in lasting.items():
        form = name.removesuffix("minutes_played")
        given = ("minutes", *BASE, *_extra(keys))
        played = F.sum(minutes).over(over(keys).before())
        elapsed = F.datediff(TIME, F.min(TIME).over(over(WORKLOAD).whole())) + 1.0
        for suffix, c in {"minutes_played": played, "last_match_minutes": last(minutes, keys), "max_match_minutes": F.max(minutes).over(over(keys).before()), "minutes_per_elapsed_day": played / elapsed}.items():
            _plain(reg, f"{form}{suffix}", c, *given)
            _sides(reg, f"{form}{suffix}")
    _plain(reg, "tourn_minutes_excess", F.sum(minutes - MINUTES_PER_POINT * F.col("pts_total_pts_played")).over(over(TOURNAMENT).before()), "minutes", "pts_total_pts_played", *BASE, *_extra(TOURNAMENT))
    _sides(reg, "tourn_minutes_excess")


def _editions(reg: Registry) -> None:
    """Records over the editions of a tournament. An edition counts once it has ended."""
    won, lost = F.col("won").cast("double"), 1 - F.col("won").cast("double")
    sets, games = (F.col("sets_won"), F.col("sets_lost")), (F.col("games_won"), F.col("games_lost"))
    values = {"matches_won": won, "matches_lost": lost, "matches_margin": won - lost, "sets_won": sets[0], "sets_lost": sets[1], "sets_margin": sets[0] - sets[1], "games_won": games[0], "games_lost": games[1], "games_margin": games[0] - games[1]}
    needs = ("won", "sets_won", "sets_lost", "games_won", "games_lost", *BASE, "tournament_id", "draw")
    _plain(reg, "tourn_history_matches_lost", W.cumulative_sum(lost, over(HISTORY)), *needs)
    for name in ("matches_margin", "sets_margin", "games_margin"):
        _plain(reg, f"tourn_history_{name}_sum", W.cumulative_sum(values[name], over(HISTORY)), *needs)
    _plain(reg, "tourn_history_win_pct", W.cumulative_mean(won, over(HISTORY)), *needs)
    for name in ("sets_margin", "games_margin"):
        _plain(reg, f"tourn_history_{name}_avg_per_match", W.cumulative_mean(values[name], over(HISTORY)), *needs)

    # The edition's total and its last row are columns first, and then averaged.
    whole = over((*HISTORY, "year")).whole()
    last = F.row_number().over(whole.orderBy(F.desc(TIME), *[F.desc(o) for o in ORDER])) == 1
    _plain(reg, "_edition_ended", F.when(last, 1), *needs, "year")
    ended = F.col("_edition_ended")
    _plain(reg, "tourn_history_year_instances_completed", F.count(ended).over(over(HISTORY).before()), "_edition_ended", *needs)
    for name, x in values.items():
        _plain(reg, f"_edition_{name}", F.sum(x).over(whole), *needs, "year")
        _plain(reg, f"tourn_history_{name}_avg_per_year", F.avg(F.when(ended == 1, F.col(f"_edition_{name}"))).over(over(HISTORY).before()), "_edition_ended", f"_edition_{name}", *needs)


def _within(reg: Registry) -> None:
    """Games, sets and rates within a running tournament."""
    c = F.col
    service, returns = c("svc_games_played"), c("ret_games_played")
    broken, breaks = c("svc_bp_faced") - c("svc_bp_saved"), c("ret_bp_converted")
    holds, ret_lost = service - broken, returns - breaks
    tb_won, tb = c("tiebreaks_won"), c("tiebreaks_played")
    sets, one, minutes = c("sets_won") + c("sets_lost"), F.lit(1.0), c("minutes").cast("double")
    totals = {"holds": holds, "breaks": breaks, "games_won": holds + breaks + tb_won, "svc_games_lost": broken, "ret_games_lost": ret_lost, "games_lost": broken + ret_lost + tb - tb_won, "svc_games_played": service, "ret_games_played": returns, "games_played": service + returns + tb}
    deciding = c("deciding_set")
    # Rates by name, as numerator and denominator.
    rates = {
        "hold_pct": (holds, service), "break_pct": (breaks, returns), "sets_won_pct": (c("sets_won"), sets), "sets_won_per_match": (c("sets_won"), one), "sets_lost_per_match": (c("sets_lost"), one), "sets_played_per_match": (sets, one),
        "svc_first_serve_win_pct": (c("svc_first_serve_pts_won"), c("svc_first_serve_pts_played")), "svc_second_serve_win_pct": (c("svc_second_serve_pts_won"), c("svc_second_serve_pts_played")), "svc_ace_pct": (c("svc_aces"), c("svc_first_serve_att")),
        "svc_df_pct": (c("svc_double_faults"), c("svc_first_serve_att")), "svc_first_serve_in_pct": (c("svc_first_serve_in"), c("svc_first_serve_att")), "svc_bp_save_pct": (c("svc_bp_saved"), c("svc_bp_faced")),
        "ret_first_serve_win_pct": (c("ret_first_serve_pts_won"), c("ret_first_serve_pts_played")), "ret_second_serve_win_pct": (c("ret_second_serve_pts_won"), c("ret_second_serve_pts_played")), "ret_bp_convert_pct": (breaks, c("ret_bp_opportunities")),
        "tight_set_pct": (c("tight_sets"), sets), "blowout_set_pct": (c("blowout_sets"), sets), "straight_set_win_pct": (c("straight_set_win"), one), "tiebreak_win_pct": (tb_won, tb), "tiebreaks_per_match": (tb, one), "deciding_set_pct": (deciding, one), "deciding_set_win_pct": (deciding * c("won"), deciding),
        "minutes_per_point": (minutes, c("pts_total_pts_played")), "minutes_per_game": (minutes, totals["games_played"]), "minutes_per_set": (minutes, sets), "minutes_per_match": (minutes, one),
    }
    for name, x in totals.items():
        rates |= {f"{name}_per_set": (x, sets), f"{name}_per_match": (x, one)}
    for name, x in {"svc_aces": "svc_aces", "svc_df": "svc_double_faults", "svc_bp_faced": "svc_bp_faced", "ret_bp_opportunities": "ret_bp_opportunities"}.items():
        rates |= {f"{name}_per_match": (c(x), one), f"{name}_per_set": (c(x), sets)}
    needs = (*BASE, "tournament_id", "year", "draw", "won", "minutes", "svc_games_played", "ret_games_played", "svc_bp_faced", "svc_bp_saved", "ret_bp_converted", "ret_bp_opportunities", "tiebreaks_won", "tiebreaks_played", "sets_won", "sets_lost", "tight_sets", "blowout_sets", "straight_set_win", "deciding_set",
             "svc_first_serve_pts_won", "svc_first_serve_pts_played", "svc_second_serve_pts_won", "svc_second_serve_pts_played", "svc_aces", "svc_first_serve_att", "svc_double_faults", "svc_first_serve_in", "ret_first_serve_pts_won", "ret_first_serve_pts_played", "ret_second_serve_pts_won", "ret_second_serve_pts_played", "pts_total_pts_played")
    counted = {k: totals[k] for k in ("holds", "breaks", "svc_games_lost", "ret_games_lost", "svc_games_played", "ret_games_played")} | {"tiebreaks_won": tb_won, "sets_played": sets, "tight_sets": c("tight_sets"), "blowout_sets": c("blowout_sets"), "straight_set_wins": c("straight_set_win"), "tiebreaks_played": tb, "deciding_sets": deciding}
    made = {f"tourn_{n}": W.cumulative_sum(x, over(TOURNAMENT)) for n, x in counted.items()} | {f"tourn_{n}": W.masked_rate(a, b, over(TOURNAMENT)) for n, (a, b) in rates.items()}
    made |= {"tourn_svc_rating": W.cumulative_mean(c("svc_serve_rating"), over(TOURNAMENT)), "tourn_ret_rating": W.cumulative_mean(c("ret_return_rating"), over(TOURNAMENT)), "tourn_singles_played": W.cumulative_count(over(TOURNAMENT))}
    for name, x in made.items():
        _plain(reg, name, x, *needs, *({"tourn_svc_rating": ["svc_serve_rating"], "tourn_ret_rating": ["ret_return_rating"]}.get(name, [])))
        _sides(reg, name)
    # Crossings of a rate with the opponent's.
    crossed = {
        "svc_pts_won_pct": ("pts_service_won_pct", "pts_return_won_pct"), "ret_pts_won_pct": ("pts_return_won_pct", "pts_service_won_pct"), "hold_vs_break": ("hold_pct", "break_pct"), "break_vs_hold": ("break_pct", "hold_pct"),
        "svc_first_serve_win_pct": ("svc_first_serve_win_pct", "ret_first_serve_win_pct"), "ret_first_serve_win_pct": ("ret_first_serve_win_pct", "svc_first_serve_win_pct"), "svc_second_serve_win_pct": ("svc_second_serve_win_pct", "ret_second_serve_win_pct"),
        "ret_second_serve_win_pct": ("ret_second_serve_win_pct", "svc_second_serve_win_pct"), "svc_bp_pct": ("svc_bp_save_pct", "ret_bp_convert_pct"), "ret_bp_pct": ("ret_bp_convert_pct", "svc_bp_save_pct"),
    }
    for name, (own, other) in crossed.items():
        reg.matchup(f"tourn_{name}_matchup", f"tourn_{own}", f"tourn_{other}")


def _surfaces(reg: Registry) -> None:
    """Short names of surface forms, and those without a plain form."""
    for name, base in {"first_serve_win_pct": "svc_first_serve_win_pct", "second_serve_win_pct": "svc_second_serve_win_pct", "ace_pct": "svc_ace_pct", "df_pct": "svc_df_pct", "bp_save_pct": "svc_bp_save_pct", "first_serve_in_pct": "svc_first_serve_in_pct"}.items():
        full = f"surface_{base}"
        reg.declare(f"surface_{name}", lambda ctx, days=None, full=full: ctx.column(f"{full}(days={days})"), (f"{full}(days={{days}})",), {"days": None})
        _sides(reg, f"surface_{name}")
    lost = "surface_pts_service_won_pct(days={days})", "surface_pts_return_won_pct(days={days})"
    reg.declare("surface_dominance_ratio", lambda ctx, days=None: F.when(1 - ctx.column(lost[0].format(days=days)) > 0, ctx.column(lost[1].format(days=days)) / (1 - ctx.column(lost[0].format(days=days)))), lost, {"days": None})
    elo = F.when(F.col("won").isNotNull(), F.col("opp_elo"))
    _windowed(reg, "surface_quality_win_rate", lambda days: _ratio(F.col("won") * elo, elo, SURFACE, days), ("won", "opp_elo", "surface"))
    _sides(reg, "surface_dominance_ratio", "surface_quality_win_rate")


def _chain(reg: Registry) -> None:
    """A set between two chances to hold, of whole percents, whoever serves first."""
    def after(own: int, other: int, won: int, a: Column, b: Column) -> Column:
        """Chance that A has won so many games after ``own`` service games of A
        and ``other`` of B."""
        power = lambda x, n: F.pow(x, F.lit(n)) if n else F.lit(1.0)
        parts = [comb(own, i) * comb(other, won - i) * power(a, i) * power(1 - a, own - i) * power(1 - b, won - i) * power(b, other - won + i) for i in range(max(0, won - other), min(own, won) + 1)]
        return reduce(add, parts)

    def open_after(n: int, a: Column, b: Column) -> Column:
        """Chance that nobody has six games after ``n``, the mean over who serves first."""
        return reduce(add, [after(s, n - s, k, a, b) for s in (n // 2, n - n // 2) for k in range(n - 5, 6)]) / 2

    percent = lambda x: F.when(x.isNotNull(), F.greatest(F.least(F.bround(x, 2), F.lit(1.0)), F.lit(0.0)))

    def both_six(a: Column, b: Column) -> Column:
        return open_after(10, a, b) * (a * b + (1 - a) * (1 - b))

    def games(x: Column, y: Column) -> Column:
        a, b = percent(x), percent(y)
        return 6 + reduce(add, [open_after(n, a, b) for n in range(6, 11)]) + open_after(10, a, b) + both_six(a, b)

    reg.both("iid_expected_games_per_set", "iid_hold_prob", games)
    reg.both("iid_tiebreak_prob", "iid_hold_prob", lambda x, y: both_six(percent(x), percent(y)))


def _share(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den)


def _styles(reg: Registry) -> None:
    c = F.col
    shots = lambda x: reduce(add, [c(f"player_{x}_{k}") for k in ("winners", "forced_errors", "unforced_errors", "others")])
    side = lambda x: c(f"player_{x}_winners") + c(f"player_{x}_forced_errors") + c(f"player_{x}_unforced_errors")
    points, rallies = c("pts_total_pts_played"), c("rally_points_with_data")
    winners, errors = (c(f"player_fh_{k}") + c(f"player_bh_{k}") for k in ("winners", "unforced_errors"))
    ends = lambda x: c(f"player_{x}_won") + c(f"player_{x}_err")
    # What a match shows of a style, averaged over matches.
    shown = {
        "winner_rate": c("mb_player_winners") / c("total_points"), "ue_rate": c("mb_player_ues") / c("total_points"), "winner_ue_ratio": _share(c("mb_player_winners"), c("mb_player_ues")), "forced_error_rate": c("mb_opp_fes") / c("total_points"),
        "fh_winner_share": _share(c("player_fh_winners"), winners), "fh_ue_share": _share(c("player_fh_unforced_errors"), errors), "fh_winner_rate": _share(c("player_fh_winners"), side("fh")), "bh_winner_rate": _share(c("player_bh_winners"), side("bh")),
        "ground_stroke_winner_rate": _share(c("player_ground_stroke_winners"), shots("ground_stroke")), "ground_stroke_ue_rate": _share(c("player_ground_stroke_unforced_errors"), shots("ground_stroke")),
        "net_approach_frequency": _share(shots("volley") + shots("approach") + shots("overhead"), points), "drop_shot_frequency": _share(shots("drop_shot"), points), "drop_shot_effectiveness": _share(c("player_drop_shot_winners"), shots("drop_shot")),
        "passing_frequency": _share(shots("passing"), points), "lob_frequency": _share(shots("lob"), points), "short_rally_pct": _share(c("rally_short_count"), rallies), "long_rally_pct": _share(c("rally_long_count"), rallies),
        "short_rally_win_pct": _share(c("player_short_won"), ends("short")), "long_rally_win_pct": _share(c("player_long_won"), ends("long")),
    }
    raw = STYLE_COLUMNS
    for name, x in shown.items():
        _windowed(reg, f"style_{name}", lambda days, x=x: W.rolling_mean(x, over(PLAYER), days), raw, STYLE_DAYS)
        _windowed(reg, f"surface_style_{name}", lambda days, x=x: W.rolling_mean(x, over(SURFACE), days), (*raw, "surface"), STYLE_DAYS)
    speeds = {"avg_1st_serve_speed": ("avg_1st", W.rolling_mean), "max_1st_serve_speed": ("max_1st", W.rolling_max), "avg_2nd_serve_speed": ("avg_2nd", W.rolling_mean), "max_2nd_serve_speed": ("max_2nd", W.rolling_max), "1st_serve_speed_variance": ("std_1st", W.rolling_mean)}
    for name, (x, f) in speeds.items():
        _windowed(reg, f"style_{name}", lambda days, x=x, f=f: f(c(f"mb_player_{x}_serve_speed"), over(PLAYER), days), (f"mb_player_{x}_serve_speed",), STYLE_DAYS)
    won = {"easy_hold_pct": ("easy_holds", "service_games"), "difficult_hold_pct": ("difficult_holds", "service_games"), "crucial_pts_win_pct": ("crucial_points_won", "crucial_points_played"), "rally_won_avg_length": ("rally_won_shots", "rally_won_count"), "rally_lost_avg_length": ("rally_lost_shots", "rally_lost_count")}
    for name, pair in won.items():
        a, b = (f"mb_player_{x}" for x in pair)
        _windowed(reg, f"style_{name}", lambda days, a=a, b=b: _ratio(c(a), c(b), PLAYER, days), (a, b), STYLE_DAYS)
        if name == "easy_hold_pct":
            reg.declare("surface_easy_hold_pct", lambda ctx, days=STYLE_DAYS, k=36.0, a=a, b=b: W.shrunk_ratio(*[_total(F.when(c(a).isNotNull() & c(b).isNotNull(), c(x)), SURFACE, days) for x in (a, b)], k, ctx.pooled(a, b, ("surface",))), (a, b, *BASE, "surface"), {"days": STYLE_DAYS, "k": 36.0}, pool=(a, b, ("surface",)))
        if name.startswith("rally"):
            _windowed(reg, f"surface_style_{name}", lambda days, a=a, b=b: _ratio(c(a), c(b), SURFACE, days), (a, b, "surface"), STYLE_DAYS)

    # Signals of the radar's axes with the observations of the prior of their surface form.
    present = lambda x: F.when(c(x).isNotNull(), points)
    signals = {"ace_rate": (c("svc_aces"), c("pts_service_pts_played"), "svc_aces"), "net_rate": (c("player_sp_net_points_played"), present("player_sp_net_points_played"), "player_sp_net_points_played"), "sp_winner_rate": (c("player_sp_winners"), present("player_sp_winners"), "player_sp_winners"),
               "sp_ue_rate": (c("player_sp_unforced_errors"), present("player_sp_unforced_errors"), "player_sp_unforced_errors"), "rally_lean": (c("rally_long_count").cast("long") - c("rally_short_count").cast("long"), rallies, None)}
    axes = dict(zip(("serve", "net", "aggression", "error", "rally"), signals, strict=True))
    for name, (a, b, _) in signals.items():
        _windowed(reg, f"style_{name}", lambda days, a=a, b=b: _ratio(a, b, PLAYER, days), SIGNAL_COLUMNS, RADAR_DAYS)
        _windowed(reg, f"surface_style_{name}", lambda days, a=a, b=b: _ratio(a, b, SURFACE, days), (*SIGNAL_COLUMNS, "surface"), RADAR_DAYS)
    for axis, signal in axes.items():
        source = signals[signal][2]
        told = c(source).isNotNull() if source else F.coalesce(rallies > 0, F.lit(False))
        n = F.coalesce(W.rolling_sum(told.cast("double"), over(PLAYER), RADAR_DAYS), F.lit(0.0))
        weight = n / (n + HALF_SAMPLE)
        _plain(reg, f"style_conf_{axis}", weight, *SIGNAL_COLUMNS, *BASE)
        def field(ctx, df: DataFrame, signal=signal):
            found = W.others_field(df.select("player_id", TIME, ctx.column(f"style_{signal}").alias("_x")), "player_id", TIME, "_x", FIELD_DAYS)
            return found.select("player_id", "day", F.struct("mean", "std").alias("value")), {"player_id": F.col("player_id"), "day": F.to_date(TIME)}
        reg.joined(f"_field_{axis}", (f"style_{signal}", *BASE), field)
        reg.declare(f"style_z_{axis}", lambda ctx, axis=axis, signal=signal: (ctx.column(f"style_{signal}") - F.col(f"_field_{axis}.mean")) / F.col(f"_field_{axis}.std"), (f"_field_{axis}", f"style_{signal}"), {})
        reg.declare(f"style_axis_{axis}", lambda ctx, axis=axis, weight=weight: F.coalesce(weight * ctx.column(f"style_z_{axis}"), F.lit(0.0)), (f"style_z_{axis}", *SIGNAL_COLUMNS, *BASE), {})
    every = tuple(f"style_axis_{a}" for a in axes)
    for axis in axes:
        reg.declare(f"style_radar_{axis}", lambda ctx, axis=axis: ctx.column(f"style_axis_{axis}") - reduce(add, [ctx.column(a) for a in every]) / len(every), every, {})

    def label(name: str, base: str, q: float, test) -> None:
        def bar(ctx, df: DataFrame):
            found = W.rolling_population_quantile(df.select(TIME, ctx.column(base).alias("_x")), TIME, "_x", FIELD_DAYS, q)
            return found.select("day", F.col("quantile").alias("value")), {"day": F.to_date(TIME)}
        reg.joined(f"_bar_{name}", (base, *BASE), bar)
        reg.declare(name, lambda ctx: test(ctx.column(base), F.col(f"_bar_{name}")).cast("int"), (f"_bar_{name}", base), {})

    top, bottom, beyond = lambda v, b: v >= b, lambda v, b: v <= b, lambda v, b: v > b
    # Kinds of player by a quantile of the field, one row a date.
    for name, (base, q, test) in {"power_server": ("style_avg_1st_serve_speed", 2 / 3, top), "placement_server": ("style_avg_1st_serve_speed", 1 / 3, bottom), "counterpuncher": ("style_winner_rate", 1 / 3, bottom), "aggressive_baseliner": ("style_winner_rate", 2 / 3, top),
                                 "net_rusher": ("style_net_approach_frequency", 0.75, beyond), "clay_specialist": ("elo_clay_specialist", 0.75, beyond), "hard_specialist": ("elo_hard_specialist", 0.75, beyond)}.items():
        label(f"is_{name}", base, q, test)
    label("_saves", "svc_bp_save_pct", 0.5, beyond)
    label("_converts", "ret_bp_convert_pct", 0.5, beyond)
    reg.declare("is_clutch_player", lambda ctx: (ctx.column("_saves") * ctx.column("_converts")), ("_saves", "_converts"), {})
    label("_strong_return", "ret_first_serve_win_pct", 0.75, beyond)
    label("_strong_pass", "style_passing_frequency", 0.75, beyond)
    meets = {"matchup_power_serve_vs_strong_return": ("is_power_server", "_strong_return"), "matchup_placement_serve_vs_strong_return": ("is_placement_server", "_strong_return"), "matchup_aggressor_vs_counterpuncher": ("is_aggressive_baseliner", "is_counterpuncher"),
             "matchup_counterpuncher_vs_aggressor": ("is_counterpuncher", "is_aggressive_baseliner"), "matchup_both_power_servers": ("is_power_server",) * 2, "matchup_both_counterpunchers": ("is_counterpuncher",) * 2, "matchup_net_rusher_vs_passer": ("is_net_rusher", "_strong_pass")}
    for name, (own, other) in meets.items():
        reg._add(Feature(name, lambda ctx, own=own, other=other: ctx.column(own) * ctx.opponent(other), (own, other), {}, True))

    records = {"matches": lambda w: F.lit(1.0), "wins": lambda w: w, "losses": lambda w: 1 - w}
    for kind in ("power_server", "placement_server", "counterpuncher", "aggressive_baseliner", "net_rusher", "clutch_player"):
        # What the opponent was is a column first, and then summed.
        reg._add(Feature(f"_met_{kind}", lambda ctx, kind=kind: ctx.opponent(f"is_{kind}"), (f"is_{kind}",), {}, True))
        met, w = F.col(f"`_met_{kind}`"), F.col("won").cast("double")
        for name, x in records.items():
            reg.declare(f"{name}_vs_{kind}", lambda ctx, days=None, x=x, met=met, w=w: F.coalesce(_total(x(w) * met, PLAYER, days), F.lit(0.0)), (f"_met_{kind}", "won", *BASE), {"days": None})
        reg.declare(f"winpct_vs_{kind}", lambda ctx, days=None, met=met, w=w: F.try_divide(_total(w * met, PLAYER, days), _total(met, PLAYER, days)), (f"_met_{kind}", "won", *BASE), {"days": None})
    for s in ("hard", "clay"):
        reg._add(Feature(f"_met_{s}_specialist", lambda ctx, s=s: ctx.opponent(f"is_{s}_specialist") * (F.lower("surface") == s).cast("int"), (f"is_{s}_specialist", "surface"), {}, True))
    def aligned(x: Column, days) -> Column:
        """Earlier rows on this row's surface against its specialists; 0 elsewhere."""
        on = {s: F.coalesce(_total(x * F.col(f"`_met_{s}_specialist`"), PLAYER, days), F.lit(0.0)) for s in ("hard", "clay")}
        return F.when(F.lower("surface") == "hard", on["hard"]).when(F.lower("surface") == "clay", on["clay"]).otherwise(0.0)
    specialists = ("_met_hard_specialist", "_met_clay_specialist", "won", "surface", *BASE)
    w = F.col("won").cast("double")
    for name, x in records.items():
        reg.declare(f"{name}_vs_surface_specialists", lambda ctx, days=None, x=x: aligned(x(w), days), specialists, {"days": None})
    reg.declare("winpct_vs_surface_specialists", lambda ctx, days=None: F.when(aligned(F.lit(1.0), days) > 0, aligned(w, days) / aligned(F.lit(1.0), days)), specialists, {"days": None})
    # The opponent's kind on an axis as a column first: 1 top, 0 neither, -1 bottom; null if unknown.
    axes_of = {"serve_type": ("is_power_server", "is_placement_server"), "rally_type": ("is_aggressive_baseliner", "is_counterpuncher"), "net_type": ("is_net_rusher", None)}
    for axis, (high, low) in axes_of.items():
        def kind_of(ctx, high=high, low=low):
            up, down = ctx.opponent(high), ctx.opponent(low) if low else F.lit(0)
            return F.when(up == 1, 1).when(down == 1, -1).when((up == 0) & (down == 0), 0)
        reg._add(Feature(f"_kind_{axis}", kind_of, tuple(x for x in (high, low) if x), {}, True))
        for prefix, keys in (("", PLAYER), ("surface_", SURFACE)):
            needs = (f"_kind_{axis}", "won", *BASE, *_extra(keys))

            def same(x: Column, days, axis=axis, keys=keys) -> Column:
                """Total over earlier rows whose opponent was of this one's kind."""
                kind = F.col(f"`_kind_{axis}`")
                # An unknown row before counts 0 in each kind's total, but leaves it known.
                each = [F.when(kind == k, _total(x * F.coalesce((kind == k).cast("int"), F.lit(0)), keys, days)) for k in (1, -1, 0)]
                return F.coalesce(*each, F.when(kind.isNotNull(), F.lit(0.0)))

            for name, x in records.items():
                reg.declare(f"{prefix}{name}_vs_opp_{axis}", lambda ctx, days=None, x=x, same=same: same(x(w), days), needs, {"days": None})
            reg.declare(f"{prefix}winpct_vs_opp_{axis}", lambda ctx, days=None, same=same: F.when(same(F.lit(1.0), days) > 0, same(w, days) / same(F.lit(1.0), days)), needs, {"days": None})
    # How far results stray from the ratings along the opponent's axis: a slope, drawn to 0.
    for axis in axes:
        reg._add(Feature(f"_met_radar_{axis}", lambda ctx, axis=axis: ctx.opponent(f"style_radar_{axis}"), (f"style_radar_{axis}",), {}, True))

        def slope(ctx, days=None, axis=axis):
            z, stray = F.col(f"`_met_radar_{axis}`"), F.col("won").cast("double") - 1 / (1 + F.pow(F.lit(10.0), -ctx.column("elo_surface_diff") / 400))
            total = lambda x: W.rolling_sum(x, over(PLAYER), days, None) if days else W.cumulative_sum(x, over(PLAYER))
            return total(z * stray) / (total(z * z) + 1.0)

        reg.declare(f"style_resid_vs_{axis}", slope, (f"_met_radar_{axis}", "elo_surface_diff", "won", *BASE), {"days": None})
    # Rates against specialists of the surface.
    against = {"surface_first_serve_win_pct": ("svc_first_serve_pts_won", "svc_first_serve_pts_played"), "surface_second_serve_win_pct": ("svc_second_serve_pts_won", "svc_second_serve_pts_played"), "surface_ace_pct": ("svc_aces", "svc_first_serve_att"), "surface_df_pct": ("svc_double_faults", "svc_first_serve_att"),
               "surface_first_serve_in_pct": ("svc_first_serve_in", "svc_first_serve_att"), "surface_bp_save_pct": ("svc_bp_saved", "svc_bp_faced"), "surface_hold_pct": ("holds", "svc_games_played"), "surface_ret_first_serve_win_pct": ("ret_first_serve_pts_won", "ret_first_serve_pts_played"),
               "surface_ret_second_serve_win_pct": ("ret_second_serve_pts_won", "ret_second_serve_pts_played"), "surface_ret_bp_convert_pct": ("ret_bp_converted", "ret_bp_opportunities"), "surface_pts_service_won_pct": ("pts_service_pts_won", "pts_service_pts_played"), "surface_pts_return_won_pct": ("pts_return_pts_won", "pts_return_pts_played")}
    for name, (a, b) in against.items():
        reg.declare(f"{name}_vs_surf_spec", lambda ctx, days=None, a=a, b=b: _share(aligned(F.col(a), days), aligned(F.col(b), days)), (a, b, *specialists), {"days": None})
    reg.declare("quality_win_rate_vs_surf_spec", lambda ctx, days=None: _share(aligned(w * F.col("opp_elo"), days), aligned(F.when(w.isNotNull(), F.col("opp_elo")), days)), ("opp_elo", *specialists), {"days": None})


# Columns of shots and rallies.
STYLE_COLUMNS = ("mb_player_winners", "mb_player_ues", "mb_opp_fes", "total_points", "pts_total_pts_played", "rally_points_with_data", "rally_short_count", "rally_long_count", "player_short_won", "player_short_err", "player_long_won", "player_long_err",
                 *[f"player_{s}_{k}" for s in ("fh", "bh") for k in ("winners", "forced_errors", "unforced_errors")], *[f"player_{s}_{k}" for s in ("ground_stroke", "volley", "approach", "overhead", "drop_shot", "passing", "lob") for k in ("winners", "forced_errors", "unforced_errors", "others")])
SIGNAL_COLUMNS = ("svc_aces", "pts_service_pts_played", "pts_total_pts_played", "player_sp_net_points_played", "player_sp_winners", "player_sp_unforced_errors", "rally_long_count", "rally_short_count", "rally_points_with_data")
FAMILIES = (_context, _ratings, _workload, _tiers, _editions, _within, _surfaces, _chain, _styles)
