"""The feature library on a small random table of matches."""

import datetime
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from rallyframe.plans import feature_families as families
from rallyframe.plans import features
from rallyframe.plans.planner import FeatureEngine

NUMBERS = sorted({c for n, d, _ in features.RATIOS.values() for c in (n, d)} | set(features.MEANS.values()) | set(features.SUMS.values()) | {c for x in features.POINTS.values() for c in x} | {"games_played"})
SCORES = {"sets_played", "sets_won", "sets_lost", "games_won", "games_lost", "tight_sets", "blowout_sets", "tiebreaks_played", "tiebreaks_won", "games_played", "games_won_per_set", "games_lost_per_set", "games_margin_per_set", "games_per_set", "games_margin_per_set_won", "games_margin_per_set_lost", "straight_set_win", "deciding_set", "deciding_set_won", "played"}


@pytest.fixture(scope="module")
def matches(spark):
    rng, rows = random.Random(4), []
    for m in range(120):
        date = datetime.date(2023, 1, 2) + datetime.timedelta(days=rng.randrange(500))
        players = rng.sample("abcdefg", 2)
        sets = [rng.choice([(6, 4), (4, 6), (7, 6), (6, 1), (2, 6)]) for _ in range(rng.choice([2, 3]))]
        won = rng.random() < 0.5
        common = {"match_uid": f"m{m:03d}", "effective_match_date": date, "tournament_start_date": date, "round_order": rng.randrange(4, 12), "tournament_id": rng.choice("xyz"), "year": date.year, "draw": "s", "surface": rng.choice(["Hard", "Clay"]), "circuit": rng.choice(["tour", "chal"]), "round": "QF", "tournament_level": "250", "indoor": rng.random() < 0.3, "best_of": 3, "prize_money": 1000.0}
        for side in (0, 1):
            r = common | {"player_id": players[side], "opp_id": players[1 - side], "won": int(won == (side == 0))}
            for i in range(5):
                r |= {f"player_s{i + 1}": sets[i][side] if i < len(sets) else None, f"opp_s{i + 1}": sets[i][1 - side] if i < len(sets) else None}
            for c in NUMBERS:
                if c not in SCORES and c != "won" and c not in ("opp_elo", "opp_rank"):
                    r[c] = rng.choice([None, 1.0, 5.0, 20.0])
            rows.append(r | {"player_seed": None, "opp_seed": 3, "player_birth_date": datetime.date(1999, 5, 1), "player_pro_year": 2015, "player_right_handed": True, "opp_right_handed": side == 0})
    names = list(rows[0])
    kinds = {"match_uid": "string", "tournament_id": "string", "draw": "string", "surface": "string", "circuit": "string", "round": "string", "tournament_level": "string", "player_id": "string", "opp_id": "string", "indoor": "boolean", "player_right_handed": "boolean", "opp_right_handed": "boolean", "effective_match_date": "date", "tournament_start_date": "date", "player_birth_date": "date"}
    number = lambda c: "long" if isinstance(rows[0][c], int) or c[-2:] in [f"s{i}" for i in range(1, 6)] or c == "player_seed" else "double"
    df = spark.createDataFrame([tuple(r[c] for c in names) for r in rows], ", ".join(f"{c} {kinds.get(c) or number(c)}" for c in names))
    for c in features.COLUMNS:
        df = df.withColumn(f"player_{c}", (F.crc32(F.concat("player_id", F.lit(c)).cast("binary")) % 500).cast("double")).withColumn(f"opp_{c}", (F.crc32(F.concat("opp_id", F.lit(c)).cast("binary")) % 500).cast("double"))
    df = features.score_columns(df)
    reg = features.library()
    needs = sorted({n.split("(")[0] for f in reg.features.values() for n in f.needs} - set(reg.features) - set(df.columns) | {"tournament_round_ordinal"})
    value = lambda c: F.crc32(F.concat("match_uid", "player_id", F.lit(c)).cast("binary"))
    return df.select("*", *[F.when(value(c) % 5 > 0, value(c) % 40).cast("double").alias(c) for c in needs])


@pytest.fixture(scope="module")
def raw(matches):
    return [r.asDict() for r in matches.collect()]


def compute(matches, specs):
    return {(r.match_uid, r.player_id): r for r in FeatureEngine(features.library()).compute(matches, specs).collect()}


def test_library_has_distinct_features(spark):
    reg = features.library()
    assert len(reg.features) > 1100 and all(f.build or f.side for f in reg.features.values())


def test_every_feature_resolves(matches):
    engine = FeatureEngine(features.library())
    phases = engine.phases(list(engine.registry.features), matches.columns)
    assert sum(map(len, phases)) >= len(engine.registry.features)


def test_a_wide_plan_computes(matches):
    names = [n for n in features.library().features if not n.startswith(("surface_", "is_", "matchup_", "_")) and "_vs_" not in n][::8]
    got = compute(matches, names)
    assert len(got) == 240


def test_styles_and_kinds_compute(matches):
    kinds = ["is_power_server", "is_clay_specialist", "matchup_both_power_servers", "winpct_vs_power_server", "matches_vs_surface_specialists", "surface_ace_pct_vs_surf_spec(days=200)"]
    got = compute(matches, [*kinds, "style_radar_serve", "style_radar_rally", "style_conf_net", "surface_easy_hold_pct", "tiebreaks_played", "best_of"])
    assert len(got) == 240 and {r.is_power_server for r in got.values()} >= {0, 1}
    assert all(r.style_radar_serve is not None and 0 <= r.style_conf_net < 1 for r in got.values())


def before(raw, r, days=None, **same):
    key = lambda x: (x["effective_match_date"], x["tournament_start_date"], x["round_order"], x["match_uid"])
    past = [x for x in raw if x["player_id"] == r["player_id"] and all(x[k] == v for k, v in same.items())]
    if days:
        return [x for x in past if 0 < (r["effective_match_date"] - x["effective_match_date"]).days <= days]
    return sorted((x for x in past if key(x) < key(r)), key=key)


def test_against_brute_force(matches, raw):
    got = compute(matches, ["win_pct", "win_pct(days=90, k=0.0)", "surface_hold_pct", "h2h_wins", "sets_per_match", "win_pct_diff", "opp_win_pct", "tourn_games_won", "matches_played(days=90)", "elo_win_prob"])
    m = sum(r["won"] for r in raw) / len(raw)
    by_surface = {}
    for s in ("Hard", "Clay"):
        known = [r for r in raw if r["surface"] == s and r["holds"] is not None and r["svc_games_played"] is not None]
        by_surface[s] = sum(r["holds"] for r in known) / sum(r["svc_games_played"] for r in known)

    def win_pct(r):
        past = before(raw, r)
        return (sum(x["won"] for x in past) + 13 * m) / (len(past) + 13) if past else None

    other = {(r["match_uid"], r["opp_id"]): r for r in raw}
    for r in raw:
        g = got[r["match_uid"], r["player_id"]]
        mine, theirs = win_pct(r), win_pct(other[r["match_uid"], r["player_id"]])
        assert g["win_pct"] == pytest.approx(mine) and g["opp_win_pct"] == pytest.approx(theirs)
        assert g["win_pct_diff"] == (None if None in (mine, theirs) else pytest.approx(mine - theirs))
        recent = before(raw, r, 90)
        assert g["matches_played(days=90)"] == len(recent) and g["win_pct(days=90, k=0.0)"] == (pytest.approx(sum(x["won"] for x in recent) / len(recent)) if recent else None)
        known = [x for x in before(raw, r, surface=r["surface"]) if x["holds"] is not None and x["svc_games_played"] is not None]
        assert g["surface_hold_pct"] == (pytest.approx((sum(x["holds"] for x in known) + 12 * by_surface[r["surface"]]) / (sum(x["svc_games_played"] for x in known) + 12)) if known else None)
        met = before(raw, r, opp_id=r["opp_id"])
        assert g["h2h_wins"] == (sum(x["won"] for x in met) if met else None)
        here = before(raw, r, tournament_id=r["tournament_id"], year=r["year"])
        assert g["tourn_games_won"] == (sum(x["games_won"] for x in here) if here else None)


def test_new_families_against_brute_force(matches, raw):
    specs = ["glicko_zscore_rd", "glicko_bhattacharyya_rd", "tier_ordinal_avg", "level_gap_disp(days=120)", "tourn_hold_pct", "tourn_history_sets_margin_avg_per_year", "tourn_history_year_instances_completed", "venue_win_pct", "match_count_max", "last_match_minutes_per_rest_day", "style_winner_ue_ratio", "style_z_net", "style_net_rate", "wins_vs_power_server", "is_power_server", "glicko_zscore_formvol", "form_volatility"]
    got = compute(matches, specs)
    tier = {k.lower(): v[0] for k, v in families.TIERS.items()}
    other = {(r["match_uid"], r["opp_id"]): r for r in raw}
    near = lambda x: None if x is None else pytest.approx(x)

    def gap(r, days):
        now, past = tier.get((r["tournament_level"] or "").lower()), [tier.get((x["tournament_level"] or "").lower()) for x in before(raw, r, days)]
        known = [x for x in past if x is not None]
        return now - sum(known) / len(known) if known and now is not None else None

    for r in raw:
        g, o = got[r["match_uid"], r["player_id"]], other[r["match_uid"], r["player_id"]]
        mu, rd = r["player_glicko_mu"] - r["opp_glicko_mu"], (r["player_glicko_rd"], r["opp_glicko_rd"])
        assert g["glicko_zscore_rd"] == near(mu / math.hypot(*rd)) and g["glicko_bhattacharyya_rd"] == near(math.sqrt(2 * rd[0] * rd[1] / (rd[0] ** 2 + rd[1] ** 2)) * math.exp(-mu * mu / 4 / (rd[0] ** 2 + rd[1] ** 2)))
        past = before(raw, r)
        assert g["tier_ordinal_avg"] == (near(sum(tier.get((x["tournament_level"] or "").lower(), 0) for x in past) / len(past)) if past else None)
        gaps = gap(r, 120), gap(o, 120)
        assert g["level_gap_disp(days=120)"] == (None if None in gaps else near(abs(gaps[0]) + abs(gaps[1])))
        here = [x for x in before(raw, r, tournament_id=r["tournament_id"], year=r["year"], draw=r["draw"])]
        known = [(x["svc_games_played"] - x["svc_bp_faced"] + x["svc_bp_saved"], x["svc_games_played"]) for x in here if None not in (x["svc_games_played"], x["svc_bp_faced"], x["svc_bp_saved"])]
        assert g["tourn_hold_pct"] == (near(sum(a for a, _ in known) / sum(b for _, b in known)) if sum(b for _, b in known) > 0 else None)
        same = [x for x in raw if all(x[k] == r[k] for k in ("player_id", "tournament_id", "draw"))]
        ended = [y for y in {x["year"] for x in same} if all(x in past for x in same if x["year"] == y)]
        assert g["tourn_history_year_instances_completed"] == len(ended)
        totals = [sum(x["sets_won"] - x["sets_lost"] for x in same if x["year"] == y) for y in ended]
        assert g["tourn_history_sets_margin_avg_per_year"] == (near(sum(totals) / len(totals)) if totals else None)
        inside = before(raw, r, indoor=r["indoor"])
        assert g["venue_win_pct"] == (near(sum(x["won"] for x in inside) / len(inside)) if inside else None)
        assert g["match_count_max"] == max(len(past), len(before(raw, o)))
        timed = [x for x in past if x["minutes"] is not None]
        assert g["last_match_minutes_per_rest_day"] == (near(timed[-1]["minutes"] / ((r["effective_match_date"] - timed[-1]["effective_match_date"]).days + 1)) if timed else None)
        shown = [x["mb_player_winners"] / x["mb_player_ues"] for x in before(raw, r, 365) if x["mb_player_winners"] is not None and (x["mb_player_ues"] or 0) > 0]
        assert g["style_winner_ue_ratio"] == (near(sum(shown) / len(shown)) if shown else None)
        field = [got[x["match_uid"], x["player_id"]]["style_net_rate"] for x in raw if x["player_id"] != r["player_id"] and 0 < (r["effective_match_date"] - x["effective_match_date"]).days <= 730]
        field = [x for x in field if x is not None]
        if g["style_net_rate"] is not None and len(field) >= 2 and statistics.stdev(field) > 1e-4:
            assert g["style_z_net"] == pytest.approx((g["style_net_rate"] - statistics.mean(field)) / statistics.stdev(field), rel=1e-4)
        else:
            assert g["style_z_net"] is None
        assert g["wins_vs_power_server"] == sum(x["won"] * (got[x["match_uid"], x["opp_id"]]["is_power_server"] or 0) for x in past)
        vol = g["form_volatility"], got[r["match_uid"], r["opp_id"]]["form_volatility"]
        assert g["glicko_zscore_formvol"] == (None if None in vol else near(mu / math.sqrt(vol[0] ** 2 + vol[1] ** 2 + 0.1)))


def test_chain_and_kinds_against_brute_force(matches, raw):
    from rallyframe.operators import markov

    specs = ["iid_hold_prob", "iid_expected_games_per_set", "iid_tiebreak_prob", "is_power_server", "is_placement_server", "matches_vs_opp_serve_type", "surface_winpct_vs_opp_serve_type", "wins_vs_opp_net_type(days=200)", "is_net_rusher", "style_resid_vs_net(days=300)", "style_radar_net", "elo_surface_diff"]
    got = compute(matches, specs)

    def chain(x, y):
        games, both_six = 0.0, 0.0
        for first in (True, False):
            states = {(0, 0): 0.5}
            for n in range(13):
                ahead = {}
                for (a, b), w in states.items():
                    if max(a, b) >= 6 and abs(a - b) >= 2 or max(a, b) == 7:
                        games += w * (a + b)
                    elif a == b == 6:
                        games, both_six = games + 13 * w, both_six + w
                    else:
                        p = x if (n % 2 == 0) == first else 1 - y
                        ahead[a + 1, b] = ahead.get((a + 1, b), 0) + w * p
                        ahead[a, b + 1] = ahead.get((a, b + 1), 0) + w * (1 - p)
                states = ahead
            games += sum(w * (a + b if (a, b) != (6, 6) else 13) for (a, b), w in states.items())
            both_six += states.get((6, 6), 0)
        return games, both_six

    assert markov.hold(0.6) == pytest.approx(0.7357, abs=1e-3)
    kind = lambda g: None if g["is_power_server"] is None else 1 if g["is_power_server"] else -1 if g["is_placement_server"] else 0
    foe = lambda x: got[x["match_uid"], x["opp_id"]]
    seen = set()
    for r in raw:
        g, o = got[r["match_uid"], r["player_id"]], foe(r)
        x, y = g["iid_hold_prob"], o["iid_hold_prob"]
        if x is None or y is None:
            assert g["iid_tiebreak_prob"] is None
        else:
            want = chain(*(min(1.0, max(0.0, round(v, 2))) for v in (x, y)))
            assert (g["iid_expected_games_per_set"], g["iid_tiebreak_prob"]) == pytest.approx(want)
        past = before(raw, r)
        if kind(o) is None:
            assert g["matches_vs_opp_serve_type"] is None
        else:
            seen.add(kind(o))
            assert g["matches_vs_opp_serve_type"] == sum(kind(foe(p)) == kind(o) for p in past)
            here = [p for p in before(raw, r, surface=r["surface"]) if kind(foe(p)) == kind(o)]
            assert g["surface_winpct_vs_opp_serve_type"] == (pytest.approx(sum(p["won"] for p in here) / len(here)) if here else None)
        if o["is_net_rusher"] is not None:
            assert g["wins_vs_opp_net_type(days=200)"] == sum(p["won"] for p in before(raw, r, 200) if foe(p)["is_net_rusher"] == o["is_net_rusher"])
        recent = before(raw, r, 300)
        z = [(foe(p)["style_radar_net"], p["won"] - 1 / (1 + 10 ** (-got[p["match_uid"], p["player_id"]]["elo_surface_diff"] / 400))) for p in recent]
        assert g["style_resid_vs_net(days=300)"] == (pytest.approx(sum(a * b for a, b in z) / (sum(a * a for a, _ in z) + 1)) if recent else None)
    assert seen == {1, 0, -1}


def test_tour_ratings(matches):
    from rallyframe.operators import tour_ratings as T

    rated = T.rate_players(T.observations(matches.withColumns({f"{s}_tb{i}": F.lit(None).cast("int") for s in ("player", "opp") for i in range(1, 6)}).withColumn("opp_svc_aces", F.lit(3.0))))
    rows = rated.orderBy("effective_match_date", "round_order", "match_uid", "player_id").collect()
    assert len(rows) == 240 and set(f"player_{f}" for f in T.FIELDS) <= set(rated.columns)
    by = {(r.match_uid, r.player_id): r for r in rows}
    assert all(r.opp_elo == by[r.match_uid, r.opp_id].player_elo for r in rows)
    first = rows[0]
    other = by[first.match_uid, first.opp_id]
    a, b = T.Player(first.player_rank), T.Player(other.player_rank)
    assert first.player_elo == pytest.approx(a.now["elo"]) and other.player_elo == pytest.approx(b.now["elo"])
    seen = [{k: r[f"seen_{k}"] for k in T.SEEN} for r in (first, other)]
    T.play(a, b, bool(first.won), first.surface.lower(), first.indoor, first.round, first.tournament_level, first.effective_match_date, *seen)
    again = next(r for r in rows[2:] if r.player_id == first.player_id)
    assert again.player_elo == pytest.approx(a.now["elo"]) and again.player_serve_elo == pytest.approx(a.now["serve_elo"]) and again.player_glicko_mu == pytest.approx(a.now["glicko_mu"])
    assert again.player_elo_rd >= a.now["elo_rd"]
