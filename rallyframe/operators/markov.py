"""Markov chain of a tennis match: games, sets, matches and total games."""

from __future__ import annotations

import sys
from functools import cache, lru_cache

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hold(p: float) -> float:
    """Chance to win a service game: four points before three, or from deuce."""
    q = 1 - p
    at_deuce = p * p / (p * p + q * q) if p * p + q * q else 0.0
    return p**4 * (1 + 4 * q + 10 * q * q) + 20 * (p * q) ** 3 * at_deuce


def tiebreak(pa: float, pb: float, to: int = 7) -> float:
    """Chance of A, who serves first, to win a tiebreak; points on serve pa, pb."""
    @cache
    def win(a: int, b: int) -> float:
        if a >= to and a - b >= 2:
            return 1.0
        if b >= to and b - a >= 2:
            return 0.0
        if a == b and a >= to - 1:
            # Each serves one of the next two points.
            both, none = pa * (1 - pb), (1 - pa) * pb
            return both / (both + none) if both + none else 0.5
        serving_a = (a + b + 1) // 2 % 2 == 0
        p = pa if serving_a else 1 - pb
        return p * win(a + 1, b) + (1 - p) * win(a, b + 1)

    return win(0, 0)


def set_scores(pa: float, pb: float, a_first: bool = True) -> dict[tuple[int, int], float]:
    """Distribution of a tiebreak set's final games."""
    ha, hb = hold(pa), hold(pb)
    breaker = tiebreak(pa, pb) if a_first else 1 - tiebreak(pb, pa)
    states, out = {(0, 0): 1.0}, {}
    for n in range(13):
        ahead: dict[tuple[int, int], float] = {}
        for (a, b), w in states.items():
            if a == 6 and b == 6:
                chance, ends = breaker, True
            else:
                chance, ends = (ha if (n % 2 == 0) == a_first else 1 - hb), False
            for score, part in (((a + 1, b), w * chance), ((a, b + 1), w * (1 - chance))):
                done = ends or max(score) == 7 or max(score) == 6 and abs(score[0] - score[1]) >= 2
                where = out if done else ahead
                where[score] = where.get(score, 0.0) + part
        states = ahead
    return out


def match_games(pa: float, pb: float, best_of: int = 3) -> tuple[float, list[float]]:
    """Chance of A to win the match, and the distribution of its total games.
    The player to serve first in a set follows from the games before it."""
    need = best_of // 2 + 1
    by_first = {f: set_scores(pa, pb, f) for f in (True, False)}
    states = {(0, 0, 0, True): 1.0}
    pmf, won = [0.0] * (13 * best_of + 1), 0.0
    while states:
        ahead: dict[tuple[int, int, int, bool], float] = {}
        for (a, b, games, first), w in states.items():
            for (x, y), p in by_first[first].items():
                key = (a + (x > y), b + (y > x), games + x + y, first == ((x + y) % 2 == 0))
                if max(key[:2]) == need:
                    pmf[key[2]] += w * p
                    won += w * p * (key[0] == need)
                else:
                    ahead[key] = ahead.get(key, 0.0) + w * p
        states = ahead
    return won, pmf


def _rows(batches):
    """Each pair of chances is computed once a task, while it is among the recent ones."""
    known = lru_cache(maxsize=1 << 14)(match_games)
    for rows in batches:
        out = []
        for i, a, b, n in zip(rows["id"], rows["pa"], rows["pb"], rows["best_of"], strict=True):
            out.append((i, *known(float(a), float(b), int(n))))
        yield pd.DataFrame(out, columns=["id", "p_match", "games_pmf"])


def project(df: DataFrame, key: str, pa: str, pb: str, best_of: str) -> DataFrame:
    """(key, p_match, games_pmf) for rows with both chances to win a point on serve."""
    kind = df.schema[key].dataType.simpleString()
    given = df.where(F.col(pa).isNotNull() & F.col(pb).isNotNull()).select(F.col(key).alias("id"), F.col(pa).alias("pa"), F.col(pb).alias("pb"), F.col(best_of).alias("best_of"))
    return given.mapInPandas(_rows, f"id {kind}, p_match double, games_pmf array<double>").withColumnRenamed("id", key)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
