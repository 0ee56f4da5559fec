"""Filter, scenario and alert-rule languages, folded to columns."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPARE = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "==": operator.eq}


def _all(parts: list[Column]) -> Column:
    return reduce(operator.and_, parts, F.lit(True))


def where(spec: dict) -> Column:
    """{column: value, list, or {min, max, abs_min, abs_max}}, all of them."""
    parts = []
    for name, want in spec.items():
        c = F.col(name)
        if isinstance(want, dict):
            bounds = {"min": c >= F.lit(want.get("min")), "max": c <= F.lit(want.get("max")), "abs_min": F.abs(c) >= F.lit(want.get("abs_min")), "abs_max": F.abs(c) <= F.lit(want.get("abs_max"))} if want else {}
            if unknown := set(want) - set(bounds):
                raise ValueError(f"unknown bounds for {name}: {sorted(unknown)}")
            parts += [bounds[k] for k in want]
        elif isinstance(want, list | tuple | set):
            parts.append(c.isin(*want))
        else:
            parts.append(c == F.lit(want))
    return _all(parts)


def scenario(conditions: list[tuple[str, str, object]]) -> Column:
    """All of (column, operator, value)."""
    return _all([COMPARE[op](F.col(name), F.lit(value)) for name, op, value in conditions])


def rule(spec: dict) -> Column:
    """An alert rule: a number is a least value, {min, max} a range, a string is
    compared without case, a list means any of. Nulls never satisfy."""
    parts = []
    for name, want in spec.items():
        c = F.col(name)
        if isinstance(want, dict):
            parts += [c >= F.lit(want["min"])] * ("min" in want) + [c <= F.lit(want["max"])] * ("max" in want)
        elif isinstance(want, bool):
            parts.append(c == F.lit(want))
        elif isinstance(want, int | float):
            parts.append(c >= F.lit(want))
        elif isinstance(want, list | tuple):
            parts.append(F.lower(c.cast("string")).isin(*[str(w).lower() for w in want]))
        else:
            parts.append(F.lower(c.cast("string")) == str(want).lower())
    return F.coalesce(_all(parts), F.lit(False))


def first_fires(df: DataFrame, rules: dict[str, dict], key: str, ledger: DataFrame) -> DataFrame:
    """(rule, key) that fire and are not in the ledger yet."""
    names = F.filter(F.array(*[F.when(rule(r), F.lit(n)) for n, r in rules.items()]), lambda x: x.isNotNull())
    fired = df.select(F.explode(names).alias("rule"), key).distinct()
    return fired.join(ledger.select("rule", key), ["rule", key], "left_anti")


def completed(reason: Column, result: Column, also: tuple[str, ...] = ()) -> Column:
    """Whether a match was played to its end; a missing reason counts as played."""
    return ~F.coalesce(reason.isin("W/O", *also) | (result == "walkover"), F.lit(False))


def no_team_events(name: Column, circuit: Column) -> Column:
    return ~(F.coalesce(F.startswith(name, F.lit("DC")), F.lit(False)) | F.coalesce(circuit == "team", F.lit(False)))


def upto(df: DataFrame, cutoff, column: str = "effective_match_date") -> DataFrame:
    """Rows dated up to ``cutoff``, all of its day included; without a cutoff all
    rows. A frame without the column is an error, as silence would let later
    rows in."""
    if cutoff is None:
        return df
    if column not in df.columns:
        raise ValueError(f"no column {column!r} to cut at {cutoff}")
    return df.where(F.to_date(column) <= F.lit(cutoff).cast("date"))
