"""From feature specs to a table: parse, close over needs, order in phases, fuse.

A spec is ``name`` or ``name(days=365, k=5)``. Features of one phase need only
earlier phases; all of a phase's columns go into one select, where the engine
shares one shuffle and sort among windows over the same keys and order. The
opponent's columns come from one window over the two rows of a match.
"""

from __future__ import annotations

import ast
import hashlib
import json
import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import settled
from .filters import where
from .registry import Registry

SPEC = re.compile(r"^\s*([A-Za-z_]\w*)\s*(?:\((.*)\))?\s*$", re.S)
#: Columns in one select; plans grow slow to optimise beyond it.
BATCH = 150


def parse(spec: str) -> tuple[str, dict]:
    m = SPEC.match(spec)
    if not m:
        raise ValueError(f"not a feature spec: {spec!r}")
    if not (m[2] or "").strip():
        return m[1], {}
    call = ast.parse(f"f({m[2]})", mode="eval").body
    if call.args or any(k.arg is None for k in call.keywords):
        raise ValueError(f"parameters must be named: {spec!r}")
    return m[1], {k.arg: ast.literal_eval(k.value) for k in call.keywords}


def canonical(name: str, params: dict) -> str:
    return name if not params else f"{name}({', '.join(f'{k}={params[k]!r}' for k in sorted(params))})"


def fingerprint(specs: list[str]) -> str:
    """A name for a set of specs, whatever their order and spelling."""
    return hashlib.sha256(json.dumps(sorted(canonical(*parse(s)) for s in specs)).encode()).hexdigest()[:16]


class _Context:
    def __init__(self, engine: FeatureEngine):
        self.engine = engine

    def column(self, spec: str) -> Column:
        return F.col(f"`{self.engine.resolve(spec)[0]}`")

    def pooled(self, num: str, den: str, by: tuple[str, ...] = ()) -> Column:
        """The overall ratio of two columns, or of each row's stratum; the overall
        one for a stratum without."""
        known = self.engine.pools[num, den, by]
        if not by:
            return F.lit(known.get((), None)).cast("double")
        overall = F.lit(known.get(None)).cast("double")
        out = None
        for key, m in known.items():
            if key is not None and m is not None:
                test = F.col(by[0]).eqNullSafe(F.lit(key[0]))
                out = F.when(test, F.lit(m)) if out is None else out.when(test, F.lit(m))
        return out.otherwise(overall) if out is not None else overall

    def opponent(self, spec: str) -> Column:
        return F.col(f"`opp:{self.engine.resolve(spec)[0]}`")


class FeatureEngine:
    """Computes specs over a table of two rows a match."""

    def __init__(self, registry: Registry, match: str = "match_uid", player: str = "player_id"):
        self.registry, self.match, self.player = registry, match, player
        self.pools: dict[tuple, dict] = {}
        self.raw: frozenset[str] = frozenset()

    def resolve(self, spec: str) -> tuple[str, dict, object]:
        """Canonical name, parameters and declaration; raw columns have none."""
        name, given = parse(spec.removeprefix("="))
        f = self.registry.features.get(name)
        if f is None:
            if given:
                raise KeyError(f"unknown feature: {name}")
            return name, {}, None
        if unknown := set(given) - set(f.params):
            raise ValueError(f"{name} has no parameters {sorted(unknown)}")
        params = f.params | given
        key = canonical(name, params)
        # A feature may be called as a raw column is.
        return f"={key}" if key in self.raw else key, params, f

    def phases(self, specs: list[str], raw: list[str]) -> list[list[str]]:
        """Canonical names by phase: each needs only raw columns and earlier
        phases. A need that names a raw column is that column, even if a
        feature shares its name."""
        depth: dict[str, int] = {}

        def visit(spec: str, above: tuple[str, ...]) -> int:
            key, params, f = self.resolve(spec)
            if key in above:
                raise ValueError(f"features need each other: {' -> '.join([*above, key])}")
            if f is None:
                if key not in raw:
                    raise KeyError(f"neither a feature nor a column: {key}")
                return 0
            if key not in depth:
                depth[key] = 1 + max([0, *(visit(n.format(**params), (*above, key)) for n in f.needs if n not in raw)])
            return depth[key]

        for s in specs:
            visit(s, ())
        out: list[list[str]] = [[] for _ in range(max(depth.values(), default=0))]
        for key, d in depth.items():
            out[d - 1].append(key)
        return out

    def compute(self, df: DataFrame, specs: list[str], extra: tuple[str, ...] = ()) -> DataFrame:
        """Keys, ``extra`` columns and one column a spec, named as written."""
        context, self.raw = _Context(self), frozenset(df.columns)
        phases = self.phases(specs, df.columns)
        self._measure(df, [self.resolve(key)[2].pool for phase in phases for key in phase])
        for phase in phases:
            declared = [(key, *self.resolve(key)[1:]) for key in phase]
            needed = sorted({self.resolve(n.format(**p))[0] for _, p, f in declared if f.mirror for n in f.needs})
            if needed:
                df = self._with_opponent(df, needed)
            plain = [(k, p, f) for k, p, f in declared if f.transform is None and f.side is None]
            for i in range(0, len(plain), BATCH):
                df = df.select("*", *[f.build(context, **p).alias(k) for k, p, f in plain[i : i + BATCH]])
            for _, _, f in declared:
                if f.transform is not None:
                    df = df.transform(f.transform)
            df = self._join_sides(context, df, [(k, f) for k, _, f in declared if f.side is not None])
            df = df.drop(*[f"opp:{n}" for n in needed])
        return df.select(self.match, self.player, *extra, *[F.col(f"`{self.resolve(s)[0]}`").alias(s) for s in specs if self.resolve(s)[2] is None or self.resolve(s)[2].transform is None])

    def filtered(self, df: DataFrame, conditions: dict) -> DataFrame:
        """Rows of ``df`` that meet conditions of the filter language; a name that
        is no column is a feature, computed before the rows are chosen."""
        specs = [n for n in conditions if n not in df.columns]
        if not specs:
            return df.where(where(conditions))
        named = {s: f"_f{i}" for i, s in enumerate(specs)}
        found = self.compute(df, specs).select(self.match, self.player, *[F.col(f"`{s}`").alias(n) for s, n in named.items()])
        met = df.join(found, [self.match, self.player]).where(where({named.get(n, n): c for n, c in conditions.items()}))
        return met.select(*df.columns)

    def _measure(self, df: DataFrame, pools: list) -> None:
        """Overall ratios that shrunk features need: one pass for all without
        strata, one for each kind of strata. A stratum is a surface or the
        like: what comes back is a few rows."""
        for by in {p[2] for p in pools if p}:
            wanted = sorted({p[:2] for p in pools if p and p[2] == by})
            both = lambda a, b, c: F.sum(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(c)))
            sums = [both(a, b, c).cast("double").alias(f"{x}{i}") for i, (a, b) in enumerate(wanted) for x, c in (("n", a), ("d", b))]
            rows = (df.groupBy(*by) if by else df).agg(*sums).collect()
            ratio = lambda n, d: n / d if d else None
            for i, pair in enumerate(wanted):
                self.pools[*pair, by] = {tuple(r[b] for b in by): ratio(r[f"n{i}"], r[f"d{i}"]) for r in rows}
                if by:
                    self.pools[*pair, by][None] = ratio(*(sum(r[f"{x}{i}"] or 0.0 for r in rows) for x in "nd"))

    @staticmethod
    def _join_sides(context: _Context, df: DataFrame, features: list) -> DataFrame:
        """``df`` with features that are joined to it. The table is written once,
        and all sides are made from that: else each would repeat all before it."""
        if not features:
            return df
        base = settled(df)
        out = base
        for i, (key, f) in enumerate(features):
            side, on = f.side(context, base)
            side = side.select(*[F.col(k).alias(f"_on{i}_{k}") for k in on], F.col("value").alias(key))
            met = reduce(and_, [c == F.col(f"_on{i}_{k}") for k, c in on.items()])
            out = out.join(side, met, "left").drop(*[f"_on{i}_{k}" for k in on])
        return out

    def _with_opponent(self, df: DataFrame, names: list[str]) -> DataFrame:
        w = Window.partitionBy(self.match).orderBy(self.player)
        both = F.struct(*[F.col(f"`{n}`").alias(f"f{i}") for i, n in enumerate(names)])
        met = df.withColumn("_both", both).withColumn("_opp", F.coalesce(F.lead("_both").over(w), F.lag("_both").over(w)))
        return met.select("*", *[F.col(f"_opp.f{i}").alias(f"opp:{n}") for i, n in enumerate(names)]).drop("_both", "_opp")
