"""Declared features: name, inputs and expression; differences, sums, matchups."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame



@dataclass(frozen=True)
class Feature:
    """``build(engine, **params)`` gives a column over the columns of ``needs``
    (raw columns or other features); ``mirror`` features read the opponent's."""

    name: str
    build: Callable
    needs: tuple[str, ...] = ()
    params: dict = field(default_factory=dict)
    mirror: bool = False
    transform: Callable[[DataFrame], DataFrame] | None = None
    pool: tuple[str, str, tuple[str, ...]] | None = None
    side: Callable | None = None


class Registry:
    def __init__(self):
        self.features: dict[str, Feature] = {}

    def _add(self, f: Feature) -> None:
        if f.name in self.features:
            raise ValueError(f"feature {f.name} is declared twice")
        self.features[f.name] = f

    def declare(self, name: str, build: Callable, needs: tuple[str, ...], params: dict, pool: tuple[str, str, tuple[str, ...]] | None = None) -> None:
        """A feature built by a function made in a loop. ``pool`` names the
        columns (and strata) whose overall ratio it needs."""
        self._add(Feature(name, build, tuple(dict.fromkeys(needs)), params, False, None, pool))

    def opponent(self, base: str) -> None:
        """The opponent's value of ``base``, as opp_``base``."""
        self.pair(f"opp_{base}", base, lambda a, b: b)

    def feature(self, *needs: str, mirror: bool = False):
        """Declare the decorated function as a feature of its name. A need may
        name a parameter in braces: ``wins(days={days})``."""
        def declare(fn):
            params = {k: p.default for k, p in list(inspect.signature(fn).parameters.items())[1:]}
            self._add(Feature(fn.__name__, fn, needs, params, mirror))
            return fn
        return declare

    def pair(self, name: str, base: str, combine: Callable[[Column, Column], Column]) -> None:
        """A feature of the player's and the opponent's ``base``."""
        params = dict(self.features[base].params)
        call = f"{base}({', '.join(f'{k}={{{k}}}' for k in params)})" if params else base
        def build(ctx, **given):
            own = ctx.column(call.format(**given))
            return combine(own, ctx.opponent(call.format(**given)))
        self._add(Feature(name, build, (call,), params, True))

    def diff(self, base: str) -> None:
        self.pair(f"{base}_diff", base, lambda a, b: a - b)

    def sum(self, base: str) -> None:
        self.pair(f"{base}_sum", base, lambda a, b: a + b)

    def matchup(self, name: str, own: str, other: str) -> None:
        """Player's ``own`` minus the opponent's ``other``."""
        self._add(Feature(name, lambda ctx: ctx.column(own) - ctx.opponent(other), (own, other), {}, True))

    def table(self, name: str, needs: tuple[str, ...], transform: Callable[[DataFrame], DataFrame]) -> None:
        """A feature that adds its columns to the whole table."""
        self._add(Feature(name, None, needs, {}, False, transform))

    def joined(self, name: str, needs: tuple[str, ...], side: Callable) -> None:
        """A feature read from a table of its own: ``side(ctx, df)`` gives that
        table with the column ``value``, and for each of its keys the column of
        ``df`` that it equals."""
        self._add(Feature(name, None, needs, {}, False, None, None, side))

    def both(self, name: str, base: str | tuple[str, ...], combine: Callable, needs: tuple[str, ...] = (), days: bool = True) -> None:
        """A feature of both sides' ``base`` features over the same days, and of raw
        columns: ``combine(own..., opponent's...)``."""
        calls = tuple(f"{b}(days={{days}})" if days else b for b in ([base] if isinstance(base, str) else base))
        build = lambda ctx, **given: combine(*[side(c.format(**given)) for side in (ctx.column, ctx.opponent) for c in calls])
        self._add(Feature(name, build, (*calls, *needs), {"days": None} if days else {}, True))
