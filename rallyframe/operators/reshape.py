"""Reshaping: perspectives, sides, distributions, nested feeds, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def perspectives(df: DataFrame, first: str, second: str, player: str = "player_id", opponent: str = "opp_id") -> DataFrame:
    """Two mirrored rows a match: columns that start with ``first`` and
    ``second`` become the player's and the opponent's, and the other way."""
    shared = [c for c in df.columns if not c.startswith((first, second))]
    fields = [c[len(first):] for c in df.columns if c.startswith(first)]
    side = lambda a, b: F.struct(*[F.col(f"{a}{f}").alias(player if f == "id" else f"player_{f}") for f in fields], *[F.col(f"{b}{f}").alias(opponent if f == "id" else f"opp_{f}") for f in fields])
    return df.select(*shared, F.explode(F.array(side(first, second), side(second, first))).alias("_s")).select(*shared, "_s.*")


def unpivot_sides(df: DataFrame, keys: list[str], sides: dict[str, str], value: str) -> DataFrame:
    """One row a side: ``sides`` maps a side's name to its column."""
    rows = F.array(*[F.struct(F.lit(n).alias("side"), F.col(c).cast("double").alias(value)) for n, c in sides.items()])
    return df.select(*keys, F.explode(rows).alias("_s")).select(*keys, "_s.*")


def cumulative_pmf(df: DataFrame, key: str, pmf: str) -> DataFrame:
    """(key, k, p, cum) from an array of probabilities of 0, 1, ..."""
    run = lambda p, i: F.struct(i.alias("k"), p.alias("p"), F.aggregate(F.slice(F.col(pmf), 1, i + 1), F.lit(0.0), lambda a, x: a + x).alias("cum"))
    return df.select(key, F.explode(F.transform(pmf, run)).alias("_r")).select(key, "_r.*")


def cover_probability(lines: DataFrame, grid: DataFrame, key: str, line: str) -> DataFrame:
    """P(total > line) for each line, by an equal join on the line's floor."""
    under = grid.select(F.col(key), F.col("k").alias("_k"), "cum")
    return lines.withColumn("_k", F.floor(F.col(line)).cast("int")).join(under, [key, "_k"], "left").withColumn("p_over", 1 - F.coalesce("cum", F.when(F.col("_k") < 0, 0.0).otherwise(1.0))).drop("_k", "cum")


TICKS = "map<string,struct<markets:map<string,struct<outcomes:map<string,struct<ticks:array<struct<t:bigint,price:double>>>>>>>>"


def flatten_feed(df: DataFrame, payload: str, keys: list[str]) -> DataFrame:
    """Quotes of a nested feed: book -> market -> outcome -> ticks, as rows.
    Malformed payloads give no rows."""
    books = df.select(*keys, F.explode(F.from_json(payload, TICKS)).alias("book", "_b"))
    markets = books.select(*keys, "book", F.explode("_b.markets").alias("market", "_m"))
    outcomes = markets.select(*keys, "book", "market", F.explode("_m.outcomes").alias("outcome", "_o"))
    return outcomes.select(*keys, "book", "market", "outcome", F.explode("_o.ticks").alias("_t")).select(*keys, "book", "market", "outcome", "_t.*")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], version: str, tie: str) -> DataFrame:
    """Rows of both with the newest change of each key in place of the old row."""
    newest = changes.groupBy(*keys).agg(F.max_by(F.struct(*changes.columns), F.struct(version, tie)).alias("_r")).select("_r.*")
    return current.join(newest.select(*keys), keys, "left_anti").unionByName(newest, allowMissingColumns=True)


def with_partners(df: DataFrame, doubles: Column, keep: list[str]) -> DataFrame:
    """``df`` with a row for each partner in doubles: the two of a side swapped, the
    columns ``keep`` as they are and all others null, so that workload counts both."""
    names = {"player_id": "player_partner_id", "player_partner_id": "player_id", "opp_id": "opp_partner_id", "opp_partner_id": "opp_id"}
    partners = df.where(doubles & F.col("player_partner_id").isNotNull()).select(*[F.col(names.get(c, c)).alias(c) if c in names or c in keep else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns])
    return df.unionByName(partners)
