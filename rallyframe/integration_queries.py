"""Queries of integration: nested feeds, swapped sides, rounds, completeness,
null-safe joins, grids, filters on features, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import integrate as I
from .operators import reshape as H
from .plans import filters as L
from .plans.planner import FeatureEngine
from .queries import MATCHES, feature_registry, player_matches, query, r6
from .sources.tables import table

BOOK, MARKET = "'b' || (l_suppkey % 3)", "['totals', 'spread'][l_linenumber % 2 + 1]"


@query(f"""SELECT l_orderkey, {BOOK} AS book, {MARKET} AS market, CASE WHEN l_partkey % 2 = 0 THEN 'over' ELSE 'under' END AS outcome, (l_partkey * 10 + l_linenumber)::BIGINT AS t, l_quantity AS price FROM lineitem""")
def feed_flatten(spark, d):
    """Lines as a feed nested by book, market and outcome, and back to rows."""
    l = table(spark, d, "lineitem")
    rows = l.select("l_orderkey", F.concat(F.lit("b"), (F.col("l_suppkey") % 3).cast("string")).alias("book"), F.when(F.col("l_linenumber") % 2 == 0, "totals").otherwise("spread").alias("market"),
                    F.when(F.col("l_partkey") % 2 == 0, "over").otherwise("under").alias("outcome"), F.struct((F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("t"), F.col("l_quantity").alias("price")).alias("tick"))
    nest = lambda df, keys, key, name, value: df.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(key, F.struct(F.col(value).alias(name))))).alias("_v"))
    ticks = rows.groupBy("l_orderkey", "book", "market", "outcome").agg(F.collect_list("tick").alias("_v"))
    for keys, key, name in ((["l_orderkey", "book", "market"], "outcome", "ticks"), (["l_orderkey", "book"], "market", "outcomes"), (["l_orderkey"], "book", "markets")):
        ticks = nest(ticks, keys, key, name, "_v")
    return H.flatten_feed(ticks.select("l_orderkey", F.to_json("_v").alias("payload")), "payload", ["l_orderkey"])


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN o_custkey + 1 ELSE o_custkey END AS a_id, CASE WHEN o_orderstatus = 'P' THEN o_custkey ELSE o_custkey + 1 END AS b_id, CASE WHEN o_orderstatus = 'P' THEN -o_totalprice ELSE o_totalprice END AS a_odds, CASE WHEN o_orderstatus = 'P' THEN o_totalprice ELSE -o_totalprice END AS b_odds FROM orders")
def side_swap(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_custkey").alias("a_id"), (F.col("o_custkey") + 1).alias("b_id"), F.col("o_totalprice").alias("a_odds"), (-F.col("o_totalprice")).alias("b_odds"))
    return I.swap_sides(o, F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus") == "P"), "a_", "b_", ["id", "odds"]).drop("o_orderstatus")


@query("SELECT o_orderkey, list_position(['Q1', 'Q2', 'Q3', 'RR', 'R128', 'R64', 'R32', 'R16', 'QF', 'SF', 'F'], ['QF', 'F', 'R16', 'Q2', 'XX'][o_orderkey % 5 + 1])::INT AS place FROM orders")
def round_places(spark, d):
    names = F.get(F.array(*[F.lit(x) for x in ("qf", "F", "r16", "Q2", "XX")]), (F.col("o_orderkey") % 5).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", I.round_ordinal(names).alias("place"))


KINDS = "SELECT o_orderkey, ['W/O', 'RET', 'DEF', NULL][o_orderkey % 4 + 1] AS reason, ['walkover', 'completed', NULL][o_orderkey % 3 + 1] AS result, ['DC Final', 'Open', NULL][o_custkey % 3 + 1] AS name, ['team', 'tour', NULL][o_custkey % 4 % 3 + 1] AS circuit FROM orders"


@query(f"SELECT o_orderkey FROM ({KINDS}) k WHERE NOT coalesce(reason IN ('W/O', 'DEF') OR result = 'walkover', false) AND NOT (coalesce(starts_with(name, 'DC'), false) OR coalesce(circuit = 'team', false))")
def completed_matches(spark, d):
    pick = lambda i, *xs: F.get(F.array(*[F.lit(x).cast("string") for x in xs]), i.cast("int"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = table(spark, d, "orders").select(k, pick(k % 4, "W/O", "RET", "DEF", None).alias("reason"), pick(k % 3, "walkover", "completed", None).alias("result"), pick(c % 3, "DC Final", "Open", None).alias("name"), pick(c % 4 % 3, "team", "tour", None).alias("circuit"))
    return o.where(L.completed(F.col("reason"), F.col("result"), ("DEF",)) & L.no_team_events(F.col("name"), F.col("circuit"))).select("o_orderkey")


LINED = "(SELECT event_id, CASE WHEN event_id % 3 > 0 THEN event_id % 50 END AS point, user_id FROM events)"


@query(f"SELECT a.event_id, b.n FROM {LINED} a JOIN (SELECT point, user_id, count(*) AS n FROM {LINED} x GROUP BY 1, 2) b ON a.point IS NOT DISTINCT FROM b.point AND a.user_id = b.user_id")
def null_safe_join(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 50).alias("point"), "user_id")
    counts = e.groupBy(F.col("point").alias("_p"), F.col("user_id").alias("_u")).agg(F.count(F.lit(1)).alias("n"))
    return e.join(counts, F.col("point").eqNullSafe(F.col("_p")) & (F.col("user_id") == F.col("_u"))).select("event_id", "n")


@query("""WITH g AS (SELECT user_id, k, sum(p) OVER (PARTITION BY user_id ORDER BY k) AS cum FROM (SELECT user_id, k, (user_id % 3 + 1 + k) / (4.0::DOUBLE * (user_id % 3) + 10) AS p FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest(range(0, 4)) AS k)))
SELECT event_id, round(1 - CASE WHEN floor(value / 20 - 0.5) < 0 THEN 0 ELSE coalesce(cum, 1) END, 6) AS p_over FROM events e LEFT JOIN g ON g.user_id = e.user_id AND g.k = floor(value / 20 - 0.5)::INT""")
def cover_grid(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", (F.col("value") / 20 - 0.5).alias("line"))
    u = F.col("user_id") % 3
    pmf = e.select("user_id").distinct().select("user_id", F.array(*[(u + 1 + k) / (4.0 * u + 10) for k in range(4)]).alias("pmf"))
    return H.cover_probability(e, H.cumulative_pmf(pmf, "user_id", "pmf"), "user_id", "line").select("event_id", r6(F.col("p_over"), "p_over"))


@query(f"""WITH m AS {MATCHES}, f AS (SELECT *, sum(won) OVER b AS w, count(*) OVER b AS n FROM m WINDOW b AS (PARTITION BY player_id ORDER BY ts, match_uid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT match_uid, player_id FROM f WHERE n >= 5 AND w / n >= 0.5 AND points >= 30""")
def feature_filter(spark, d):
    rows = player_matches(spark, d)
    return FeatureEngine(feature_registry()).filtered(rows, {"matches_played": {"min": 5}, "win_pct": {"min": 0.5}, "points": {"min": 30}}).select("match_uid", "player_id")
