"""Queries over markets: boards, main lines, anchors and the ledger, with SQL.

Lines stand for price ticks of four books, eight orders for a match, and a
simple distribution by match number for the model.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import analysis as N
from .operators import ledger as G
from .operators import prices as P
from .operators import reports as B
from .queries import query, r6
from .sources.tables import table

TICKS = """(SELECT l_orderkey // 8 AS match_uid, ['b0', 'b1', 'b2', 'pinnacle'][l_suppkey % 4 + 1] AS book, CASE WHEN l_linenumber % 3 = 0 THEN 2.0 ELSE 1.5 + l_linenumber % 3 END::DOUBLE AS points, CASE WHEN l_partkey % 2 = 0 THEN 'over' ELSE 'under' END AS side,
CASE WHEN l_quantity < 3 THEN 1.0 ELSE round(1 + l_quantity / 25, 4) END::DOUBLE AS odds, l_discount < 0.09 AS active, CASE WHEN l_tax > 0.07 THEN 'LIVE' ELSE 'NOT_STARTED' END AS status, l_shipdate + to_seconds(l_partkey * 7919 % 86400) AS ts, l_orderkey * 10 + l_linenumber AS tick_id FROM lineitem)"""
STARTS = "(SELECT o_orderkey // 8 AS match_uid, o_orderdate + INTERVAL 60 DAY AS start FROM orders WHERE o_orderkey % 97 <> 0)"
PMF = "(SELECT DISTINCT o_orderkey // 8 AS match_uid, [((o_orderkey // 8) % 7 + 1 + i) / (5.0::DOUBLE * ((o_orderkey // 8) % 7) + 15) FOR i IN range(0, 5)] AS pmf, CASE WHEN (o_orderkey // 8) % 11 > 0 THEN (o_orderkey // 8) % 5 END AS actual_total FROM orders WHERE (o_orderkey // 8) % 13 > 0)"
QUOTES = f"(SELECT * FROM {TICKS} tk WHERE odds > 1 AND status = 'NOT_STARTED')"
CLOSE = f"(SELECT match_uid, max(start) - INTERVAL 900 SECOND AS t FROM {STARTS} st GROUP BY 1)"


def board_sql(quotes: str, times: str) -> str:
    return f"""(SELECT *, CASE WHEN is_main_line THEN nxt - imbalance END AS separation FROM (SELECT *, ok AND row_number() OVER w = 1 AS is_main_line, count(*) FILTER (ok) OVER (PARTITION BY match_uid, book) AS n_two_sided, lead(CASE WHEN ok THEN imbalance END) OVER w AS nxt
FROM (SELECT *, abs(p_over - 0.5) AS imbalance, p_over IS NOT NULL AND live AS ok FROM (
SELECT match_uid, book, points, o.odds AS over_odds, u.odds AS under_odds, (1 / o.odds) / (1 / o.odds + 1 / u.odds) AS p_over, 1 / o.odds + 1 / u.odds AS overround, coalesce(o.active, false) AND coalesce(u.active, false) AS live, coalesce(o.active, false) AS live_over, coalesce(u.active, false) AS live_under,
  (epoch_us(t) - epoch_us(least(o.ts, u.ts))) // 1000000 AS quote_age_s, (epoch_us(t) - epoch_us(greatest(o.ts, u.ts))) // 1000000 AS last_change_s
FROM (SELECT match_uid, book, points, any_value(t) AS t, max({{'ts': ts, 'odds': odds, 'active': active}}) FILTER (side = 'over') AS o, max({{'ts': ts, 'odds': odds, 'active': active}}) FILTER (side = 'under') AS u
  FROM {quotes} q JOIN {times} a USING (match_uid) WHERE ts <= t GROUP BY 1, 2, 3)))
WINDOW w AS (PARTITION BY match_uid, book ORDER BY CASE WHEN ok THEN 0 ELSE 1 END, imbalance NULLS FIRST, points)))"""


def ticks(spark, d):
    l = table(spark, d, "lineitem")
    moment = F.col("l_shipdate") + F.make_dt_interval(secs=(F.col("l_partkey") * 7919 % 86400).cast("decimal(18,6)"))
    return l.select(
        F.expr("l_orderkey div 8").alias("match_uid"), F.get(F.array(*[F.lit(b) for b in ("b0", "b1", "b2", "pinnacle")]), (F.col("l_suppkey") % 4).cast("int")).alias("book"),
        F.when(F.col("l_linenumber") % 3 == 0, 2.0).otherwise(F.lit(1.5) + F.col("l_linenumber") % 3).alias("points"), F.when(F.col("l_partkey") % 2 == 0, "over").otherwise("under").alias("side"),
        F.when(F.col("l_quantity") < 3, 1.0).otherwise(F.round(1 + F.col("l_quantity") / 25, 4)).alias("odds"), (F.col("l_discount") < 0.09).alias("active"),
        F.when(F.col("l_tax") > 0.07, "LIVE").otherwise(P.NOT_STARTED).alias("status"), moment.alias("ts"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tick_id"))


def starts(spark, d):
    return table(spark, d, "orders").where("o_orderkey % 97 <> 0").select(F.expr("o_orderkey div 8").alias("match_uid"), (F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")).alias("start"))


def pmf(spark, d):
    m = F.col("match_uid")
    return (table(spark, d, "orders").select(F.expr("o_orderkey div 8").alias("match_uid")).distinct().where(m % 13 > 0)
            .select("match_uid", F.array(*[(m % 7 + 1 + i) / (5.0 * (m % 7) + 15) for i in range(5)]).alias("pmf"), F.when(m % 11 > 0, m % 5).alias("actual_total")))


def close_board(spark, d):
    t = ticks(spark, d)
    return P.board_at(t, P.anchor("close", t, starts(spark, d)))


ROUNDED = ("p_over", "overround", "imbalance", "separation")
BOARD_COLUMNS = ["match_uid", "book", "points", "over_odds", "under_odds", "p_over", "overround", "imbalance", "live", "live_over", "live_under", "quote_age_s", "last_change_s", "is_main_line", "n_two_sided", "separation"]


#: Nullable booleans are returned as 0 and 1.
FLAGS = ("over_won", "won")


def rounded_sql(columns, rounded=ROUNDED, digits: int = 9) -> str:
    """Rounded columns, without the sign that a zero may carry."""
    def one(c: str) -> str:
        return f"CASE WHEN round({c}, {digits}) = 0 THEN 0.0 ELSE round({c}, {digits}) END::DOUBLE AS {c}" if c in rounded else f"{c}::INT AS {c}" if c in FLAGS else c
    return ", ".join(map(one, columns))


def rounded(df, columns, rounded=ROUNDED, digits: int = 9):
    def one(c: str):
        r = F.round(c, digits)
        return F.when(r == 0, F.lit(0.0)).otherwise(r).alias(c) if c in rounded else F.col(c).cast("int").alias(c) if c in FLAGS else F.col(c)
    return df.select(*map(one, columns))


@query(f"SELECT {rounded_sql(BOARD_COLUMNS)} FROM {board_sql(QUOTES, CLOSE)} b")
def board_at(spark, d):
    return rounded(close_board(spark, d), BOARD_COLUMNS)


@query(f"SELECT match_uid, book, points, round(imbalance, 9) AS imbalance, round(separation, 9) AS separation, n_two_sided FROM {board_sql(QUOTES, CLOSE)} b WHERE is_main_line")
def main_line_pick(spark, d):
    return rounded(close_board(spark, d).where("is_main_line"), ["match_uid", "book", "points", "imbalance", "separation", "n_two_sided"])


@query(f"""WITH m AS (SELECT * FROM {board_sql(QUOTES, CLOSE)} b WHERE is_main_line), c AS (SELECT match_uid, count(DISTINCT book) AS n_books_live, max(points) - min(points) AS line_spread FROM m GROUP BY 1)
SELECT match_uid, points, count(DISTINCT book) AS n_books_on_line, string_agg(DISTINCT book, '+' ORDER BY book) AS books, any_value(n_books_live) AS n_books_live, any_value(line_spread) AS line_spread FROM m JOIN c USING (match_uid) GROUP BY 1, 2""")
def main_line_support(spark, d):
    return P.main_line_support(close_board(spark, d)).withColumn("books", F.array_join("books", "+"))


def formed_sql(quotes: str, n: int) -> str:
    return f"""(WITH r AS (SELECT *, coalesce(last_value(CASE WHEN side = 'over' THEN active END IGNORE NULLS) OVER w, false) AND coalesce(last_value(CASE WHEN side = 'under' THEN active END IGNORE NULLS) OVER w, false) AS live FROM {quotes} q WHERE book <> 'pinnacle' WINDOW w AS (PARTITION BY match_uid, book, points ORDER BY ts, tick_id)),
x AS (SELECT match_uid, book, ts, sum(step) AS step FROM (SELECT *, live::INT - coalesce(lag(live) OVER (PARTITION BY match_uid, book, points ORDER BY ts, tick_id), false)::INT AS step FROM r) WHERE step <> 0 GROUP BY 1, 2, 3),
k AS (SELECT match_uid, book, ts, (sum(step) OVER (PARTITION BY match_uid, book ORDER BY ts) > 0)::INT AS ready FROM x),
u AS (SELECT match_uid, ts, sum(up) AS up FROM (SELECT *, ready - coalesce(lag(ready) OVER (PARTITION BY match_uid, book ORDER BY ts), 0) AS up FROM k) WHERE up <> 0 GROUP BY 1, 2)
SELECT match_uid, min(ts) AS t FROM (SELECT *, sum(up) OVER (PARTITION BY match_uid ORDER BY ts) AS n FROM u) WHERE n >= {n} GROUP BY 1)"""


@query(" UNION ALL ".join(f"SELECT '{n}' AS anchor, match_uid, t FROM {s} a" for n, s in (("open", formed_sql(QUOTES, 1)), ("formed2", formed_sql(QUOTES, 2)), ("close", CLOSE), ("offset24", f"(SELECT match_uid, max(start) - INTERVAL 24 HOUR AS t FROM {STARTS} st GROUP BY 1)"))))
def entry_anchors(spark, d):
    t, s = ticks(spark, d), starts(spark, d)
    out = None
    for name in ("open", "formed2", "close", "offset24"):
        part = P.anchor(name, t, s).select(F.lit(name).alias("anchor"), "match_uid", "t")
        out = part if out is None else out.unionByName(part)
    return out


PRICED = """(SELECT *, model_p_over - 1 / over_odds AS edge_over, model_p_under - 1 / under_odds AS edge_under, model_p_over - p_over AS edge_novig_over, model_p_under - (1 - p_over) AS edge_novig_under FROM (
SELECT *, 1 - list_sum(pmf[1:floor(points)::INT + 1]) AS model_p_over, list_sum(pmf[1:floor(points)::INT + 1]) - p_push AS model_p_under FROM (
SELECT b.*, pmf, actual_total, CASE WHEN points = floor(points) THEN pmf[points::INT + 1] ELSE 0 END AS p_push, points - max(CASE WHEN is_main_line THEN points END) OVER (PARTITION BY b.match_uid, book) AS line_offset FROM {board} b JOIN {pmf} m ON b.match_uid = m.match_uid WHERE floor(points) BETWEEN 0 AND 4)))"""
SETTLED = """(SELECT *, actual_total = points AS is_push, CASE WHEN actual_total <> points THEN actual_total > points END AS over_won, CASE WHEN actual_total = points THEN 0 WHEN actual_total > points THEN over_odds - 1 ELSE -1 END::DOUBLE AS pnl_over,
CASE WHEN actual_total = points THEN 0 WHEN actual_total < points THEN under_odds - 1 ELSE -1 END::DOUBLE AS pnl_under FROM {priced} p WHERE actual_total IS NOT NULL)"""
CLOSE_PRICED = PRICED.format(board=board_sql(QUOTES, CLOSE), pmf=PMF)
CLOSE_SETTLED = SETTLED.format(priced=CLOSE_PRICED)
CHANCES = ("p_push", "model_p_over", "model_p_under", "edge_over", "edge_under", "edge_novig_over", "edge_novig_under")
KEYS = ["match_uid", "book", "points"]


@query(f"SELECT {rounded_sql([*KEYS, *CHANCES], CHANCES)} FROM {CLOSE_PRICED} p")
def ledger_price(spark, d):
    return rounded(G.price(close_board(spark, d), pmf(spark, d)), [*KEYS, *CHANCES], CHANCES)


@query(f"SELECT {rounded_sql([*KEYS, 'is_push', 'over_won', 'pnl_over', 'pnl_under'], ('pnl_over', 'pnl_under'))} FROM {CLOSE_SETTLED} s")
def ledger_settle(spark, d):
    return rounded(G.settle(G.price(close_board(spark, d), pmf(spark, d)), pmf(spark, d)), [*KEYS, "is_push", "over_won", "pnl_over", "pnl_under"], ("pnl_over", "pnl_under"))


BET = ["side", "odds", "model_p", "edge", "edge_novig", "pnl"]


@query(f"""WITH s AS (SELECT *, edge_over IS NOT NULL AND live_over AS ov, edge_under IS NOT NULL AND live_under AS un FROM {CLOSE_SETTLED} s WHERE book <> 'pinnacle'),
t AS (SELECT *, CASE WHEN ov AND un THEN edge_over >= edge_under ELSE ov END AS take FROM s WHERE ov OR un),
b AS (SELECT match_uid, book, points, CASE WHEN take THEN 'over' ELSE 'under' END AS side, CASE WHEN take THEN over_odds ELSE under_odds END AS odds, CASE WHEN take THEN model_p_over ELSE model_p_under END AS model_p, greatest(edge_over, edge_under) AS edge,
CASE WHEN take THEN edge_novig_over ELSE edge_novig_under END AS edge_novig, CASE WHEN take THEN pnl_over ELSE pnl_under END AS pnl FROM t)
SELECT {rounded_sql([*KEYS, *BET], BET[2:])} FROM b WHERE odds IS NOT NULL AND edge >= 0.02""")
def ledger_bets(spark, d):
    return rounded(G.bets(G.settle(G.price(close_board(spark, d), pmf(spark, d)), pmf(spark, d)), 0.02), [*KEYS, *BET], BET[2:])


def sides_sql(settled: str) -> str:
    one = "SELECT match_uid, book, points, is_main_line, line_offset, p_push, actual_total, is_push, '{s}' AS side, {s}_odds AS odds, model_p_{s} AS model_p, edge_{s} AS edge, edge_novig_{s} AS edge_novig, pnl_{s} AS pnl, {won} AS won, live_{s} AS live_side, list_sum([i * pmf[i + 1] FOR i IN range(0, 5)]) AS expected_total FROM "
    return "(" + " UNION ALL ".join(one.format(s=s, won=w) + f"{settled} z" for s, w in (("over", "over_won"), ("under", "NOT over_won"))) + ")"


LEDGER = ["match_uid", "book", "points", "side", "anchor", "market", "role", "schema_version", "is_main_line", "line_offset", "p_push", "actual_total", "is_push", "odds", "model_p", "edge", "edge_novig", "pnl", "won", "live_side", "expected_total", "mean_covers", "p_ref_close", "clv"]
LEDGER_ROUNDED = ("p_push", "model_p", "edge", "edge_novig", "pnl", "expected_total", "p_ref_close", "clv")
ENTRY = f"(SELECT * FROM {QUOTES} e WHERE book <> 'pinnacle')"
MODELLED = f"(SELECT * FROM {QUOTES} e WHERE match_uid IN (SELECT match_uid FROM {PMF} z))"


def ledger_sql() -> str:
    parts = []
    for name, times in (("open", formed_sql(QUOTES, 1)), ("formed2", formed_sql(QUOTES, 2)), ("close", CLOSE)):
        settled = SETTLED.format(priced=PRICED.format(board=board_sql(ENTRY, times), pmf=PMF))
        parts.append(f"SELECT *, '{name}' AS anchor FROM {sides_sql(settled)} y")
    reference = board_sql(f"(SELECT * FROM {QUOTES} e WHERE book = 'pinnacle')", CLOSE)
    return f"""WITH l AS ({' UNION ALL '.join(parts)}), r AS (SELECT match_uid, points, p_over AS ref FROM {reference} b WHERE p_over IS NOT NULL),
j AS (SELECT l.*, CASE WHEN side = 'over' THEN ref ELSE 1 - ref END AS p_ref_close, CASE WHEN side = 'over' THEN expected_total > l.points ELSE expected_total < l.points END AS mean_covers, 'total_games' AS market, 'entry' AS role, 1 AS schema_version FROM l LEFT JOIN r ON l.match_uid = r.match_uid AND l.points = r.points),
c AS (SELECT *, p_ref_close - 1 / odds AS clv FROM j) SELECT {rounded_sql(LEDGER, LEDGER_ROUNDED)} FROM c"""


@query(ledger_sql())
def ledger_build(spark, d):
    return rounded(G.build_ledger(ticks(spark, d), starts(spark, d), pmf(spark, d)), LEDGER, LEDGER_ROUNDED)


CLOSE_ROWS = f"(SELECT * FROM ({ledger_sql()}) l WHERE anchor = 'close' AND odds IS NOT NULL)"


def close_rows(spark, d):
    """Rounded, as sums of fractions on a band's end would fall to either side."""
    return rounded(G.build_ledger(ticks(spark, d), starts(spark, d), pmf(spark, d), anchors=("close",)), LEDGER, LEDGER_ROUNDED).where("odds IS NOT NULL")


GATED = "FILTER (edge >= 0.02)"


@query(f"""SELECT side, count(*) AS n, count(*) {GATED} AS n_gated, round(avg(won::INT) {GATED}, 6) AS hit_rate, round(avg(pnl) {GATED}, 6) AS roi, round(sum(pnl) {GATED}, 4) AS units_gated, round(sum(pnl), 4) AS units_all,
round(avg(edge) {GATED}, 6) AS avg_edge, round(avg(clv) {GATED}, 6) AS avg_clv, round(avg((clv > 0)::INT) {GATED}, 6) AS clv_pos_rate, count(clv) {GATED} AS n_clv FROM {CLOSE_ROWS} c GROUP BY 1""")
def policy_statistics(spark, d):
    out = close_rows(spark, d).groupBy("side").agg(*B.bet_metrics(0.02))
    return out.withColumns({c: F.round(c, 4 if c.startswith("units") else 6) for c in ("hit_rate", "roi", "units_gated", "units_all", "avg_edge", "avg_clv", "clv_pos_rate")})


@query(f"""WITH b AS (SELECT unnest([{", ".join(f"{{'band': '{n}', 'lo': {lo}, 'hi': {hi}}}" for n, lo, hi in B.EDGE_BANDS)}], recursive := true))
SELECT band, count(*) AS n, round(avg(won::INT), 6) AS hit_rate, round(avg(pnl), 6) AS roi, round(sum(pnl), 4) AS units, round(avg(edge), 6) AS avg_edge FROM {CLOSE_ROWS} c JOIN b ON edge >= lo AND edge < hi GROUP BY 1""")
def edge_band_curve(spark, d):
    return B.band_curve(close_rows(spark, d)).withColumns({c: F.round(c, 4 if c == "units" else 6) for c in ("hit_rate", "roi", "units", "avg_edge")})


SNAPS = """(SELECT l_orderkey // 8 AS match_uid, ['b0', 'b1', 'b2'][l_suppkey % 3 + 1] AS book, CASE WHEN l_partkey % 2 = 0 THEN 'p' || (l_orderkey // 8) ELSE 'q' || (l_orderkey // 8) END AS player_id, round(1.1 + l_quantity / 10, 4)::DOUBLE AS odds, CASE WHEN l_tax > 0.07 THEN 'LIVE' ELSE 'NOT_STARTED' END AS status,
l_shipdate + to_seconds(l_partkey * 7919 % 86400) AS at_, l_orderkey * 10 + l_linenumber AS tick_id FROM lineitem)"""
PREDS = "(SELECT DISTINCT o_orderkey // 8 AS match_uid, 'p' || (o_orderkey // 8) AS p1_id, 'q' || (o_orderkey // 8) AS p2_id, ((o_orderkey // 8) % 19 + 1) / 20.0::DOUBLE AS p1, 1 - ((o_orderkey // 8) % 19 + 1) / 20.0::DOUBLE AS p2 FROM orders)"
BETS = "(SELECT o_orderkey // 8 AS match_uid, CASE WHEN o_orderkey // 8 % 2 = 0 THEN 'P1' ELSE 'P2' END AS bet_side, round(1.5 + (o_orderkey // 8) % 30 / 10.0, 4)::DOUBLE AS bet_odds, max(o_orderdate) + INTERVAL 30 DAY AS placed_at FROM orders WHERE o_orderkey // 8 % 3 = 0 GROUP BY 1)"
SIDED = ("best_closing_odds", "worst_closing_odds", "avg_closing_odds", "best_intraday_odds", "worst_intraday_odds", "best_opening_odds")
ANALYSED = ["pred_side", "pred_prob", "result", "status", *[f"{c}_{s}" for c in SIDED for s in ("p1", "p2")], "pred_odds_open", "model_edge_best_close", "model_edge_avg_close", "model_edge_open", "bet_side", "bet_odds", "bet_edge_open", "clv_vs_best", "clv_vs_worst", "clv_vs_avg", "market_avg_at_bet", "market_range_at_bet", "n_books_at_bet", "bet_vs_market_at_bet", "first_live_at"]
EXACT = {"pred_side", "result", "status", "bet_side", "n_books_at_bet", "first_live_at"}


ANALYSIS_SQL = f"""WITH s AS {SNAPS}, p AS {PREDS}, b AS {BETS}, c AS (SELECT match_uid, player_id, book, min_by(odds, (at_, tick_id)) AS o, max_by(odds, (at_, tick_id)) AS c, min(odds) AS lo, max(odds) AS hi FROM s WHERE status = 'NOT_STARTED' GROUP BY 1, 2, 3),
x AS (SELECT match_uid, player_id, max(c) AS best_closing_odds, min(c) AS worst_closing_odds, avg(c) AS avg_closing_odds, max(hi) AS best_intraday_odds, min(lo) AS worst_intraday_odds, max(o) AS best_opening_odds FROM c GROUP BY 1, 2),
w AS (SELECT p.*, CASE WHEN p1 > 0.5 THEN 'P1' ELSE 'P2' END AS pred_side, greatest(p1, p2) AS pred_prob, CASE WHEN p.match_uid % 7 = 0 THEN NULL WHEN p.match_uid % 5 < 3 THEN 'P1' ELSE 'P2' END AS result, {", ".join(f"{s}.{c} AS {c}_{s2}" for c in SIDED for s, s2 in (("u", "p1"), ("v", "p2")))}, bet_side, bet_odds, placed_at
  FROM p LEFT JOIN x u ON u.match_uid = p.match_uid AND u.player_id = p1_id LEFT JOIN x v ON v.match_uid = p.match_uid AND v.player_id = p2_id LEFT JOIN b ON b.match_uid = p.match_uid),
k AS (SELECT *, {", ".join(f"CASE bet_side WHEN 'P1' THEN {c}_p1 WHEN 'P2' THEN {c}_p2 END AS bet_{c}, CASE pred_side WHEN 'P1' THEN {c}_p1 ELSE {c}_p2 END AS pred_{c}" for c in SIDED)} FROM w),
n AS (SELECT match_uid, avg(odds) AS a, max(odds) - min(odds) AS r, count(*) AS n FROM (SELECT s.*, row_number() OVER (PARTITION BY s.match_uid, book ORDER BY abs(epoch_us(at_) - epoch_us(placed_at)), at_, odds) AS rk FROM s JOIN k ON k.match_uid = s.match_uid AND s.player_id = CASE bet_side WHEN 'P1' THEN p1_id ELSE p2_id END
  WHERE s.status = 'NOT_STARTED' AND abs(epoch_us(at_) - epoch_us(placed_at)) <= 86400000000) WHERE rk = 1 GROUP BY 1),
z AS (SELECT match_uid, max(at_) FILTER (status = 'NOT_STARTED') AS last FROM s GROUP BY 1), f AS (SELECT s.match_uid, min(at_) AS first_live_at FROM s JOIN z USING (match_uid) WHERE status <> 'NOT_STARTED' AND (last IS NULL OR at_ > last) GROUP BY 1),
t AS (SELECT k.*, CASE WHEN result IS NULL THEN 'pending' ELSE 'resolved' END AS status, pred_best_opening_odds AS pred_odds_open, pred_prob - 1 / pred_best_closing_odds AS model_edge_best_close, pred_prob - 1 / pred_avg_closing_odds AS model_edge_avg_close, pred_prob - 1 / pred_best_opening_odds AS model_edge_open,
  CASE bet_side WHEN 'P1' THEN p1 WHEN 'P2' THEN p2 END - 1 / bet_best_opening_odds AS bet_edge_open, (bet_odds - bet_best_closing_odds) / bet_best_closing_odds AS clv_vs_best, (bet_odds - bet_worst_closing_odds) / bet_worst_closing_odds AS clv_vs_worst, (bet_odds - bet_avg_closing_odds) / bet_avg_closing_odds AS clv_vs_avg,
  a AS market_avg_at_bet, r AS market_range_at_bet, n AS n_books_at_bet, (bet_odds - a) / a AS bet_vs_market_at_bet, first_live_at FROM k LEFT JOIN n ON n.match_uid = k.match_uid LEFT JOIN f ON f.match_uid = k.match_uid)
SELECT match_uid, {rounded_sql(ANALYSED, set(ANALYSED) - EXACT, 6)} FROM t"""


@query(ANALYSIS_SQL)
def analysis_dataset(spark, d):
    l, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    m, k = F.expr("l_orderkey div 8"), F.expr("o_orderkey div 8")
    snapshots = l.select(
        m.alias("match_uid"), F.get(F.array(*[F.lit(b) for b in ("b0", "b1", "b2")]), (F.col("l_suppkey") % 3).cast("int")).alias("book"), F.concat(F.when(F.col("l_partkey") % 2 == 0, "p").otherwise("q"), m.cast("string")).alias("player_id"), F.round(1.1 + F.col("l_quantity") / 10, 4).alias("odds"),
        F.when(F.col("l_tax") > 0.07, "LIVE").otherwise(P.NOT_STARTED).alias("status"), (F.col("l_shipdate") + F.make_dt_interval(secs=(F.col("l_partkey") * 7919 % 86400).cast("decimal(18,6)"))).alias("at"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tick_id"))
    u = F.col("match_uid")
    ids = o.select(k.alias("match_uid")).distinct()
    predictions = ids.select("match_uid", F.concat(F.lit("p"), u.cast("string")).alias("p1_id"), F.concat(F.lit("q"), u.cast("string")).alias("p2_id"), ((u % 19 + 1) / 20).alias("p1_win_prob"), (1 - (u % 19 + 1) / 20).alias("p2_win_prob"))
    results = ids.select("match_uid", F.when(u % 7 > 0, F.concat(F.when(u % 5 < 3, "p").otherwise("q"), u.cast("string"))).alias("winner_id"))
    bets = o.groupBy(k.alias("match_uid")).agg(F.max("o_orderdate").alias("_d")).where(u % 3 == 0).select("match_uid", F.when(u % 2 == 0, "P1").otherwise("P2").alias("bet_side"), F.round(1.5 + u % 30 / 10, 4).alias("bet_odds"), (F.col("_d") + F.expr("INTERVAL 30 DAYS")).alias("placed_at"))
    return rounded(N.analysis_dataset(predictions, results, snapshots, bets, ["b0", "b1", "b2"]), ["match_uid", *ANALYSED], set(ANALYSED) - EXACT, 6)


def _in_band(name: str, low, high) -> str:
    if name.startswith("neg"):
        return f"e <= {high}" + (f" AND e > {low}" if low is not None else "")
    return (f"e > {low}" if low == 0 else f"e >= {low}") + (f" AND e < {high}" if high is not None else "")


@query(f"""WITH a AS ({ANALYSIS_SQL}), r AS (SELECT *, pred_side = result AS won, CASE pred_side WHEN 'P1' THEN best_closing_odds_p1 ELSE best_closing_odds_p2 END AS close_odds, CASE pred_side WHEN 'P1' THEN best_intraday_odds_p1 ELSE best_intraday_odds_p2 END AS intra, match_uid % 3 AS circuit FROM a WHERE status = 'resolved'),
b AS (SELECT won, pred_side, circuit, '_open' AS suffix, pred_odds_open AS odds, model_edge_open AS e FROM r UNION ALL SELECT won, pred_side, circuit, '', close_odds, model_edge_best_close FROM r),
s AS ({" UNION ALL ".join(f"SELECT '{n}' || suffix AS scenario, won, pred_side, circuit, odds FROM b WHERE {_in_band(n, lo, hi)}" for n, lo, hi in N.BANDS)} UNION ALL SELECT 'flat_best_close', won, pred_side, circuit, close_odds FROM r UNION ALL SELECT 'flat_best_intraday', won, pred_side, circuit, intra FROM r UNION ALL SELECT 'sure', won, pred_side, circuit, close_odds FROM r WHERE pred_prob >= 0.8),
g AS (SELECT scenario, won, odds, unnest(['overall', 'pred_side', 'circuit']) AS segment, unnest(['all', pred_side, circuit::VARCHAR]) AS value FROM s WHERE odds IS NOT NULL)
SELECT scenario, segment, value, count(*) AS n_bets, count(*) FILTER (won) AS n_wins, round(coalesce(sum(odds) FILTER (won), 0), 4) AS total_returned, round((coalesce(sum(odds) FILTER (won), 0) - count(*)) / count(*), 5) AS roi FROM g GROUP BY 1, 2, 3""")
def scenario_grid(spark, d):
    rows = analysis_dataset(spark, d).where("status = 'resolved'").withColumns({"model_correct": F.col("pred_side") == F.col("result"), "circuit": F.col("match_uid") % 3, "close_odds": N._pick(F.col("pred_side"), "best_closing_odds"), "intra": N._pick(F.col("pred_side"), "best_intraday_odds")})
    out = N.scenario_grid(rows, {"open": ("pred_odds_open", "model_edge_open"), "": ("close_odds", "model_edge_best_close")}, {"flat_best_close": "close_odds", "flat_best_intraday": "intra"}, {"sure": (F.col("pred_prob") >= 0.8, "close_odds")}, ["pred_side", "circuit"])
    return out.select("scenario", "segment", "value", "n_bets", "n_wins", F.round("total_returned", 4).alias("total_returned"), F.round("roi", 5).alias("roi"))
