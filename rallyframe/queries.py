"""Queries over the driver's tables, one for each operator, with equal SQL.

Roles: user_id is a player, ts the time of a match, value a statistic and
event_id the tie-break; orders and their lines stand for matches and points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalars as S
from .functions import windows as W
from .operators import aggregates as A
from .operators import evaluate as V
from .operators import integrate as I
from .operators import joins as J
from .operators import prices as P
from .operators import ratings as R
from .operators import reports as B
from .operators import reshape as H
from .operators.markov import project
from .plans import filters as L
from .plans.planner import FeatureEngine
from .plans.registry import Registry
from .sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn
    return add


def r6(c, name: str):
    return F.round(c, 6).alias(name)


USER = W.Over(("user_id",), "ts", ("event_id",))
#: Values of error events count as missing, so that null rules are met.
MISSING = "CASE WHEN event_type = 'error' THEN NULL ELSE value END"


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def with_missing(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).withColumn("x", F.expr(MISSING))


ROLL = "OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)"
PRIOR = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
SEQ = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"


# Windows ---------------------------------------------------------------------

@query(f"SELECT event_id, user_id, round(coalesce(sum(value) {ROLL}, 0), 6) AS rolling_sum FROM events")
def rolling_sum_left(spark, d):
    return events(spark, d).select("event_id", "user_id", r6(W.rolling_sum(F.col("value"), USER, 7), "rolling_sum"))


@query(f"SELECT event_id, user_id, count(*) {ROLL} AS rolling_count FROM events")
def rolling_count_left(spark, d):
    return events(spark, d).select("event_id", "user_id", W.rolling_count(USER, 7).alias("rolling_count"))


@query(f"SELECT event_id, round(avg(x) {ROLL}, 6) AS rolling_mean FROM (SELECT *, {MISSING} AS x FROM events)")
def rolling_mean_left(spark, d):
    return with_missing(spark, d).select("event_id", r6(W.rolling_mean(F.col("x"), USER, 7), "rolling_mean"))


@query(f"SELECT event_id, max(x) {ROLL} AS rolling_max FROM (SELECT *, {MISSING} AS x FROM events)")
def rolling_max_left(spark, d):
    return with_missing(spark, d).select("event_id", W.rolling_max(F.col("x"), USER, 7).alias("rolling_max"))


@query(f"SELECT event_id, round(stddev_samp(x) {ROLL}, 5) AS rolling_std FROM (SELECT *, {MISSING} AS x FROM events)")
def rolling_std_left(spark, d):
    return with_missing(spark, d).select("event_id", F.round(W.rolling_std(F.col("x"), USER, 7), 5).alias("rolling_std"))


@query("""SELECT event_id, round(sum(value) OVER w, 6) AS same_day_sum, round(stddev_samp(value) OVER w, 5) AS same_day_std FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(date_trunc('day', ts)) + event_id % 1000 RANGE BETWEEN 604801000000 PRECEDING AND 1 PRECEDING)""")
def rolling_same_day(spark, d):
    df = events(spark, d).withColumn("day", F.date_trunc("day", "ts")).withColumn("place", F.col("event_id") % 1000)
    over = W.Over(("user_id",), "day")
    return df.select("event_id", r6(W.same_day_sum(F.col("value"), over, 7, "place"), "same_day_sum"), F.round(W.same_day_std(F.col("value"), over, 7, "place"), 5).alias("same_day_std"))


@query(f"SELECT event_id, round(sum(x) {PRIOR}, 6) AS prior_sum, count(*) {PRIOR} AS prior_count, round(avg(x) {PRIOR}, 9) AS prior_mean, round(stddev_samp(x) {PRIOR}, 5) AS prior_std, max(x) {PRIOR} AS prior_max FROM (SELECT *, {MISSING} AS x FROM events)")
def cumulative_prior(spark, d):
    x = F.col("x")
    return with_missing(spark, d).select("event_id", r6(F.sum(x).over(USER.before()), "prior_sum"), W.cumulative_count(USER).alias("prior_count"), F.round(W.cumulative_mean(x, USER), 9).alias("prior_mean"), F.round(W.cumulative_std(x, USER), 5).alias("prior_std"), W.cumulative_max(x, USER).alias("prior_max"))


@query(f"SELECT event_id, round(s, 6) AS carried, round(coalesce(s, 0), 6) AS carried_filled FROM (SELECT event_id, CASE WHEN lag(x) {SEQ} IS NULL THEN NULL ELSE sum(x) {PRIOR} END AS s FROM (SELECT *, {MISSING} AS x FROM events))")
def cumsum_shift_null_carry(spark, d):
    x = F.col("x")
    return with_missing(spark, d).select("event_id", r6(W.cumulative_sum(x, USER), "carried"), r6(W.cumulative_sum(x, USER, 0.0), "carried_filled"))


def returns(spark, d):
    """Lines as trials, returned lines as successes, by customer and time."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_returnflag") == "R").cast("int").alias("num"))
    return lines.join(orders, "o_orderkey").groupBy("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority").agg(F.sum("num").alias("num"), F.count(F.lit(1)).alias("den"))


RETURNS = "(SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority, sum((l_returnflag = 'R')::INT) AS num, count(*) AS den FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"
CUST = W.Over(("o_custkey",), "o_orderdate", ("o_orderkey",))
YEAR = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 365 DAY PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)"


@query(f"SELECT o_orderkey, round(CASE WHEN d > 0 THEN n / d END, 6) AS ratio FROM (SELECT o_orderkey, sum(num) {YEAR} AS n, sum(den) {YEAR} AS d FROM {RETURNS})")
def ratio_raw(spark, d):
    df = returns(spark, d)
    return df.select("o_orderkey", r6(W.shrunk_ratio(W.rolling_sum(F.col("num"), CUST, 365, None), W.rolling_sum(F.col("den"), CUST, 365, None)), "ratio"))


@query(f"SELECT o_orderkey, round(CASE WHEN d > 0 THEN (n + 20 * m) / (d + 20) END, 6) AS ratio FROM (SELECT o_orderkey, sum(num) {YEAR} AS n, sum(den) {YEAR} AS d FROM {RETURNS}), (SELECT sum((l_returnflag = 'R')::INT) / count(*) AS m FROM lineitem JOIN orders ON l_orderkey = o_orderkey)")
def ratio_eb_shrunk(spark, d):
    df = returns(spark, d)
    m = W.pooled_ratio(df, "num", "den")
    n, den = (W.rolling_sum(F.col(c), CUST, 365, None) for c in ("num", "den"))
    return df.select("o_orderkey", n.alias("n"), den.alias("d")).join(F.broadcast(m)).select("o_orderkey", r6(W.shrunk_ratio(F.col("n"), F.col("d"), 20.0, F.col("pooled")), "ratio"))


@query(f"""WITH r AS {RETURNS}, p AS (SELECT o_orderpriority, sum(num) / sum(den) AS m FROM r WHERE o_orderpriority < '4' GROUP BY 1), e AS (SELECT sum(num) / sum(den) AS every FROM r WHERE o_orderpriority < '4'),
w AS (SELECT o_orderkey, o_orderpriority, sum(num) OVER x AS n, sum(den) OVER x AS d FROM r WINDOW x AS (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT o_orderkey, round(CASE WHEN d > 0 THEN (n + 5 * coalesce(m, every)) / (d + 5) END, 6) AS ratio FROM w LEFT JOIN p USING (o_orderpriority), e""")
def ratio_stratum_shrunk(spark, d):
    """Two strata lack a ratio of their own and take the overall one."""
    df = returns(spark, d)
    over = W.Over(("o_custkey", "o_orderpriority"), "o_orderdate", ("o_orderkey",))
    mine = df.select("o_orderkey", "o_orderpriority", *[F.sum(c).over(over.before()).alias(n) for c, n in (("num", "n"), ("den", "d"))])
    known = df.where("o_orderpriority < '4'")
    return W.with_prior(mine, known, "num", "den", "o_orderpriority").select("o_orderkey", r6(W.shrunk_ratio(F.col("n"), F.col("d"), 5.0, F.col("pooled")), "ratio"))


@query(f"SELECT event_id, round(CASE WHEN d > 0 THEN n / d END, 6) AS rate FROM (SELECT event_id, sum(CASE WHEN x IS NOT NULL THEN x END) {PRIOR} AS n, sum(CASE WHEN x IS NOT NULL THEN value + 1 END) {PRIOR} AS d FROM (SELECT *, {MISSING} AS x FROM events))")
def masked_rate(spark, d):
    return with_missing(spark, d).select("event_id", r6(W.masked_rate(F.col("x"), F.col("value") + 1, USER), "rate"))


@query(f"SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) {PRIOR} AS last_purchase FROM events")
def locf_previous(spark, d):
    return events(spark, d).select("event_id", W.last_known(F.col("value"), F.col("event_type") == "purchase", USER).alias("last_purchase"))


@query(f"SELECT event_id, date_diff('day', (lag(ts) {SEQ})::DATE, ts::DATE)::INT AS days_since FROM events")
def days_since_last(spark, d):
    return events(spark, d).select("event_id", W.days_since_last(USER).alias("days_since"))


@query("SELECT event_id, coalesce(c = event_type AND b <> event_type AND t <= ts + INTERVAL 7 DAY, false) AS pattern FROM (SELECT *, lead(event_type) OVER w AS b, lead(event_type, 2) OVER w AS c, lead(ts, 2) OVER w AS t FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))")
def interleaved_pattern(spark, d):
    return events(spark, d).select("event_id", W.interleaved(F.col("event_type"), USER, 7).alias("pattern"))


@query("SELECT o_orderkey, (dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) - 1)::INT AS round_offset, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey)::INT AS place FROM orders")
def dense_offset(spark, d):
    by = Window.partitionBy("o_custkey")
    return table(spark, d, "orders").select("o_orderkey", (F.dense_rank().over(by.orderBy("o_orderpriority")) - 1).alias("round_offset"), F.row_number().over(by.orderBy(F.desc("o_orderdate"), "o_orderkey")).alias("place"))


@query("""WITH p AS (SELECT ts::DATE AS day, count(value) AS n, sum(value) AS s, sum(value * value) AS q FROM events GROUP BY 1),
pw AS (SELECT day, sum(n) OVER w AS n, sum(s) OVER w AS s, sum(q) OVER w AS q FROM p WINDOW w AS (ORDER BY day RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)),
o AS (SELECT user_id, ts::DATE AS day, count(value) AS n, sum(value) AS s, sum(value * value) AS q FROM events GROUP BY 1, 2),
ow AS (SELECT user_id, day, sum(n) OVER w AS n, sum(s) OVER w AS s, sum(q) OVER w AS q FROM o WINDOW w AS (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)),
z AS (SELECT user_id, day, pw.n - coalesce(ow.n, 0) AS n, pw.s - coalesce(ow.s, 0) AS s, pw.q - coalesce(ow.q, 0) AS q FROM ow JOIN pw USING (day))
SELECT event_id, round(CASE WHEN n >= 2 AND (q - s * s / n) / (n - 1) > 1e-12 THEN (value - s / n) / sqrt((q - s * s / n) / (n - 1)) END, 5) AS loo_z
FROM events e JOIN z ON z.user_id = e.user_id AND z.day = e.ts::DATE""")
def loo_zscore(spark, d):
    return W.leave_one_out_z(events(spark, d).select("event_id", "user_id", "ts", "value"), "user_id", "ts", "value", 7).select("event_id", F.round("loo_z", 5).alias("loo_z"))


@query("""WITH days AS (SELECT DISTINCT ts::DATE AS day FROM events), v AS (SELECT day, list(value ORDER BY value) AS vs FROM days JOIN events ON ts::DATE < day AND ts::DATE >= day - 7 GROUP BY day)
SELECT days.day AS day, vs[floor((len(vs) - 1) * 0.33 + 0.5)::INT + 1] AS quantile FROM days LEFT JOIN v USING (day)""")
def rolling_population_quantile(spark, d):
    return W.rolling_population_quantile(events(spark, d), "ts", "value", 7, 0.33)


@query("""WITH t AS (SELECT user_id, event_type, sum(value) AS total, max((ts, event_id)) AS ended FROM events GROUP BY 1, 2)
SELECT event_id, round(avg(total), 5) AS instance_avg FROM events e LEFT JOIN t ON t.user_id = e.user_id AND t.ended < (e.ts, e.event_id) GROUP BY event_id""")
def instance_average(spark, d):
    return W.instance_average(events(spark, d), F.col("value"), USER, "event_type").select("event_id", F.round("instance_avg", 5).alias("instance_avg"))


@query("SELECT event_id, round(value / nullif(sum(value) OVER (PARTITION BY user_id), 0), 6) AS share, max(value) OVER (PARTITION BY user_id, event_type) AS best FROM events")
def partition_share(spark, d):
    return events(spark, d).select("event_id", r6(F.try_divide("value", F.sum("value").over(USER.whole())), "share"), F.max("value").over(Window.partitionBy("user_id", "event_type")).alias("best"))


@query("SELECT event_id, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS live FROM (SELECT *, CASE WHEN event_type IN ('signup', 'view') THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END AS c FROM events)")
def sweep_concurrency(spark, d):
    change = F.when(F.col("event_type").isin("signup", "view"), 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return events(spark, d).select("event_id", W.concurrency(None, ("user_id",), "ts", change, ("event_id",)).alias("live"))


# Joins -----------------------------------------------------------------------

PAIRS = """(SELECT *, l_orderkey * 1000 + (r - 1) // 2 AS match_uid, (r - 1) % 2 + 1 AS side FROM (
SELECT l_orderkey, l_quantity, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem))"""


def pairs(spark, d):
    """All lines of each order by twos, as the sides of matches; the last line of
    an odd number has no other side."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    placed = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", (F.row_number().over(w) - 1).alias("_r"))
    return placed.select("l_orderkey", (F.col("l_orderkey") * 1000 + F.expr("_r div 2")).alias("match_uid"), (F.col("_r") % 2 + 1).alias("side"), "l_quantity", "l_extendedprice")


@query(f"SELECT a.match_uid, a.side::INT AS side, a.l_quantity, b.l_quantity AS opp_l_quantity, b.l_extendedprice AS opp_l_extendedprice FROM {PAIRS} a LEFT JOIN {PAIRS} b ON a.match_uid = b.match_uid AND a.side <> b.side")
def mirror_self_join(spark, d):
    return J.mirror(pairs(spark, d), "match_uid", "side", ["l_quantity", "l_extendedprice"]).select("match_uid", "side", "l_quantity", "opp_l_quantity", "opp_l_extendedprice")


@query("""SELECT a.event_id, round(sum(w * v) / (sum(w) + 2), 5) AS kernel_mean, round(sum(w) * sum(w) / sum(w * w), 4) AS effective_n, count(*) AS n FROM (
SELECT a.event_id, b.value AS v, exp(-(a.value - b.value) * (a.value - b.value) / 200) * pow(0.5, (epoch_us(a.ts) - epoch_us(b.ts)) / (86400000000.0 * 3)) AS w
FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts < a.ts AND b.ts >= a.ts - INTERVAL 2 DAY) a GROUP BY a.event_id""")
def knn_kernel_range_join(spark, d):
    e = events(spark, d)
    l, r = e.select("event_id", "user_id", "ts", "value"), e.select("user_id", F.col("ts").alias("b_ts"), F.col("value").alias("b_value"))
    gap = F.col("value") - F.col("b_value")
    weight = F.exp(-gap * gap / 200) * S.recency_weight(W.micros(F.col("ts")) - W.micros(F.col("b_ts")), 3.0 * W.DAY)
    return J.kernel_mean(J.range_pairs(l, r, "user_id", "ts", "b_ts", 2), ["event_id"], weight, F.col("b_value"), 2.0).select("event_id", S.rounded(F.col("kernel_mean"), 5).alias("kernel_mean"), S.rounded(F.col("effective_n"), 4).alias("effective_n"), "n")


@query("""SELECT coalesce(a.k, b.k) AS k, coalesce(a.x, b.x) AS x, coalesce(a.y, b.y) AS y FROM
(SELECT o_custkey AS k, CASE WHEN count(*) > 15 THEN floor(sum(o_totalprice) + 0.001)::BIGINT END AS x, max(o_orderdate) AS y FROM orders GROUP BY 1) a FULL JOIN
(SELECT c_custkey AS k, floor(c_acctbal)::BIGINT AS x, NULL::TIMESTAMP AS y FROM customer) b ON a.k = b.k""")
def full_outer_waterfall(spark, d):
    a = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.when(F.count(F.lit(1)) > 15, F.floor(F.sum("o_totalprice") + 0.001).cast("long")).alias("x"), F.max("o_orderdate").alias("y"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.floor("c_acctbal").cast("long").alias("x"), F.lit(None).cast("timestamp_ntz").alias("y"))
    return J.waterfall(a, b, ["k"], ["x", "y"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def semi_collision(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_name").join(table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def anti_gap_fill(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_name").join(table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, a.n_name AS cust_n_name, b.n_name AS supp_n_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation a ON c_nationkey = a.n_nationkey LEFT JOIN nation b ON s_nationkey = b.n_nationkey")
def role_playing_dims(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    cust, supp = table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    both = lines.join(orders, "l_orderkey").join(cust, "c_custkey").join(supp, "l_suppkey")
    out = J.enrich_roles(both, table(spark, d, "nation"), "n_nationkey", {"c_nationkey": "cust_", "s_nationkey": "supp_"}, ["n_name"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "cust_n_name", "supp_n_name")


@query("""SELECT e.event_id, r.value AS asof_value, r.event_id AS asof_event FROM (SELECT * FROM events WHERE event_type <> 'purchase') e
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') r ON e.user_id = r.user_id AND e.ts >= r.ts""")
def asof_backward(spark, d):
    e = events(spark, d)
    left = e.where("event_type <> 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("r_ts"), F.col("value").alias("asof_value"), F.col("event_id").alias("asof_event"))
    return J.asof_backward(left, right, ["user_id"], "ts", "r_ts", ["asof_value", "asof_event"]).select("event_id", "asof_value", "asof_event")


def moments(spark, d):
    """Two moments a user: noon of the 10th and of the 20th."""
    return events(spark, d).select("user_id").distinct().select("user_id", F.explode(F.array(*[F.to_timestamp_ntz(F.lit(f"2024-01-{x} 12:00:00")) for x in (10, 20)])).alias("t"))


MOMENTS = "(SELECT user_id, unnest([TIMESTAMP '2024-01-10 12:00:00', TIMESTAMP '2024-01-20 12:00:00']) AS t FROM (SELECT DISTINCT user_id FROM events))"


@query(f"SELECT user_id, event_type, t, max(ts) AS ts, max_by(value, (ts, event_id)) AS value FROM events JOIN {MOMENTS} m USING (user_id) WHERE ts <= t GROUP BY user_id, event_type, t")
def latest_before(spark, d):
    return J.latest_before(events(spark, d).select("user_id", "event_type", "ts", "event_id", "value"), moments(spark, d), "user_id", "ts", "t", ["event_id", "value"], by=["event_type"]).drop("event_id")


@query(f"""SELECT user_id, t, hours, max_by(value, (ts, value)) AS value, round((epoch_us(t - to_hours(hours)) - epoch_us(max(ts))) / 60000000.0, 4) AS lag_minutes
FROM events JOIN (SELECT user_id, t, unnest([1, 24, 72])::INT AS hours FROM {MOMENTS} q) m USING (user_id) WHERE ts <= t - to_hours(hours) GROUP BY user_id, t, hours""")
def threshold_hours(spark, d):
    out = J.before_anchor(events(spark, d).select("user_id", "ts", "value"), moments(spark, d), "user_id", "ts", "t", [1, 24, 72], "value")
    return out.withColumn("lag_minutes", F.round("lag_minutes", 4))


@query("""SELECT a.event_id, b.event_id AS near_event, b.value AS near_value FROM (SELECT * FROM events WHERE event_type = 'error') a LEFT JOIN (
SELECT event_id, near FROM (SELECT a.event_id, b.event_id AS near, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(epoch_us(a.ts) - epoch_us(b.ts)), b.ts, b.event_id) AS r
FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'purchase' AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 86400000000) WHERE r = 1) m ON a.event_id = m.event_id LEFT JOIN events b ON b.event_id = m.near""")
def nearest_24h(spark, d):
    e = events(spark, d)
    left = e.where("event_type = 'error'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("r_ts"), F.col("event_id").alias("near_event"), F.col("value").alias("near_value"))
    return J.nearest_in_time(left, right, "user_id", "event_id", "ts", "r_ts", ["near_event", "near_value"]).select("event_id", "near_event", "near_value")


@query("""SELECT event_id, match_id FROM (SELECT a.event_id, count(DISTINCT b.event_id) AS n, min(b.event_id) AS match_id FROM events a JOIN events b
ON a.event_type = 'click' AND b.event_type = 'view' AND a.user_id = b.user_id AND floor(a.value / 10) = floor(b.value / 10) AND abs(date_diff('day', a.ts::DATE, b.ts::DATE)) <= 1 GROUP BY 1) WHERE n = 1""")
def resolve_identities(spark, d):
    e = events(spark, d).withColumn("u", F.col("user_id").cast("string")).withColumn("v", F.concat(F.lit("#"), F.floor(F.col("value") / 10).cast("string")))
    clicks = e.where("event_type = 'click'").select("event_id", "u", "v", "ts")
    views = e.where("event_type = 'view'").select(F.col("event_id").alias("match_id"), F.col("v").alias("u"), F.col("u").alias("v"), "ts")
    return J.resolve_pairs(clicks, views, "event_id", "match_id", ("u", "v"), "ts", 1)


@query("""SELECT o_orderkey, o_custkey, o_orderpriority FROM orders p WHERE NOT EXISTS (
SELECT 1 FROM (SELECT o_custkey, date_trunc('month', o_orderdate) AS m, min(o_orderpriority) AS pr FROM orders GROUP BY 1, 2) k WHERE k.o_custkey = p.o_custkey AND k.m = date_trunc('month', p.o_orderdate) AND k.pr <> p.o_orderpriority)""")
def stale_row_filter(spark, d):
    planned = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.date_trunc("month", "o_orderdate").alias("m"), "o_orderpriority")
    known = planned.groupBy("o_custkey", "m").agg(F.min("o_orderpriority").alias("o_orderpriority"))
    return J.stale_rows(planned, known, ["o_custkey", "m"], "o_orderpriority").select("o_orderkey", "o_custkey", "o_orderpriority")


# Aggregations ----------------------------------------------------------------

@query("SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS n_returned, count(*) FILTER (l_linestatus = 'O') AS n_open, count(*) FILTER (l_discount > 0.05) AS n_discounted, bool_or(l_tax = 0) AS any_untaxed, bool_and(l_quantity > 5) AS all_large FROM lineitem GROUP BY 1")
def conditional_agg(spark, d):
    conditions = {"n_returned": F.col("l_returnflag") == "R", "n_open": F.col("l_linestatus") == "O", "n_discounted": F.col("l_discount") > 0.05}
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(*A.counts_if(conditions), F.bool_or(F.col("l_tax") == 0).alias("any_untaxed"), F.bool_and(F.col("l_quantity") > 5).alias("all_large"))


@query("SELECT user_id, round(avg(value) FILTER (event_type = 'click'), 6) AS click_mean, max(value) FILTER (event_type = 'click') AS click_max, round(stddev_samp(value) FILTER (event_type = 'click'), 5) AS click_std, (count(DISTINCT event_type) + max((event_type IS NULL)::INT))::BIGINT AS n_types FROM events GROUP BY 1")
def filtered_stats(spark, d):
    out = events(spark, d).groupBy("user_id").agg(*A.filtered(F.col("value"), F.col("event_type") == "click", ("mean", "max", "std"), "click"), (F.countDistinct("event_type") + F.max(F.col("event_type").isNull().cast("int"))).alias("n_types"))
    return out.withColumns({"click_mean": F.round("click_mean", 6), "click_std": F.round("click_std", 5)})


@query("SELECT user_id, min(value) FILTER (event_type = 'view') AS view, min(value) FILTER (event_type = 'click') AS click, min(value) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY 1")
def eav_pivot(spark, d):
    return A.widen(events(spark, d), ["user_id"], "event_type", "value", ["view", "click", "purchase"])


OPEN_CLOSE = """(SELECT user_id, event_type, min_by(value, (ts, event_id)) AS open, max_by(value, (ts, event_id)) AS close, min(value) AS low, max(value) AS high, count(value) AS n FROM events GROUP BY 1, 2)"""


@query(f"SELECT user_id, event_type, open, close, low, high, n, round(100 * (close - open) / open, 6) AS move_pct, CASE WHEN (close - open) / open > 0.005 THEN 'UP' WHEN (close - open) / open < -0.005 THEN 'DOWN' ELSE 'STABLE' END AS direction FROM {OPEN_CLOSE}")
def open_close(spark, d):
    return A.open_close(events(spark, d), ["user_id", "event_type"], "ts", "value", "event_id").withColumn("move_pct", S.rounded(F.col("move_pct"), 6))


@query(f"SELECT user_id, count(*) AS n_books, min(close) AS worst_close, round(avg(close), 6) AS avg_close, max(close) AS best_close, min(low) AS worst_intraday, max(high) AS best_intraday FROM {OPEN_CLOSE} GROUP BY 1")
def cross_book_rollup(spark, d):
    closes = A.open_close(events(spark, d), ["user_id", "event_type"], "ts", "value", "event_id")
    return A.cross_book(closes, ["user_id"]).withColumn("avg_close", F.round("avg_close", 6))


BUCKETS = "(SELECT k, bucket, max(v) AS best, avg(v) AS mean, count(*) AS n_books FROM (SELECT user_id % 10 AS k, event_type, time_bucket(INTERVAL 15 MINUTE, ts) AS bucket, max_by(value, (ts, event_id)) AS v FROM events GROUP BY 1, 2, 3) GROUP BY 1, 2)"


def buckets(spark, d):
    df = events(spark, d).withColumn("k", F.col("user_id") % 10)
    return A.bucketed(df, ["k"], "event_type", "ts", "value", "event_id")


@query(f"SELECT k, bucket, best, round(mean, 6) AS mean, n_books FROM {BUCKETS}")
def bucket_open_close(spark, d):
    return buckets(spark, d).withColumn("mean", F.round("mean", 6))


@query(f"SELECT k, min(bucket) AS opened, min_by(best, bucket) AS open_best, max_by(best, bucket) AS close_best, round(min_by(mean, bucket), 6) AS open_mean, min(bucket) FILTER (n_books >= 2) AS formed, min_by(best, bucket) FILTER (n_books >= 2) AS formed_best FROM {BUCKETS} GROUP BY 1")
def market_formed(spark, d):
    return A.formation(buckets(spark, d), ["k"]).withColumn("open_mean", F.round("open_mean", 6))


@query("SELECT l_orderkey, min(l_extendedprice) AS low, round(median(l_extendedprice), 6) AS median, max(l_extendedprice) AS high, count(*) AS n_books FROM lineitem WHERE l_quantity <= 30 GROUP BY 1")
def median_lag_cap(spark, d):
    return A.fresh_median(table(spark, d, "lineitem"), ["l_orderkey"], "l_quantity", "l_extendedprice", 30.0).withColumn("median", F.round("median", 6))


CUBE = """(SELECT concat_ws('+', CASE WHEN grouping(l_returnflag) = 0 THEN 'l_returnflag' END, CASE WHEN grouping(l_linestatus) = 0 THEN 'l_linestatus' END, CASE WHEN grouping(l_linenumber) = 0 THEN 'l_linenumber' END) AS slice_dims,
l_returnflag, l_linestatus, l_linenumber, count(*) AS n, ((20000 * sum(round(l_discount * 100)::BIGINT) + count(*)) // (2 * count(*)))::DOUBLE / 1000000 AS rate FROM lineitem
GROUP BY GROUPING SETS ((), (l_returnflag), (l_linestatus), (l_linenumber), (l_returnflag, l_linestatus), (l_returnflag, l_linenumber), (l_linestatus, l_linenumber)) HAVING count(*) >= 25)"""
DIMS = ["l_returnflag", "l_linestatus", "l_linenumber"]


def cube(spark, d):
    """Mean discount by slice, rounded in whole numbers: sums of hundredths are
    exact in any order, where a sum of fractions decides the last digit by chance."""
    lines = table(spark, d, "lineitem").withColumn("_hundredths", F.round(F.col("l_discount") * 100).cast("long"))
    rate = F.expr("cast((20000 * sum(_hundredths) + count(*)) div (2 * count(*)) as double) / 1000000").alias("rate")
    return A.slices(lines, DIMS, [rate], 2, 25)


@query(f"SELECT * FROM {CUBE}")
def cube_slices(spark, d):
    return cube(spark, d)


@query(f"""WITH c AS {CUBE}, e AS (SELECT *, unnest(string_split(slice_dims, '+')) AS parent FROM c WHERE slice_dims LIKE '%+%'),
m AS (SELECT e.*, e.rate - s.rate AS delta FROM e JOIN c s ON s.slice_dims = e.parent AND CASE e.parent WHEN 'l_returnflag' THEN s.l_returnflag = e.l_returnflag WHEN 'l_linestatus' THEN s.l_linestatus = e.l_linestatus ELSE s.l_linenumber = e.l_linenumber END)
SELECT slice_dims, l_returnflag, l_linestatus, l_linenumber, n, rate, round(max_by(delta, (abs(delta), parent)), 6) AS delta, round(abs(max_by(delta, (abs(delta), parent))) * sqrt(n), 5) AS surprise FROM m GROUP BY 1, 2, 3, 4, 5, 6""")
def surprise_vs_parent(spark, d):
    return A.surprises(cube(spark, d), DIMS, "rate").withColumns({"delta": F.round("delta", 6), "surprise": F.round("surprise", 5)})


SCENARIOS = [("big", [("l_quantity", ">=", 40)]), ("cheap", [("l_extendedprice", "<", 20000)]), ("deal", [("l_discount", ">", 0.05), ("l_tax", "<=", 0.04)])]


@query("""WITH s AS (SELECT l_returnflag = 'A' AS won, l_discount * 20 AS r, l_linestatus, l_linenumber, unnest(list_filter([CASE WHEN l_quantity >= 40 THEN 'big' END, CASE WHEN l_extendedprice < 20000 THEN 'cheap' END, CASE WHEN l_discount > 0.05 AND l_tax <= 0.04 THEN 'deal' END], lambda x: x IS NOT NULL)) AS scenario FROM lineitem),
g AS (SELECT won, r, scenario, unnest(['all', 'l_linestatus', 'l_linenumber']) AS segment, unnest(['all', l_linestatus, l_linenumber::VARCHAR]) AS value FROM s)
SELECT scenario, segment, value, count(*) AS n_bets, count(*) FILTER (won) AS n_won, round(sum(r), 4) AS returned, round((sum(r) - count(*)) / count(*), 5) AS roi FROM g GROUP BY 1, 2, 3""")
def scenario_segment_sim(spark, d):
    named = [(n, L.scenario(c)) for n, c in SCENARIOS]
    out = A.simulate(table(spark, d, "lineitem"), named, ["l_linestatus", "l_linenumber"], F.col("l_returnflag") == "A", F.col("l_discount") * 20)
    return out.withColumns({"returned": F.round("returned", 4), "roi": F.round("roi", 5)})


@query("""WITH x AS (SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS x FROM events), g AS (SELECT user_id, CASE WHEN count(x) >= 30 THEN median(x) END AS m FROM x GROUP BY 1)
SELECT event_id, round(coalesce(x, m, (SELECT median(x) FROM x), 0), 6) AS x_imputed FROM x JOIN g USING (user_id)""")
def impute_group_median(spark, d):
    return A.impute_median(with_missing(spark, d).select("event_id", "user_id", "x"), "x", "user_id").select("event_id", F.round("x_imputed", 6).alias("x_imputed"))


@query(f"SELECT 'event_id' AS \"column\", count(*) - count(event_id) AS n_null, count(*) AS n, 100.0::DOUBLE * (count(*) - count(event_id)) / count(*) AS null_pct FROM events UNION ALL SELECT 'x', count(*) - count(x), count(*), round(100.0::DOUBLE * (count(*) - count(x)) / count(*), 6) FROM (SELECT {MISSING} AS x FROM events)")
def coverage_report(spark, d):
    return A.coverage(with_missing(spark, d).select("event_id", "x")).withColumn("null_pct", F.round("null_pct", 6))


@query("SELECT coalesce(o_orderpriority, 'All') AS o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderpriority)")
def totals_breakdown(spark, d):
    return A.rollup_with_total(table(spark, d, "orders"), "o_orderpriority", [F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")])


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS r FROM lineitem) WHERE r <= 2")
def top_per_group(spark, d):
    return A.top_by(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"), ["l_orderkey"], [F.desc("l_extendedprice"), F.col("l_linenumber"), F.col("l_partkey")], 2)


@query("SELECT month, n, round(profit, 6) AS profit, round(sum(profit) OVER (ORDER BY month), 6) AS running FROM (SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n, sum(o_totalprice / 1000) AS profit FROM orders GROUP BY 1)")
def monthly_cumulative(spark, d):
    per = table(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice") / 1000).alias("profit"))
    return per.select("month", "n", F.round("profit", 6).alias("profit"), F.round(F.sum("profit").over(Window.orderBy("month")), 6).alias("running"))


@query("SELECT event_id, CASE WHEN value < 5 THEN 'low' WHEN value < 20 THEN 'mid' WHEN value < 80 THEN 'high' ELSE 'top' END AS band FROM events")
def ordered_bands(spark, d):
    return events(spark, d).select("event_id", S.bands(F.col("value"), [5, 20, 80], ["low", "mid", "high", "top"]).alias("band"))


# Filters and rules -----------------------------------------------------------

@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice >= 50000 AND o_totalprice <= 200000")
def filter_language(spark, d):
    return table(spark, d, "orders").where(L.where({"o_orderstatus": "F", "o_orderpriority": ["1-URGENT", "2-HIGH"], "o_totalprice": {"min": 50_000, "max": 200_000}})).select("o_orderkey")


@query("""SELECT 'hot' AS rule, event_id FROM events WHERE event_type IN ('click', 'view') AND value >= 30 AND event_id % 7 <> 0 UNION ALL SELECT 'odd' AS rule, event_id FROM events WHERE value >= 1 AND value <= 2 AND event_type = 'error'""")
def alert_rules(spark, d):
    e = events(spark, d)
    ledger = e.where("event_id % 7 = 0").select(F.lit("hot").alias("rule"), "event_id")
    return L.first_fires(e, {"hot": {"event_type": ["CLICK", "View"], "value": 30}, "odd": {"value": {"min": 1, "max": 2}, "event_type": "ERROR"}}, "event_id", ledger)


# Reshaping -------------------------------------------------------------------

@query("SELECT o_orderkey, o_custkey AS player_id, o_custkey + 1 AS opp_id, o_totalprice AS player_score, o_totalprice / 2 AS opp_score FROM orders UNION ALL SELECT o_orderkey, o_custkey + 1, o_custkey, o_totalprice / 2, o_totalprice FROM orders")
def perspective_explode(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("p1_id"), F.col("o_totalprice").alias("p1_score"), (F.col("o_custkey") + 1).alias("p2_id"), (F.col("o_totalprice") / 2).alias("p2_score"))
    return H.perspectives(o, "p1_", "p2_")


@query("SELECT l_orderkey, l_linenumber, l_partkey, 'over' AS side, l_quantity AS price FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'under', l_extendedprice FROM lineitem")
def unpivot_sides(spark, d):
    return H.unpivot_sides(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"], {"over": "l_quantity", "under": "l_extendedprice"}, "price")


@query("""WITH c AS (SELECT user_id, least(floor(value / 20), 5)::INT AS k, count(*) AS n FROM events GROUP BY 1, 2), g AS (SELECT user_id, k FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest(range(0, 6))::INT AS k)),
p AS (SELECT g.user_id, g.k, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY g.user_id) AS p FROM g LEFT JOIN c ON g.user_id = c.user_id AND g.k = c.k)
SELECT user_id, k, round(p, 6) AS p, round(sum(p) OVER (PARTITION BY user_id ORDER BY k), 6) AS cum FROM p""")
def pmf_cumulative(spark, d):
    place = F.least(F.floor(F.col("value") / 20), F.lit(5))
    counts = events(spark, d).groupBy("user_id").agg(F.array(*[F.count_if(place == k) for k in range(6)]).alias("c"), F.count(F.lit(1)).alias("n"))
    grid = H.cumulative_pmf(counts.select("user_id", F.transform("c", lambda x: x / F.col("n")).alias("pmf")), "user_id", "pmf")
    return grid.select("user_id", "k", F.round("p", 6).alias("p"), F.round("cum", 6).alias("cum"))


@query("SELECT event_id, (props::JSON ->> 'k')::INT AS k FROM events")
def json_flatten(spark, d):
    return events(spark, d).select("event_id", F.explode(F.from_json("props", "map<string,int>")).alias("key", "k")).drop("key")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_latest(spark, d):
    e = events(spark, d).select("user_id", "event_type", "event_id", "value", "ts")
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    old = A.top_by(e.where(F.col("ts") < cut), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])
    return H.upsert(old, e.where(F.col("ts") >= cut), ["user_id", "event_type"], "ts", "event_id").drop("ts")


# Scalars ---------------------------------------------------------------------

@query("SELECT c_custkey, lower(replace(c_name, '#', ' ')) AS name, trim(regexp_replace(lower(strip_accents('Éric-Müller ' || c_mktsegment)), '[\\s-]+', ' ', 'g')) AS clean FROM customer")
def name_normalise(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.normalise_name(F.translate("c_name", "#", " ")).alias("name"), S.normalise_name(F.concat(F.lit("Éric-Müller "), F.col("c_mktsegment"))).alias("clean"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber AS made, l_quantity::INT AS tried, CASE WHEN l_returnflag <> 'N' THEN (100 * l_linenumber // l_quantity::INT)::INT END AS pct FROM lineitem")
def frac_parse(spark, d):
    q = F.col("l_quantity").cast("int")
    pct = F.when(F.col("l_returnflag") != "N", F.concat(F.lit(" ("), F.floor(100 * F.col("l_linenumber") / q).cast("string"), F.lit("%)"))).otherwise(F.lit(""))
    made, tried, share = S.fraction(F.concat(F.col("l_linenumber").cast("string"), F.lit("/"), q.cast("string"), pct))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", made.alias("made"), tried.alias("tried"), share.alias("pct"))


@query("SELECT o_orderkey, round(pow(0.5, date_diff('day', o_orderdate::DATE, DATE '2001-08-01') / 365.0), 8) AS w FROM orders")
def recency_weight(spark, d):
    age = F.datediff(F.lit("2001-08-01").cast("date"), "o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", F.round(S.recency_weight(age, 365.0), 8).alias("w"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 2.0 WHEN o_totalprice > 200000 THEN 1.5 ELSE 1.0 END::DOUBLE AS w FROM orders")
def first_rule_weight(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.first_rule([(F.col("o_orderstatus") == "P", 2.0), (F.col("o_totalprice") > 200_000, 1.5)], 1.0).alias("w"))


@query("SELECT event_id, round(1 / (1 + pow(10, (50 - value) / 400)), 8) AS expected, round(p*p*p*p * (1 + 4*(1-p) + 10*(1-p)*(1-p)) + 20 * pow(p*(1-p), 3) * p*p / (p*p + (1-p)*(1-p)), 8) AS hold FROM (SELECT *, 0.5 + (event_id % 40) / 100.0::DOUBLE AS p FROM events)")
def rating_math(spark, d):
    p = F.lit(0.5) + (F.col("event_id") % 40) / 100
    return events(spark, d).select("event_id", F.round(S.logistic_expectation(F.col("value"), F.lit(50.0)), 8).alias("expected"), F.round(S.hold_probability(p), 8).alias("hold"))


STAGED = """(SELECT *, min(o_orderdate::DATE) OVER (PARTITION BY tid) AS start_date, (min(o_orderdate::DATE) OVER (PARTITION BY tid) + (tid % 16)::INT)::DATE AS end_date FROM (
SELECT o_orderkey, o_orderdate, o_custkey // 4 AS tid, o_orderstatus AS draw, (substr(o_orderpriority, 1, 1)::INT * 2 - 1) AS round_order, CASE WHEN o_orderkey % 3 > 0 AND (o_custkey // 4) % 3 > 0 THEN o_orderdate + to_hours((o_orderkey % 24)::INT) END AS planned,
['itf', 'chal', 'tour'][(o_custkey // 4) % 3 + 1] AS circuit, CASE WHEN (o_custkey // 4) % 5 = 0 THEN 'GS' ELSE 'T' END AS event_type FROM orders))"""


@query(f"""WITH p AS (SELECT *, coalesce(planned, max(planned) OVER (PARTITION BY tid, draw, round_order)) AS known, dense_rank() OVER (PARTITION BY tid ORDER BY round_order) - 1 AS place, CASE WHEN circuit IN ('itf', 'chal') AND end_date - start_date > 6 THEN 6 ELSE end_date - start_date END AS days FROM {STAGED} s),
q AS (SELECT *, max(place) OVER (PARTITION BY tid) AS last, count(known) OVER (PARTITION BY tid) = count(*) OVER (PARTITION BY tid) AS whole FROM p)
SELECT o_orderkey, CASE WHEN whole THEN known ELSE (start_date + CASE WHEN event_type = 'GS' AND round_order <= 3 THEN round_order - 4 WHEN last > 0 THEN round(place * days::DOUBLE / last)::INT ELSE 0 END)::TIMESTAMP END AS effective_match_date FROM q""")
def effective_date(spark, d):
    tid = F.expr("o_custkey div 4")
    o = table(spark, d, "orders").select(
        "o_orderkey", "o_orderdate", tid.alias("tid"), F.col("o_orderstatus").alias("draw"), (F.substring("o_orderpriority", 1, 1).cast("int") * 2 - 1).alias("round_order"),
        F.when((F.col("o_orderkey") % 3 > 0) & (tid % 3 > 0), F.col("o_orderdate") + F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))).alias("planned"),
        F.get(F.array(F.lit("itf"), F.lit("chal"), F.lit("tour")), (tid % 3).cast("int")).alias("circuit"), F.when(tid % 5 == 0, "GS").otherwise("T").alias("event_type"))
    start = F.min(F.to_date("o_orderdate")).over(Window.partitionBy("tid"))
    staged = o.withColumn("start_date", start).withColumn("end_date", F.date_add("start_date", (F.col("tid") % 16).cast("int")))
    return I.effective_date(staged, ["tid"], "draw", "round_order", "start_date", "end_date", "planned", "circuit", "event_type").select("o_orderkey", "effective_match_date")


@query("""WITH l AS (SELECT user_id, max(ts) FILTER (event_type = 'view') AS last FROM events GROUP BY 1) SELECT user_id, min(ts) AS anchor_at FROM events JOIN l USING (user_id) WHERE event_type <> 'view' AND (last IS NULL OR ts > last) GROUP BY 1""")
def first_live_anchor(spark, d):
    return A.first_live(events(spark, d), "user_id", "ts", "event_type", "view")


@query("""WITH g AS (SELECT o_custkey, o_orderpriority, min(o_orderstatus) AS s FROM orders GROUP BY 1, 2) SELECT o_custkey, count(*) AS n_grains, count(*) FILTER (s = 'F') AS n_done FROM g GROUP BY 1""")
def distinct_sub_grain(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus")
    return A.per_distinct(rows, ["o_custkey"], ["o_orderpriority"], [F.count(F.lit(1)).alias("n_grains"), F.count_if(F.col("o_orderstatus") == "F").alias("n_done")])


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate::DATE <= DATE '1996-06-30'")
def cutoff_filter(spark, d):
    return L.upto(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "1996-06-30", "o_orderdate")


# Prices ----------------------------------------------------------------------

TICKS = "(SELECT l_orderkey AS match_uid, 'b' || (l_suppkey % 3) AS book, (l_linenumber % 4 + 0.5)::DOUBLE AS points, CASE WHEN l_partkey % 2 = 0 THEN 'over' ELSE 'under' END AS side, round(1 + l_quantity / 25, 4) AS price, l_discount < 0.09 AS active, l_shipdate AS ts, l_partkey * 10 + l_linenumber AS tick_id FROM lineitem)"


def ticks(spark, d):
    """Lines as price ticks: an order is a match, its lines quotes of three books."""
    l = table(spark, d, "lineitem")
    return l.select(
        F.col("l_orderkey").alias("match_uid"), F.concat(F.lit("b"), (F.col("l_suppkey") % 3).cast("string")).alias("book"), (F.col("l_linenumber") % 4 + 0.5).cast("double").alias("points"),
        F.when(F.col("l_partkey") % 2 == 0, "over").otherwise("under").alias("side"), F.round(1 + F.col("l_quantity") / 25, 4).alias("price"), (F.col("l_discount") < 0.09).alias("active"), F.col("l_shipdate").alias("ts"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("tick_id"))


@query(f"""WITH t AS (SELECT user_id AS match_uid, event_type AS book, 0.5::DOUBLE AS points, CASE WHEN event_id % 2 = 0 THEN 'over' ELSE 'under' END AS side, event_id % 5 > 0 AS active, ts, event_id AS tick_id FROM events),
s AS (SELECT *, coalesce(last_value(CASE WHEN side = 'over' THEN active END IGNORE NULLS) OVER w, false) AND coalesce(last_value(CASE WHEN side = 'under' THEN active END IGNORE NULLS) OVER w, false) AS live FROM t WINDOW w AS (PARTITION BY match_uid, book, points ORDER BY ts, tick_id)),
m AS (SELECT *, live::INT - coalesce(lag(live) OVER (PARTITION BY match_uid, book, points ORDER BY ts, tick_id), false)::INT AS step FROM s),
b AS (SELECT *, sum(step) OVER (PARTITION BY match_uid ORDER BY ts, tick_id) AS books FROM m)
SELECT match_uid, min(ts) AS formed_at FROM b WHERE books >= 3 GROUP BY 1""")
def formed_sweep(spark, d):
    t = events(spark, d).select(F.col("user_id").alias("match_uid"), F.col("event_type").alias("book"), F.lit(0.5).alias("points"), F.when(F.col("event_id") % 2 == 0, "over").otherwise("under").alias("side"), (F.col("event_id") % 5 > 0).alias("active"), "ts", F.col("event_id").alias("tick_id"))
    return P.formed(t, 3)


@query(f"SELECT match_uid, tick_id, price, round(CASE WHEN dd > 0 THEN price - 1 WHEN dd < 0 THEN -1.0 ELSE 0 END, 6)::DOUBLE AS pnl FROM (SELECT *, CASE WHEN side = 'over' THEN 2.5 - points ELSE points - 2.5 END AS dd FROM {TICKS} t)")
def bet_settlement(spark, d):
    out = P.settle_bets(ticks(spark, d).withColumn("total", F.lit(2.5)))
    return out.select("match_uid", "tick_id", "price", F.round("pnl", 6).alias("pnl"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY edge DESC NULLS LAST, id) AS r FROM (
SELECT *, CASE WHEN l_discount > 0.01 THEN l_discount - l_tax END AS edge, l_partkey * 10 + l_linenumber AS id FROM lineitem)) WHERE r = 1""")
def policy_pick(spark, d):
    c = table(spark, d, "lineitem").withColumn("edge", F.when(F.col("l_discount") > 0.01, F.col("l_discount") - F.col("l_tax"))).withColumn("id", F.col("l_partkey") * 10 + F.col("l_linenumber"))
    return P.pick(c, ["l_orderkey"], "max_edge", "id").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT event_id, round(value - b, 6) AS change FROM (SELECT event_id, user_id, value, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS b FROM events) WHERE b IS NULL OR value <> b")
def odds_movement(spark, d):
    return I.odds_movement(events(spark, d), ["user_id", "event_type"], "ts", "value", "event_id").select("event_id", F.round("change", 6).alias("change"))


# Evaluation ------------------------------------------------------------------

SCORED = "(SELECT o_orderkey, o_orderdate, o_orderpriority, least(greatest(o_totalprice / 500000, 0.001), 0.999) AS p, (o_orderkey % 3 = 0 OR o_totalprice > 400000)::INT AS y FROM orders)"


def scored(spark, d):
    """Orders with a score and an outcome."""
    o = table(spark, d, "orders")
    return o.select("o_orderkey", "o_orderdate", "o_orderpriority", F.least(F.greatest(F.col("o_totalprice") / 500_000, F.lit(0.001)), F.lit(0.999)).alias("p"), ((F.col("o_orderkey") % 3 == 0) | (F.col("o_totalprice") > 400_000)).cast("int").alias("y"))


METRICS = """count(*) AS n, round(avg(hit::INT), 6) AS accuracy, round(avg(ll), 6) AS log_loss, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(conf) - avg(hit::INT), 6) AS signed_calibration,
round(count(*) FILTER (conf >= 0.8 AND NOT hit) / nullif(count(*) FILTER (conf >= 0.8), 0), 6) AS err80"""
JUDGED = f"(SELECT *, greatest(p, 1 - p) AS conf, CASE WHEN p >= 0.5 THEN y = 1 ELSE y = 0 END AS hit, CASE WHEN y = 1 THEN -ln(p) ELSE -ln(1 - p) END AS ll FROM {SCORED} s)"


@query(f"SELECT o_orderpriority, {METRICS} FROM {JUDGED} j GROUP BY 1")
def brier_logloss(spark, d):
    out = scored(spark, d).groupBy("o_orderpriority").agg(*V.metric_columns(F.col("p"), F.col("y")))
    return out.select("o_orderpriority", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "log_loss", "brier", "signed_calibration", "err80")])


@query(f"""WITH g AS (SELECT o_orderpriority, p, sum(y) AS pos, sum(1 - y) AS neg FROM {SCORED} s GROUP BY 1, 2), r AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY o_orderpriority ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT o_orderpriority, round(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)), 6) AS auc, sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg FROM r GROUP BY 1""")
def auc_rank(spark, d):
    return V.auc(scored(spark, d), "p", "y", ["o_orderpriority"]).withColumn("auc", F.round("auc", 6))


BANDS = f"(SELECT least(floor((conf - 0.5) / 0.05 + 1e-9), 9)::INT AS band, count(*) AS n, avg(conf) AS confidence, avg(hit::INT) AS accuracy FROM {JUDGED} j GROUP BY 1)"


@query(f"SELECT band, n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy, round(abs(confidence - accuracy), 6) AS gap FROM {BANDS}")
def calibration_buckets(spark, d):
    return V.calibration(scored(spark, d), F.col("p"), F.col("y")).select("band", "n", *[F.round(c, 6).alias(c) for c in ("confidence", "accuracy", "gap")])


@query(f"SELECT round(sum(abs(confidence - accuracy) * n) / sum(n), 6) AS ece, round(max(abs(confidence - accuracy)), 6) AS max_gap FROM {BANDS}")
def calibration_error(spark, d):
    out = V.calibration_error(V.calibration(scored(spark, d), F.col("p"), F.col("y")))
    return out.select(F.round("ece", 6).alias("ece"), F.round("max_gap", 6).alias("max_gap"))


@query(f"""WITH s AS {SCORED}, e AS (SELECT quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM s)
SELECT (len([x for x in e.e if x < p]) + 1)::INT AS decile, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS mean_y FROM s, e GROUP BY 1""")
def decile_calibration(spark, d):
    return V.decile_calibration(scored(spark, d), "p", "y").select("decile", "n", F.round("mean_p", 6).alias("mean_p"), F.round("mean_y", 6).alias("mean_y"))


@query(f"""WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n, sum(p) AS sp, sum(y) AS sy FROM {SCORED} s GROUP BY 1)
SELECT month, (sum(n) OVER w)::BIGINT AS n, round(sum(sp) OVER w / sum(n) OVER w, 6) AS mean_p, round(sum(sy) OVER w / sum(n) OVER w, 6) AS mean_y, round(sum(sp) OVER w / sum(n) OVER w - sum(sy) OVER w / sum(n) OVER w, 6) AS drift FROM m
WINDOW w AS (ORDER BY month RANGE BETWEEN INTERVAL 2 MONTH PRECEDING AND CURRENT ROW)""")
def rolling_month_calibration(spark, d):
    return V.months_ahead(scored(spark, d), "o_orderdate", "p", "y", 3).select("month", "n", *[F.round(c, 6).alias(c) for c in ("mean_p", "mean_y", "drift")])


@query("""WITH o AS (SELECT o_orderkey, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS m FROM orders), b AS (SELECT min(m) AS lo, max(m) AS hi FROM o),
f AS (SELECT lo, hi, unnest(range(lo + 24, hi + 1, 12)) AS start FROM b), g AS (SELECT *, row_number() OVER (ORDER BY start) - 1 AS fold FROM f)
SELECT fold::INT AS fold, CASE WHEN m < start THEN 'train' ELSE 'test' END AS part, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM o JOIN g ON m >= start - 24 AND m < start + 12 GROUP BY 1, 2""")
def walk_forward_split(spark, d):
    rows = V.walk_forward(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", 24, 12, 12)
    return rows.groupBy("fold", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


# Reports ---------------------------------------------------------------------

@query(f"""WITH j AS {JUDGED}, s AS (SELECT j.*, unnest(['priority', 'year']) AS segment, unnest([o_orderpriority, year(o_orderdate)::VARCHAR]) AS value FROM j) SELECT segment, value, {METRICS} FROM s GROUP BY 1, 2""")
def segment_metrics(spark, d):
    out = B.by_segment(scored(spark, d), {"priority": F.col("o_orderpriority"), "year": F.year("o_orderdate")}, "p", "y")
    return out.select("segment", "value", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "log_loss", "brier", "signed_calibration", "err80")])


@query(f"""WITH t AS (SELECT year(o_orderdate)::INT AS year, count(*) AS n, sum(hit::INT) AS r FROM {JUDGED} j GROUP BY 1), u AS (SELECT year, n, r / n AS accuracy, sum(r) OVER () / sum(n) OVER () AS overall FROM t)
SELECT year, n, round(accuracy, 6) AS accuracy, round(overall, 6) AS overall, round(abs(accuracy - overall), 6) AS drift, round(max(abs(accuracy - overall)) OVER (), 6) AS max_drift FROM u""")
def yearly_drift(spark, d):
    out = B.yearly_drift(scored(spark, d), "o_orderdate", "p", "y")
    return out.select("year", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "overall", "drift", "max_drift")])


THREE = f"(SELECT *, (p + 0.5) / 2 AS q, CASE WHEN o_orderkey % 4 = 0 THEN 1 - p ELSE p END AS r FROM {SCORED} s)"


def three_models(spark, d):
    s = scored(spark, d)
    return s.withColumns({"q": (F.col("p") + 0.5) / 2, "r": F.when(F.col("o_orderkey") % 4 == 0, 1 - F.col("p")).otherwise(F.col("p"))})


def _agree(a: str, b: str) -> str:
    return f"SELECT '{a}' AS a, '{b}' AS b, round(avg((({a} >= 0.5) = ({b} >= 0.5))::INT), 6) AS same, round(avg(CASE WHEN ({a} >= 0.5) = ({b} >= 0.5) THEN (({a} >= 0.5) = (y = 1))::INT END), 6) AS right_if_same, round(corr({a}, {b}), 6) AS corr, round(avg(abs({a} - {b})), 6) AS distance FROM {THREE} t"


@query(" UNION ALL ".join(_agree(*x) for x in ("pq", "pr", "qr")))
def model_agreement(spark, d):
    return B.agreement(three_models(spark, d), ["p", "q", "r"], "y").select("a", "b", *[F.round(c, 6).alias(c) for c in ("same", "right_if_same", "corr", "distance")])


@query(f"SELECT (p >= 0.5)::INT + (q >= 0.5)::INT + (r >= 0.5)::INT AS votes, count(*) AS n, round(avg((((p + q + r) / 3 >= 0.5) = (y = 1))::INT), 6) AS accuracy FROM {THREE} t GROUP BY 1")
def model_consensus(spark, d):
    return B.consensus(three_models(spark, d), ["p", "q", "r"], "y").withColumn("accuracy", F.round("accuracy", 6))


@query(f"SELECT bar, round(avg((conf >= bar)::INT), 6) AS coverage, round(avg(CASE WHEN conf >= bar THEN hit::INT END), 6) AS accuracy FROM {JUDGED} j, (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS bar) GROUP BY 1")
def coverage_curve(spark, d):
    out = B.coverage_curve(scored(spark, d), "p", "y", [0.5, 0.6, 0.7, 0.8, 0.9])
    return out.select("bar", F.round("coverage", 6).alias("coverage"), F.round("accuracy", 6).alias("accuracy"))


def _without(m: str, rest: str) -> str:
    return f"SELECT '{m}' AS model, round(avg(pow(({rest}) / 2 - y, 2)), 6) AS brier_without, round(avg(pow(({rest}) / 2 - y, 2)) - avg(pow((p + q + r) / 3 - y, 2)), 6) AS contribution FROM {THREE} t"


@query(" UNION ALL ".join((_without("p", "q + r"), _without("q", "p + r"), _without("r", "p + q"))))
def leave_one_out_models(spark, d):
    return B.leave_one_out(three_models(spark, d), ["p", "q", "r"], "y").select("model", F.round("brier_without", 6).alias("brier_without"), F.round("contribution", 6).alias("contribution"))


@query(f"""WITH j AS (SELECT *, abs(coalesce(p - 0.5, 0)) AS x FROM {JUDGED} j), e AS (SELECT quantile_cont(x, [0.9, 0.95, 0.99]) AS e FROM j),
h AS (SELECT j.*, unnest(['|x|>=p90', '|x|>=p95', '|x|>=p99']) AS condition, unnest([x >= e.e[1], x >= e.e[2], x >= e.e[3]]) AS ok FROM j, e) SELECT condition, {METRICS} FROM h WHERE ok GROUP BY 1""")
def extreme_conditions(spark, d):
    out = B.threshold_conditions(scored(spark, d).withColumn("x", F.col("p") - 0.5), ["x"], "p", "y")
    return out.select("condition", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "log_loss", "brier", "signed_calibration", "err80")])


@query("SELECT count(*) AS n, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(e), 6) AS bias, round(1 - sum(e * e) / (var_pop(l_quantity) * count(*)), 6) AS r2 FROM (SELECT l_quantity, l_extendedprice / 2000 - l_quantity AS e FROM lineitem)")
def regression_metrics(spark, d):
    out = B.regression_metrics(table(spark, d, "lineitem"), F.col("l_extendedprice") / 2000, F.col("l_quantity"))
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "bias", "r2")])


@query("""SELECT event_id, round(pow(0.2 - (a <= 0)::INT, 2) + pow(0.5 - (a <= 1)::INT, 2) + pow(0.8 - (a <= 2)::INT, 2) + pow(1.0 - (a <= 3)::INT, 2) + greatest(a - 4, 0), 6) AS crps FROM (SELECT event_id, (floor(value / 20))::INT AS a FROM events)""")
def distribution_score(spark, d):
    e = events(spark, d).select("event_id", F.array(*[F.lit(x) for x in (0.2, 0.3, 0.3, 0.2)]).alias("pmf"), F.floor(F.col("value") / 20).cast("int").alias("a"))
    return B.crps(e, "event_id", "pmf", "a").withColumn("crps", F.round("crps", 6))


@query("SELECT event_id, array_to_string(list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), ',') AS history FROM events")
def recent_sequences(spark, d):
    out = B.recent_sequences(events(spark, d), "user_id", ["ts", "event_id"], ["event_type"])
    joined = F.when(F.size("history") > 0, F.array_join(F.transform("history", lambda x: x["event_type"]), ","))
    return out.select("event_id", joined.alias("history"))


@query("SELECT date_trunc('month', l_shipdate)::DATE AS period, l_returnflag, count(*) AS n_bets, count(*) FILTER (l_discount > l_tax) AS n_won, round(sum(l_discount - l_tax), 5) AS profit, round(avg(l_discount - l_tax), 6) AS yield FROM lineitem GROUP BY 1, 2")
def bet_report(spark, d):
    bets = table(spark, d, "lineitem").withColumn("pnl", F.col("l_discount") - F.col("l_tax"))
    return B.bet_report(bets, "l_shipdate", "month", ["l_returnflag"]).withColumns({"profit": F.round("profit", 5), "yield": F.round("yield", 6)})


@query("SELECT votes, count(*) AS n FROM (SELECT (CASE WHEN o_totalprice > 150000 THEN 1 ELSE -1 END + CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END + CASE WHEN o_orderpriority < '3' THEN 1 ELSE -1 END) AS votes FROM orders) GROUP BY 1")
def rule_votes(spark, d):
    rules = {"rich": F.col("o_totalprice") > 150_000, "done": F.col("o_orderstatus") == "F", "soon": F.col("o_orderpriority") < "3"}
    return table(spark, d, "orders").groupBy(B.rule_votes(rules).alias("votes")).agg(F.count(F.lit(1)).alias("n"))


@query()
def clustered_bootstrap(spark, d):
    return B.clustered_bootstrap(events(spark, d), "user_id", "value", "event_type")


# Ratings, chains, features ---------------------------------------------------

PAIRINGS = "(SELECT o_orderkey, o_orderdate, o_orderpriority, o_custkey AS a, o_custkey * 7 % 101 + 1 AS b, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice > 200000 END AS won FROM orders WHERE o_custkey <> o_custkey * 7 % 101 + 1)"


def pairings(spark, d):
    """Orders as matches between a customer and another by number."""
    o = table(spark, d, "orders")
    other = F.col("o_custkey") * 7 % 101 + 1
    return o.where(F.col("o_custkey") != other).select("o_orderkey", "o_orderdate", "o_orderpriority", F.col("o_custkey").alias("a"), other.alias("b"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") > 200_000).alias("won"))


def elo_sql(pool: str) -> str:
    """The fold as a recursion: in each step the matches that are next for both
    their players; the table of players is updated by key."""
    return f"""WITH RECURSIVE m AS (SELECT *, {pool} AS pool, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS pos FROM {PAIRINGS} q),
i AS (SELECT pos, pool, p, row_number() OVER (PARTITION BY pool, p ORDER BY pos) AS n FROM (SELECT pos, pool, a AS p FROM m UNION ALL SELECT pos, pool, b FROM m)),
g AS MATERIALIZED (SELECT m.*, x.n AS na, y.n AS nb FROM m JOIN i x ON x.pos = m.pos AND x.p = a JOIN i y ON y.pos = m.pos AND y.p = b),
s(kind, pool, id, n, played, r, other) USING KEY (kind, pool, id) AS (SELECT 'p', pool, p, 1::BIGINT, 0::BIGINT, 1500.0::DOUBLE, 0.0::DOUBLE FROM (SELECT DISTINCT pool, p FROM i)
UNION SELECT kind, pool, id, n, played, r, other FROM (SELECT unnest([{{'kind': 'p', 'pool': pool, 'id': a, 'n': na + 1, 'played': pa + (won IS NOT NULL)::INT, 'r': ra + coalesce(ka * d, 0), 'other': 0.0::DOUBLE}},
  {{'kind': 'p', 'pool': pool, 'id': b, 'n': nb + 1, 'played': pb + (won IS NOT NULL)::INT, 'r': rb - coalesce(kb * d, 0), 'other': 0.0::DOUBLE}}, {{'kind': 'm', 'pool': pool, 'id': o_orderkey, 'n': 0, 'played': 0, 'r': ra, 'other': rb}}], recursive := true)
  FROM (SELECT g.*, sa.r AS ra, sb.r AS rb, sa.played AS pa, sb.played AS pb, CASE WHEN sa.played < 30 THEN 48.0 ELSE 32.0 END AS ka, CASE WHEN sb.played < 30 THEN 48.0 ELSE 32.0 END AS kb, won::INT - 1 / (1 + pow(10, (sb.r - sa.r) / 400)) AS d
   FROM g JOIN recurring.s sa ON sa.kind = 'p' AND sa.pool = g.pool AND sa.id = a AND sa.n = na JOIN recurring.s sb ON sb.kind = 'p' AND sb.pool = g.pool AND sb.id = b AND sb.n = nb)))
SELECT pool, id AS match, round(r, 6) AS a_before, round(other, 6) AS b_before FROM s WHERE kind = 'm'"""


def rated(spark, d, pool=None):
    out = R.elo(pairings(spark, d), "o_orderkey", "o_orderdate", "a", "b", "won", pool=pool)
    return out.select("pool", "match", r6(F.col("a_before"), "a_before"), r6(F.col("b_before"), "b_before"))


@query(elo_sql("''"))
def elo_fold(spark, d):
    return rated(spark, d)


@query(elo_sql("o_orderpriority"))
def elo_fold_by_pool(spark, d):
    return rated(spark, d, "o_orderpriority")


HOLD = "(pow({0}, 4) * (1 + 4 * (1 - {0}) + 10 * pow(1 - {0}, 2)) + 20 * pow({0} * (1 - {0}), 3) * {0} * {0} / ({0} * {0} + pow(1 - {0}, 2)))"


@query(f"""WITH RECURSIVE c AS (SELECT DISTINCT (0.55::DOUBLE + (c_custkey % 20) / 100.0::DOUBLE) AS pa, 0.62::DOUBLE AS pb FROM customer),
tb AS (SELECT pa, pb, f, 0 AS a, 0 AS b, 1.0::DOUBLE AS w FROM c, (SELECT unnest([true, false]) AS f) UNION ALL
  SELECT pa, pb, f, a + won, b + 1 - won, w * CASE WHEN won = 1 THEN q ELSE 1 - q END FROM (SELECT *, CASE WHEN ((a + b + 1) // 2 % 2 = 0) = f THEN pa ELSE 1 - pb END AS q FROM tb WHERE a < 7 AND b < 7 AND NOT (a = 6 AND b = 6)) t, (SELECT unnest([0, 1]) AS won)),
breaker AS (SELECT pa, pb, f, sum(CASE WHEN a = 6 AND b = 6 THEN w * pa * (1 - pb) / (pa * (1 - pb) + (1 - pa) * pb) WHEN a = 7 THEN w ELSE 0 END) AS win FROM tb WHERE a = 7 OR b = 7 OR a = 6 AND b = 6 GROUP BY 1, 2, 3),
st AS (SELECT pa, pb, f, 0 AS a, 0 AS b, 1.0::DOUBLE AS w FROM c, (SELECT unnest([true, false]) AS f) UNION ALL
  SELECT pa, pb, f, a + won, b + 1 - won, w * CASE WHEN won = 1 THEN q ELSE 1 - q END FROM (SELECT st.*, CASE WHEN a = 6 AND b = 6 THEN win WHEN ((a + b) % 2 = 0) = st.f THEN {HOLD.format("st.pa")} ELSE 1 - {HOLD.format("st.pb")} END AS q FROM st JOIN breaker k ON k.pa = st.pa AND k.pb = st.pb AND k.f = st.f
  WHERE NOT ((a >= 6 OR b >= 6) AND abs(a - b) >= 2 OR a = 7 OR b = 7)) t, (SELECT unnest([0, 1]) AS won)),
sets AS (SELECT pa, pb, f, a, b, sum(w) AS p FROM st WHERE (a >= 6 OR b >= 6) AND abs(a - b) >= 2 OR a = 7 OR b = 7 GROUP BY ALL),
mt AS (SELECT pa, pb, true AS f, 0 AS x, 0 AS y, 0 AS games, 1.0::DOUBLE AS w FROM c UNION ALL SELECT m.pa, m.pb, m.f = ((a + b) % 2 = 0), x + (a > b)::INT, y + (b > a)::INT, games + a + b, w * p FROM mt m JOIN sets s ON s.pa = m.pa AND s.pb = m.pb AND s.f = m.f WHERE x < 2 AND y < 2),
pmf AS (SELECT pa, games, sum(w) AS p, sum(w * (x = 2)::INT) AS won FROM mt WHERE x = 2 OR y = 2 GROUP BY 1, 2), wins AS (SELECT pa, sum(won) AS p_match FROM pmf GROUP BY 1)
SELECT c_custkey, round(p_match, 9) AS p_match, games::INT AS games, round(p, 9) AS p FROM customer JOIN pmf ON pmf.pa = (0.55::DOUBLE + (c_custkey % 20) / 100.0::DOUBLE) JOIN wins USING (pa)""")
def match_projection(spark, d):
    c = table(spark, d, "customer").select("c_custkey", (F.lit(0.55) + (F.col("c_custkey") % 20) / 100).alias("pa"), F.lit(0.62).alias("pb"), F.lit(3).alias("best_of"))
    out = project(c, "c_custkey", "pa", "pb", "best_of").select("c_custkey", F.round("p_match", 9).alias("p_match"), F.posexplode("games_pmf").alias("games", "p"))
    return out.where("p > 0").withColumn("p", F.round("p", 9))


@query(f"""WITH g AS (SELECT round(p, 2) AS p, sum(y) AS s, count(*) AS n FROM {SCORED} t GROUP BY 1), r AS (SELECT *, row_number() OVER w AS i, sum(s) OVER w AS cs, sum(n) OVER w AS cn FROM g WINDOW w AS (ORDER BY p)),
a AS (SELECT u.i AS j, v.i AS k, (v.cs - u.cs + u.s) / (v.cn - u.cn + u.n) AS mean FROM r u JOIN r v ON v.i >= u.i), m AS (SELECT j, k, min(mean) OVER (PARTITION BY j ORDER BY k DESC) AS least FROM a)
SELECT r.p, r.n, round(max(least), 6) AS p_calibrated FROM r JOIN m ON m.k = r.i GROUP BY 1, 2""")
def isotonic_calibration(spark, d):
    """Scores by hundredths, for the largest of the least means of SQL to be a small table."""
    s = scored(spark, d).withColumn("p", S.rounded(F.col("p"), 2))
    return V.isotonic_fit(s, "p", "y").transform(s).groupBy("p").agg(F.count(F.lit(1)).alias("n"), S.rounded(F.max("p_calibrated"), 6).alias("p_calibrated"))


def feature_registry() -> Registry:
    """A small set of declared features over (match_uid, player_id, ts, won, points)."""
    reg = Registry()
    by = W.Over(("player_id",), "ts", ("match_uid",))

    def total(x: str, days):
        return W.rolling_sum(F.col(x), by, days) if days else F.coalesce(F.sum(x).over(by.before()), F.lit(0))

    @reg.feature("player_id", "ts", "match_uid")
    def matches_played(ctx, days=None):
        return W.rolling_count(by, days) if days else W.cumulative_count(by)

    @reg.feature("won", "ts", "match_uid")
    def wins(ctx, days=None):
        return total("won", days)

    @reg.feature("wins(days={days})", "matches_played(days={days})")
    def win_pct(ctx, days=None, k=0.0, prior=0.5):
        n, m = ctx.column(f"wins(days={days})"), ctx.column(f"matches_played(days={days})")
        return F.when(m > 0, (n + F.lit(k) * F.lit(prior)) / (m + F.lit(k)))

    @reg.feature("points", "ts", "match_uid")
    def points_mean(ctx, days=None):
        return W.rolling_mean(F.col("points"), by, days) if days else W.cumulative_mean(F.col("points"), by)

    reg.diff("win_pct")
    reg.sum("matches_played")
    reg.matchup("form_vs_record", "win_pct(days=365)", "win_pct")
    return reg


MATCHES = f"(SELECT match_uid, ('p' || ((match_uid * 31 + side * 17) % 211)) AS player_id, o_orderdate AS ts, (side = 1)::INT AS won, l_quantity AS points, side FROM {PAIRS} l JOIN orders ON l_orderkey = o_orderkey)"


def player_matches(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("ts"))
    player = F.concat(F.lit("p"), ((F.col("match_uid") * 31 + F.col("side") * 17) % 211).cast("string"))
    return pairs(spark, d).join(o, "l_orderkey").select("match_uid", player.alias("player_id"), "ts", (F.col("side") == 1).cast("int").alias("won"), F.col("l_quantity").alias("points"))


FEATURES = ["win_pct", "win_pct(days=365)", "points_mean(days=180)", "win_pct_diff", "matches_played_sum", "form_vs_record"]


@query(f"""WITH m AS {MATCHES}, f AS (SELECT *, sum(won) OVER b AS w, count(*) OVER b AS n, sum(won) OVER y AS wy, count(*) OVER y AS ny, avg(points) OVER h AS pm FROM m
WINDOW b AS (PARTITION BY player_id ORDER BY ts, match_uid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), y AS (PARTITION BY player_id ORDER BY ts RANGE BETWEEN INTERVAL 365 DAY PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING), h AS (PARTITION BY player_id ORDER BY ts RANGE BETWEEN INTERVAL 180 DAY PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)),
g AS (SELECT *, CASE WHEN n > 0 THEN coalesce(w, 0) / n END AS wp, CASE WHEN ny > 0 THEN coalesce(wy, 0) / ny END AS wpy FROM f)
SELECT a.match_uid, a.player_id, round(a.wp, 6) AS win_pct, round(a.wpy, 6) AS win_pct_365, round(a.pm, 6) AS points_mean_180, round(a.wp - b.wp, 6) AS win_pct_diff, a.n + b.n AS matches_played_sum, round(a.wpy - b.wp, 6) AS form_vs_record
FROM g a LEFT JOIN g b ON a.match_uid = b.match_uid AND a.side <> b.side""")
def feature_plan(spark, d):
    out = FeatureEngine(feature_registry()).compute(player_matches(spark, d), FEATURES)
    names = {"win_pct(days=365)": "win_pct_365", "points_mean(days=180)": "points_mean_180"}
    return out.select("match_uid", "player_id", *[(F.col(f"`{s}`") if s == "matches_played_sum" else F.round(F.col(f"`{s}`"), 6)).alias(names.get(s, s)) for s in FEATURES])


from . import evaluation_queries, integration_queries, market_queries, rating_queries  # noqa: E402, F401
