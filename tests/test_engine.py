"""Planner, languages, ratings, chains, streams and sinks."""

import math
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rallyframe import queries
from rallyframe.functions import scalars
from rallyframe.functions import windows as W
from rallyframe.operators import aggregates, calibrate, evaluate, integrate, joins, ledger, markov, metrics, prices, ratings, reshape, splits
from rallyframe.plans import filters, planner
from rallyframe.plans.registry import Registry
from rallyframe.sources import tables
from rallyframe.streaming import feeds


def day(i, hour=0):
    return datetime(2024, 1, 1) + timedelta(days=i, hours=hour)


def test_spec_parsing():
    assert planner.parse("a") == ("a", {}) and planner.parse("a(days=3, k=1.5, by='x')") == ("a", {"days": 3, "k": 1.5, "by": "x"})
    for bad in ("", "a(", "a(3)", "1a", "a(**x)"):
        with pytest.raises((ValueError, SyntaxError)):
            planner.parse(bad)
    assert planner.fingerprint(["b", "a(k=1, days=2)"]) == planner.fingerprint(["a(days=2,k=1)", "b"])


def test_phases_and_errors():
    engine = planner.FeatureEngine(queries.feature_registry())
    raw = ["match_uid", "player_id", "ts", "won", "points"]
    phases = engine.phases(["win_pct_diff", "points_mean"], raw)
    assert [any(k.startswith("win_pct_diff") for k in p) for p in phases] == [False, False, True]
    with pytest.raises(KeyError):
        engine.phases(["nothing"], raw)
    with pytest.raises(ValueError):
        engine.phases(["wins(weeks=2)"], raw)
    reg = Registry()
    reg.feature("b")(lambda ctx: None)
    loop = Registry()

    @loop.feature("two")
    def one(ctx):
        return ctx.column("two")

    @loop.feature("one")
    def two(ctx):
        return ctx.column("one")

    with pytest.raises(ValueError):
        planner.FeatureEngine(loop).phases(["one"], [])
    with pytest.raises(ValueError):
        loop.feature()(one)


def test_transform_feature(spark):
    reg = Registry()
    reg.table("wide", ("points",), lambda df: df.withColumn("wide_a", F.col("points") * 2))
    df = spark.createDataFrame([(1, "a", 2.0), (1, "b", 3.0)], "match_uid long, player_id string, points double")
    assert planner.FeatureEngine(reg).compute(df, ["wide", "points"], ("wide_a",)).orderBy("player_id").first().wide_a == 4.0


def test_rolling_excludes_ties(spark):
    rows = [(1, "p", day(0), 1.0), (2, "p", day(0), 2.0), (3, "p", day(5), 4.0), (4, "p", day(7), 8.0), (5, "p", day(20), None)]
    df = spark.createDataFrame(rows, "id long, k string, t timestamp_ntz, x double")
    over = W.Over(("k",), "t", ("id",))
    got = df.select("id", W.rolling_sum(F.col("x"), over, 7, None).alias("s"), W.rolling_count(over, 7).alias("n")).orderBy("id").collect()
    assert [(r.s, r.n) for r in got] == [(None, 0), (None, 0), (3.0, 2), (7.0, 3), (None, 0)]


def test_null_carry(spark):
    df = spark.createDataFrame([(i, "p", day(i), x) for i, x in enumerate([1.0, None, 5.0, 2.0])], "id long, k string, t timestamp_ntz, x double")
    got = df.select("id", W.cumulative_sum(F.col("x"), W.Over(("k",), "t", ("id",))).alias("s")).orderBy("id").collect()
    assert [r.s for r in got] == [None, 1.0, None, 6.0]


def test_filters(spark):
    df = spark.createDataFrame([(1, "Clay", -3.0), (2, "Hard", 1.0), (3, None, None)], "id long, surface string, edge double")
    ids = lambda c: [r.id for r in df.where(c).orderBy("id").collect()]
    assert ids(filters.where({"surface": ["Clay", "Hard"], "edge": {"abs_min": 2}})) == [1]
    assert ids(filters.scenario([("edge", ">=", 0), ("surface", "==", "Hard")])) == [2]
    assert ids(filters.rule({"surface": "CLAY"})) == [1] and ids(filters.rule({"edge": 0})) == [2] and ids(~filters.rule({"edge": 0})) == [1, 3]
    assert ids(filters.completed(F.col("surface"), F.col("surface"))) == [1, 2, 3]
    with pytest.raises(ValueError):
        filters.where({"edge": {"above": 1}})


def test_names_and_fractions(spark):
    df = spark.createDataFrame([("Müller-Özil, José (1990)",)], "n string")
    r = df.select(scalars.flip_name(F.col("n")).alias("f"), scalars.normalise_name(F.lit(" Ana  IVÁNOVIĆ-Š ")).alias("x"), scalars.names_agree(F.lit("J. Smith"), F.lit("smith j. r")).alias("a"), *[c.alias(f"c{i}") for i, c in enumerate(scalars.fraction(F.lit("12/40 (30%)")))]).first()
    assert r.f == "José Müller-Özil" and r.a and (r.c0, r.c1, r.c2) == (12, 40, 30)


def test_elo_is_a_plain_fold(spark):
    random.seed(1)
    rows = [(i, day(i // 5), f"p{random.randrange(6)}", f"q{random.randrange(6)}", random.choice([True, False, None])) for i in range(300)]
    df = spark.createDataFrame(rows, "m long, t timestamp_ntz, a string, b string, won boolean").repartition(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        got = {r.match: (r.a_before, r.b_before) for r in ratings.elo(df, "m", "t", "a", "b", "won").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    state = {}
    for m, _, a, b, won in rows:
        (x, n), (y, k) = state.get(a, (1500.0, 0)), state.get(b, (1500.0, 0))
        assert got[m] == pytest.approx((x, y))
        if won is not None:
            e = 1 / (1 + 10 ** ((y - x) / 400))
            step = lambda played: 48 if played < 30 else 32
            state[a], state[b] = (x + step(n) * (won - e), n + 1), (y - step(k) * (won - e), k + 1)


def test_glicko_example():
    """A rating of 1500 and deviation 200 beats one of 1400 and deviation 30."""
    after = ratings.Glicko()._after((1500, 200, 0.06), (1400, 30, 0.06), 1.0)
    assert after[0] == pytest.approx(1563.56, abs=0.1) and after[1] == pytest.approx(175.40, abs=0.1) and after[2] == pytest.approx(0.06, abs=1e-4)


def test_markov_against_simulation():
    rng = random.Random(5)

    def game(p):
        a = b = 0
        while max(a, b) < 4 or abs(a - b) < 2:
            won = rng.random() < p
            a, b = a + won, b + (not won)
        return a > b

    assert markov.hold(0.6) == pytest.approx(sum(game(0.6) for _ in range(40_000)) / 40_000, abs=0.01)
    assert markov.tiebreak(0.6, 0.6) == pytest.approx(0.5) and markov.match_games(0.62, 0.62)[0] == pytest.approx(0.5)
    won, pmf = markov.match_games(0.66, 0.6, 5)
    assert sum(pmf) == pytest.approx(1) and won > 0.7 and sum(pmf[:18]) == 0
    assert sum(markov.set_scores(0.6, 0.55).values()) == pytest.approx(1)


def test_cover_probability(spark):
    grid = reshape.cumulative_pmf(spark.createDataFrame([(1, [0.1, 0.2, 0.7])], "m long, pmf array<double>"), "m", "pmf")
    lines = spark.createDataFrame([(1, 0.5), (1, 1.5), (1, 9.5), (1, -0.5)], "m long, line double")
    assert [round(r.p_over, 6) for r in reshape.cover_probability(lines, grid, "m", "line").orderBy("line").collect()] == [1.0, 0.9, 0.7, 0.0]


def test_feed_flattening(spark):
    text = '{"b1": {"markets": {"totals": {"outcomes": {"over": {"ticks": [{"t": 1, "price": 1.9}, {"t": 2, "price": 2.0}]}}}}}}'
    rows = reshape.flatten_feed(spark.createDataFrame([(7, text), (8, "broken"), (9, None)], "m long, payload string"), "payload", ["m"]).collect()
    assert sorted((r.m, r.book, r.market, r.outcome, r.t, r.price) for r in rows) == [(7, "b1", "totals", "over", 1, 1.9), (7, "b1", "totals", "over", 2, 2.0)]


TICK = "tick_id long, match_uid string, book string, points double, side string, odds double, active boolean, ts timestamp, status string"


def tick(i, book, points, side, odds, active, hour, status="NOT_STARTED", match="m"):
    return (i, match, book, points, side, odds, active, datetime(2024, 1, 1, hour), status)


def test_board_carries_stopped_sides_and_picks_main_lines(spark):
    rows = [
        tick(1, "b", 22.5, "over", 1.9, True, 0), tick(2, "b", 22.5, "under", 1.8, True, 0), tick(3, "b", 22.5, "over", 2.1, False, 1), tick(4, "b", 22.5, "under", 9.0, True, 9),
        tick(5, "c", 21.5, "over", 2.0, True, 0), tick(6, "c", 21.5, "under", 2.0, True, 1), tick(7, "c", 22.5, "over", 2.2, True, 0), tick(8, "c", 22.5, "under", 1.7, True, 0), tick(9, "c", 23.5, "over", 3.0, True, 0),
        tick(10, "c", 21.5, "over", 1.0, True, 1), tick(11, "c", 21.5, "over", 5.0, True, 1, "LIVE"), tick(12, "c", 21.5, "over", 5.0, True, 1, match=None),
    ]
    ticks = spark.createDataFrame(rows, TICK)
    at = spark.createDataFrame([("m", datetime(2024, 1, 1, 2))], "match_uid string, t timestamp")
    board = {(r.book, r.points): r for r in prices.board_at(ticks, at).collect()}
    assert set(board) == {("b", 22.5), ("c", 21.5), ("c", 22.5), ("c", 23.5)}
    stopped = board["b", 22.5]
    assert (stopped.over_odds, stopped.live, stopped.live_over, stopped.live_under, stopped.is_main_line, stopped.n_two_sided) == (2.1, False, False, True, False, 0)
    assert (stopped.quote_age_s, stopped.last_change_s) == (7200, 3600)
    main = board["c", 21.5]
    assert main.is_main_line and main.p_over == 0.5 and main.overround == 1.0 and main.n_two_sided == 2 and main.separation == pytest.approx(board["c", 22.5].imbalance)
    assert board["c", 23.5].p_over is None and not board["c", 23.5].live and board["c", 23.5].live_over
    assert [(r.points, r.n_books_on_line, r.books, r.n_books_live, r.line_spread) for r in prices.main_line_support(prices.board_at(ticks, at)).collect()] == [(21.5, 1, ["c"], 1, 0.0)]
    with pytest.raises(Exception, match="one moment only"):
        prices.board_at(ticks, at.union(at)).collect()
    assert prices.board_at(ticks.limit(0), at).count() == 0


def test_formed_sums_one_instant(spark):
    rows = [tick(1, "b", 1.5, "over", 2.0, True, 0), tick(2, "b", 1.5, "under", 2.0, True, 0), tick(3, "b", 1.5, "under", 2.0, False, 5), tick(4, "b", 2.5, "over", 2.0, True, 3), tick(5, "b", 2.5, "under", 2.0, True, 5),
            tick(6, "c", 1.5, "over", 2.0, True, 6), tick(7, "c", 1.5, "under", 2.0, True, 6)]
    ticks = spark.createDataFrame(rows, TICK)
    assert prices.formed(ticks, 1).first().formed_at == datetime(2024, 1, 1, 0) and prices.formed(ticks, 2).first().formed_at == datetime(2024, 1, 1, 6) and prices.formed(ticks, 3).count() == 0
    starts = spark.createDataFrame([("m", datetime(2024, 1, 2)), ("m", datetime(2024, 1, 3)), ("n", None)], "match_uid string, start timestamp")
    assert [r.t for r in prices.anchor("close", ticks, starts).collect()] == [datetime(2024, 1, 2, 23, 45)] and [r.t for r in prices.anchor("offset1.5", ticks, starts).collect()] == [datetime(2024, 1, 2, 22, 30)]
    with pytest.raises(ValueError):
        prices.anchor("peak", ticks, starts)


def test_ledger_rules(spark):
    """Pushes return the stake; one-sided and stopped sides are taken by what is left; reference books never."""
    columns = "match_uid string, book string, points double, over_odds double, under_odds double, p_over double, live_over boolean, live_under boolean, is_main_line boolean"
    rows = [("m", "b", 2.0, 2.5, 2.5, 0.5, True, True, True), ("m", "b", 2.5, 2.5, None, None, True, False, False), ("m", "b", 1.5, 3.0, 9.0, 0.75, True, False, False), ("m", "pinnacle", 2.0, 9.0, 9.0, 0.5, True, True, True), ("m", "b", 9.5, 2.0, 2.0, 0.5, True, True, False), ("x", "b", 2.5, 2.0, 2.0, 0.5, True, True, True)]
    pmf = spark.createDataFrame([("m", [0.1, 0.2, 0.3, 0.4], 2), ("y", [1.0], None)], "match_uid string, pmf array<double>, actual_total int")
    settled = ledger.settle(ledger.price(ledger.line_offset(spark.createDataFrame(rows, columns)), pmf), pmf)
    got = {(r.book, r.points): r for r in settled.collect()}
    assert set(got) == {("b", 2.0), ("b", 2.5), ("b", 1.5), ("pinnacle", 2.0)}
    push = got["b", 2.0]
    assert push.is_push and push.over_won is None and push.pnl_over == push.pnl_under == 0.0 and push.p_push == pytest.approx(0.3) and push.model_p_over == pytest.approx(0.4) and push.model_p_under == pytest.approx(0.3)
    assert got["b", 1.5].over_won and got["b", 1.5].pnl_over == 2.0 and got["b", 1.5].pnl_under == -1.0 and got["b", 1.5].line_offset == -0.5
    taken = {(r.points, r.side): r.odds for r in ledger.bets(settled, -0.01).collect()}
    assert taken == {(2.0, "over"): 2.5, (2.5, "over"): 2.5, (1.5, "over"): 3.0}
    sides = ledger.mean_covers(ledger.by_side(settled), pmf)
    assert sides.count() == 8 and {(r.side, r.mean_covers) for r in sides.where("points = 1.5").collect()} == {("over", True), ("under", False)}


def test_settlement(spark):
    df = spark.createDataFrame([("over", 20.5, 2.0, 22), ("under", 20.5, 2.0, 22), ("over", 22.0, 2.0, 22), ("over", 1.5, 2.0, None)], "side string, points double, price double, total int")
    assert [r.pnl for r in prices.settle_bets(df).collect()] == [1.0, -1.0, 0.0, None]


def test_asof_without_history_and_ties(spark):
    left = spark.createDataFrame([(1, "a", day(1)), (2, "a", day(3)), (3, "b", day(3))], "id long, k string, t timestamp_ntz")
    right = spark.createDataFrame([("a", day(2), 1), ("a", day(2), 5), ("a", day(3), 7), ("c", day(0), 9)], "k string, r timestamp_ntz, v long")
    assert [(r.id, r.v) for r in joins.asof_backward(left, right, ["k"], "t", "r", ["v"]).orderBy("id").collect()] == [(1, None), (2, 7), (3, None)]
    plan = joins.asof_backward(left, right, ["k"], "t", "r", ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_swap_and_rounds(spark):
    df = spark.createDataFrame([(1, "x", "y", "qf", True), (2, "x", "y", "zz", None)], "id long, p1_s string, p2_s string, r string, bad boolean")
    got = integrate.swap_sides(df, F.col("bad"), "p1_", "p2_", ["s"]).withColumn("o", integrate.round_ordinal(F.col("r"))).orderBy("id").collect()
    assert [(r.p1_s, r.p2_s, r.o) for r in got] == [("y", "x", 9), ("x", "y", None)]


def test_splits_cover_time(spark):
    df = spark.createDataFrame([(i, day(30 * i)) for i in range(24)], "id long, t timestamp_ntz")
    rows = evaluate.walk_forward(df, "t", None, 3, 3).collect()
    tests = [r.id for r in rows if r.part == "test"]
    assert len(tests) == len(set(tests)) == 22 and all(max([r.id for r in rows if r.fold == f and r.part == "train"]) < min([r.id for r in rows if r.fold == f and r.part == "test"]) for f in {r.fold for r in rows})


def test_platt(spark):
    rng = random.Random(2)
    rows = [(p, float(rng.random() < p)) for p in (rng.random() for _ in range(3000))]
    slope, shift = evaluate.platt_fit(spark.createDataFrame(rows, "p double, y double"), "p", "y")
    assert slope == pytest.approx(1, abs=0.15) and abs(shift) < 0.15


def test_quantiles_and_coverage(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "x double")
    assert aggregates.quantile_edges(df, "x", 4) == [25.0, 50.0, 75.0]
    assert aggregates.coverage(df.limit(0)).first().null_pct is None


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id long, book string, x double")
    path = str(tmp_path / "t")
    tables.write_partitioned(df, path, ["book"])
    tables.write_partitioned(df.where("book = 'a'").withColumn("x", F.lit(9.0)), path, ["book"])
    assert sorted((r.id, r.x) for r in spark.read.parquet(path).collect()) == [(1, 9.0), (2, 2.0)]
    tables.append_ledger(df, str(tmp_path / "l"))
    tables.append_ledger(df, str(tmp_path / "l"))
    assert tables.json_records(spark, str(tmp_path / "l"), df.schema).count() == 4
    tables.replace_table(df, str(tmp_path / "r"))
    tables.replace_table(spark.read.parquet(str(tmp_path / "r")).where("id = 1"), str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 1
    (tmp_path / "f.txt").write_text("F|NA=Nadal|OD=4/6\nF|NA=Federer")
    assert [tuple(r) for r in tables.delimited(spark, str(tmp_path / "f.txt"), ["NA", "OD"]).collect()] == [("Nadal", "4/6"), ("Federer", None)]
    assert tables.schema_hash(df.schema) != tables.schema_hash(df.drop("x").schema)


def test_quarantine(spark):
    rows = [("m1", "a", "b", "a", "completed", None), ("m2", "a", "a", "a", "completed", None), ("m3", "a", "b", "c", "walkover", "RET")]
    df = spark.createDataFrame(rows, "match_uid string, p1_id string, p2_id string, winner_id string, result_type string, reason string")
    good, bad = tables.validated(df, tables.result_checks())
    assert [r.match_uid for r in good.collect()] == ["m1"] and {r.match_uid: r.reject_reason for r in bad.collect()} == {"m2": ["players"], "m3": ["winner", "walkover"]}
    uid = [tables.match_uid(F.lit("tour"), F.lit("t"), F.lit(2024), F.lit("s"), F.lit("F"), *map(F.lit, p)) for p in (("x", "y"), ("y", "x"))]
    r = df.select(*uid).first()
    assert r[0] == r[1]


def test_streams(spark, tmp_path):
    schema = "match_uid string, book string, tick_id long, price double, ts timestamp"
    rows = [("m", "b", i, 1.5 + i / 10, day(0) + timedelta(minutes=7 * i)) for i in range(9)]
    source = str(tmp_path / "in")
    spark.createDataFrame([*rows, rows[0]], schema).coalesce(1).write.parquet(source)
    stream = lambda: feeds.file_stream(spark, source, spark.read.parquet(source).schema)
    feeds.run_available(feeds.price_buckets(feeds.deduped(stream(), ["tick_id"], "ts", "5 minutes"), ["match_uid"], "ts", "price", delay=None), str(tmp_path / "out"), str(tmp_path / "c1"))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("bucket").collect()
    assert got and got[0].n == 3 and math.isclose(got[0].close, 1.7)
    feeds.run_upserts(stream(), str(tmp_path / "u"), ["match_uid", "book"], "ts", "tick_id", str(tmp_path / "c2"))
    spark.createDataFrame([("m", "b", 99, 9.9, day(1)), ("m", "c", 100, 3.0, day(1))], schema).coalesce(1).write.mode("append").parquet(source)
    feeds.run_upserts(stream(), str(tmp_path / "u"), ["match_uid", "book"], "ts", "tick_id", str(tmp_path / "c2"))
    assert sorted((r.book, r.tick_id) for r in feeds.upsert_target(spark, str(tmp_path / "u")).collect()) == [("b", 99), ("c", 100)]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_html_tables(spark):
    from rallyframe.sources import web

    page = "<table><tr><th>Player<th>Pts<tr><td><a href='/p/1'>A. One</a><td>1&nbsp;200</tr><tr><td>B Two<table><tr><td>inner</table></td><td>9</td></table><p>after"
    df = spark.createDataFrame([(1, page), (2, None), (3, "<table>")], "id long, html string")
    rows = web.html_tables(df, "id", "html")
    assert sorted((r.table, r.row, r.header, tuple(r.cells), r.links[0]) for r in rows.collect()) == [(0, 0, True, ("Player", "Pts"), None), (0, 1, False, ("A. One", "1 200"), "/p/1"), (0, 2, False, ("B Two", "9"), None), (1, 0, False, ("inner",), None)]
    assert [(r.row, r.fields) for r in web.records(rows, "id").orderBy("row").collect()] == [(1, {"Player": "A. One", "Pts": "1 200"}), (2, {"Player": "B Two", "Pts": "9"})]


def test_incomplete_beta_by_integration(spark):
    import numpy as np

    x = [0.001, 0.2, 0.5, 0.51, 0.9, 0.999]
    row = spark.createDataFrame([(v,) for v in x], "x double").select("x", metrics.incomplete_beta(F.col("x"), 0.25, 1.25).alias("a"), metrics.incomplete_beta(F.col("x"), 2.0, 3.0).alias("b")).collect()
    # Substituting t = u**4 takes the pole at 0 away.
    u = np.linspace(0, 1, 400_001)
    grid = np.concatenate([[0], np.cumsum(((1 - u**4) ** 0.25)[:-1] + ((1 - u**4) ** 0.25)[1:])])
    for r in row:
        assert r.b == pytest.approx(6 * r.x**2 - 8 * r.x**3 + 3 * r.x**4)
        assert r.a == pytest.approx(float(np.interp(r.x**0.25, u, grid / grid[-1])), abs=1e-6)


def test_metrics_of_one_class_and_ties(spark):
    df = spark.createDataFrame([("a", 0.7, 1), ("a", 0.6, 1), ("b", 0.5, 1), ("b", 0.5, 0), ("b", None, 1), ("c", 0.9, 1), ("c", 0.1, 0)], "k string, p double, y int")
    got = {r.k: r for r in metrics.metrics(df, "p", "y", ["k"]).collect()}
    assert got["a"].roc_auc is None and got["a"].weighted_concordance == 0 and got["a"].partial_auc_tail == 0.5
    assert got["b"].n == 2 and got["b"].roc_auc == 0.5 and got["b"].partial_auc_tail == pytest.approx(0.5) and got["c"].roc_auc == 1 and got["c"].partial_auc_tail == 1 and got["c"].weighted_concordance == 1


def test_split_bounds(spark):
    assert splits.expanding_rows(10, n_splits=1, min_train_size=4, test_size=3) == [(0, 4, 4, 7)] and splits.sliding_rows(10, 4, 3) == [(0, 4, 4, 7), (3, 7, 7, 10)]
    assert splits.month_folds(date(2024, 1, 15), date(2024, 6, 30), 3, 2, True) == [(date(2024, 1, 1), date(2024, 4, 1), date(2024, 4, 1), date(2024, 6, 1))]
    for bad in ({}, {"n_splits": 2, "step_size": 1}, {"n_splits": 2}, {"step_size": 2}, {"n_splits": 2, "min_train_size": 9, "test_size": 9}):
        with pytest.raises(ValueError):
            splits.expanding_rows(10, **bad)
    df = spark.createDataFrame([(i, date(2024, 1, 1 + i // 2)) for i in range(6)], "i int, effective_match_date date")
    rows = splits.split(df, "sliding_window", tie=["i"], train_size=2, test_size=2).collect()
    assert sorted((r.fold, r.part, r.i) for r in rows) == [(0, "test", 2), (0, "test", 3), (0, "train", 0), (0, "train", 1), (1, "test", 4), (1, "test", 5), (1, "train", 2), (1, "train", 3)]
    with pytest.raises(ValueError):
        splits.split(df, "date_window", test_start=date(2020, 1, 1))


def test_many_row_folds_stay_out_of_the_plan(spark):
    """A plan is no longer for many folds, and evenly spaced ones are those listed."""
    df = spark.range(60).select(F.col("id").alias("i"), F.lit(date(2024, 1, 1)).alias("effective_match_date"))
    for kind, listed, sizes in (("sliding_window", splits.sliding_rows, {"train_size": 7, "test_size": 3, "step_size": 2}), ("sliding_window", splits.sliding_rows, {"train_size": 2, "test_size": 2, "step_size": 9}), ("expanding_window", splits.expanding_rows, {"initial_train_size": 5, "step_size": 4}),
                                ("walk_forward", splits.expanding_rows, {"n_splits": 3, "min_train_size": 5, "test_size": 50}), ("walk_forward", splits.expanding_rows, {"n_splits": 1, "min_train_size": 5, "test_size": 9}), ("sliding_window", splits.sliding_rows, {"train_size": 50, "test_size": 11})):
        want = {(f, part, i) for f, (a0, b0, a1, b1) in enumerate(listed(60, **sizes)) for part, a, b in (("train", a0, b0), ("test", a1, b1)) for i in range(a, b)}
        got = [(r.fold, r.part, r.i) for r in splits.split(df, kind, tie=["i"], **sizes).collect()]
        assert len(got) == len(want) and set(got) == want
    wide = splits.split(spark.range(200_000).select(F.col("id").alias("i"), F.lit(date(2024, 1, 1)).alias("effective_match_date")), "sliding_window", tie=["i"], train_size=3, test_size=1, step_size=2)
    assert len(wide._jdf.queryExecution().optimizedPlan().toString()) < 20_000 and wide.count() == 4 * 99_999


def test_totals_of_folds_make_no_rows_of_folds(spark):
    """Totals are those of the folds' rows; many growing folds stay cheap."""
    x = F.when(F.col("id") % 3 > 0, 10 - F.col("id"))
    df = spark.range(60).select(F.col("id").alias("i"), x.alias("x"), F.when(F.col("id") > 40, F.col("id")).alias("late"), F.when(F.col("id") > 5, F.date_add(F.lit(date(2024, 1, 1)), (F.col("id") / 7).cast("int"))).alias("effective_match_date"))
    for kind, sizes in (("expanding_window", {"initial_train_size": 5, "step_size": 4}), ("sliding_window", {"train_size": 7, "test_size": 3, "step_size": 2}), ("walk_forward", {"n_splits": 3, "min_train_size": 5, "test_size": 50}), ("sliding_window", {"train_size": 50, "test_size": 11})):
        want = splits.split(df, kind, tie=["i"], **sizes).groupBy("fold", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x"), F.sum("late").alias("late"))
        got = splits.split_totals(df, kind, {"x": F.col("x"), "late": F.col("late")}, tie=["i"], **sizes)
        assert got.dtypes == want.dtypes and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    wide = spark.range(200_000).select(F.col("id").alias("i"), F.date_add(F.lit(date(2024, 1, 1)), (F.col("id") / 1000).cast("int")).alias("effective_match_date"))
    last = splits.split_totals(wide, "expanding_window", {"i": F.col("i")}, tie=["i"], initial_train_size=2, step_size=2).where("fold = 99998").collect()
    assert {(r.part, r.n, r.i) for r in last} == {("train", 199_998, 199_998 * 199_997 // 2), ("test", 2, 199_998 + 199_999)}


def test_instances_count_once_ended(spark):
    """An instance that runs on, or lies among others, is not known early."""
    rows = [(1, 1, "a", 10.0), (2, 2, "b", 1.0), (3, 3, "a", 20.0), (4, 4, "b", 2.0), (5, 5, "c", 5.0), (6, 6, "c", 7.0)]
    df = spark.createDataFrame([("k", *r) for r in rows], "k string, t int, i int, inst string, x double")
    got = {r.i: r.avg for r in W.instance_average(df, F.col("x"), W.Over(("k",), "t", ("i",)), "inst", "avg").collect()}
    assert got == {1: None, 2: None, 3: None, 4: 30.0, 5: 16.5, 6: 16.5}


def test_effective_dates(spark):
    """Peers fill gaps; partly scheduled tournaments are laid out; qualifying comes before the start."""
    d = lambda x: datetime(2024, 1, x)
    rows = [
        ("a", 1, "s", 5, d(1), d(8), d(3), "tour", "T"), ("a", 2, "s", 5, d(1), d(8), None, "tour", "T"), ("a", 3, "s", 6, d(1), d(8), d(4), "tour", "T"),
        ("b", 4, "s", 1, d(10), d(24), None, "itf", "GS"), ("b", 5, "s", 5, d(10), d(24), d(12), "itf", "GS"), ("b", 6, "s", 8, d(10), d(24), None, "itf", "GS"), ("b", 7, "s", 11, d(10), d(24), None, "itf", "GS"), ("c", 8, "s", 11, d(5), d(9), None, "tour", "T"),
    ]
    df = spark.createDataFrame(rows, "tid string, i int, draw string, ro int, start timestamp_ntz, end timestamp_ntz, sched timestamp_ntz, circuit string, kind string")
    got = {r.i: r.effective_match_date for r in integrate.effective_date(df, ["tid"], "draw", "ro", "start", "end", "sched", "circuit", "kind").collect()}
    assert got == {1: d(3), 2: d(3), 3: d(4), 4: d(7), 5: d(12), 6: d(14), 7: d(16), 8: d(5)}
    undated = df.withColumn("start", F.lit(None).cast("timestamp_ntz"))
    with pytest.raises(Exception, match="no effective date"):
        integrate.effective_date(undated, ["tid"], "draw", "ro", "start", "end", "sched").collect()
    assert integrate.effective_date(undated, ["tid"], "draw", "ro", "start", "end", "sched", strict=False).where("effective_match_date IS NULL").count() == 5


def test_leave_one_out_uses_the_row(spark):
    rows = [("p", date(2024, 1, 1), 1.0), ("q", date(2024, 1, 1), 2.0), ("r", date(2024, 1, 2), 4.0), ("p", date(2024, 1, 3), 9.0), ("p", date(2024, 1, 4), None)]
    got = W.leave_one_out_z(spark.createDataFrame(rows, "k string, t date, x double"), "k", "t", "x", 30).collect()
    assert {(r.k, r.t.day): r.loo_z for r in got}["p", 3] == pytest.approx((9 - 3) / 2**0.5) and sum(r.loo_z is not None for r in got) == 2


def test_cutoff_needs_its_column(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 23),), (datetime(2024, 1, 2),), (None,)], "effective_match_date timestamp_ntz")
    assert filters.upto(df, date(2024, 1, 1)).count() == 1 and filters.upto(df, None).count() == 3
    with pytest.raises(ValueError):
        filters.upto(df, date(2024, 1, 1), "other")


def test_checked_tables_and_recovery(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, name string")
    path = str(tmp_path / "t")
    tables.write_checked(df, path)
    assert tables.read_checked(spark, path, df.schema).count() == 2
    with pytest.raises(ValueError, match="another schema"):
        tables.read_checked(spark, path, df.drop("name").schema)
    (tmp_path / "t").rename(tmp_path / "t.0.old")
    (tmp_path / "t.1.new").mkdir()
    assert tables.read_checked(spark, path, df.schema).count() == 2 and sorted(p.name for p in tmp_path.iterdir()) == ["t"]
    tables.write_delimited(df, str(tmp_path / "c"))
    assert sorted(map(tuple, tables.delimited_table(spark, str(tmp_path / "c"), df.schema).collect())) == [(1, "a"), (2, None)]
    named = tables.overridden(df, spark.createDataFrame([(2, "b"), (3, "c")], "id long, name string"), "id", ["name"])
    assert sorted(map(tuple, named.collect())) == [(1, "a"), (2, "b")]


def test_quantiles_are_exact(spark):
    rng = random.Random(2)
    for values in ([rng.gauss(0, 1e6) for _ in range(999)], [rng.choice([0.0, 1.0, 5.0, -3.0]) for _ in range(100)], [7.0], [], [10.0 ** rng.randint(-5, 9) for _ in range(300)]):
        df = spark.createDataFrame([(v,) for v in [*values, None]], "x double")
        at = [0.0, 0.1, 0.5, 0.9, 0.99, 1.0]
        want = df.agg(F.percentile("x", F.array(*map(F.lit, at)))).first()[0]
        assert aggregates.quantiles(df, "x", at).first().q == (None if want is None else pytest.approx(want, rel=1e-12))


def test_names_of_all_latin_letters(spark):
    given = ["Novak Đoković", "Iga Świątek", "Tomáš Macháč", "Çağla Büyükakçay", "Stan  Wawrinka", "A\u0301na-Bo\u0308"]
    got = spark.createDataFrame([(g,) for g in given], "n string").select(scalars.normalise_name(F.col("n")).alias("n")).collect()
    assert [r.n for r in got] == ["novak đoković".replace("ć", "c"), "iga swiatek", "tomas machac", "cagla buyukakcay", "stan wawrinka", "ana bo"]


def test_text_scalars(spark):
    rows = [("02:50:39", "(3/WC)", "8/11", "AndrÃ©"), ("03:44", "(Q)", "1/1", "André"), ("x", "12", "5", "Ãrbol"), (None, "", "a/b", None), ("1:2:3:4", "()", "1/0", "Tōkyō Ã")]
    df = spark.createDataFrame(rows, "d string, s string, o string, m string")
    seed, entry = scalars.seed_entry(F.col("s"))
    got = [tuple(r) for r in df.select(scalars.duration_seconds(F.col("d")), seed, entry, F.round(scalars.decimal_odds(F.col("o")), 3), scalars.mended(F.col("m"))).collect()]
    assert got == [(10239, 3, "WC", 1.727, "André"), (13440, None, "Q", 2.0, "André"), (None, 12, None, 6.0, "Ãrbol"), (None, None, None, None, None), (None, None, None, None, "Tōkyō Ã")]
    names = spark.createDataFrame([("ATP Madrid 2026 - Clay", "madrid"), ("Pau Challenger", "sao paulo"), ("Porto", "porto alegre"), ("WTA 2026", "rome"), ("French Open Qualifying", "roland garros")], "a string, b string")
    one = scalars.event_name(F.col("a"), {"french open": "roland garros"})
    assert [tuple(r) for r in names.select(one, scalars.events_agree(one, F.col("b"))).collect()] == [("madrid", True), ("pau", False), ("porto", True), ("", True), ("roland garros", True)]
    levels = spark.createDataFrame([("CH", 110), ("CH", None), ("GP", None), ("GS", None), (None, None)], "k string, d int").select(scalars.tournament_level(F.col("k"), F.col("d")).alias("l"))
    assert [r.l for r in levels.collect()] == ["CH100", "CH75", "500", "GS", "250"]


def test_event_mapping_stages(spark):
    d = lambda x: date(2024, 1, x)
    events = [("e1", "p", "q", datetime(2024, 1, 3), "porto"), ("e2", "q", "p", datetime(2024, 1, 3), None), ("e3", None, "q", datetime(2024, 1, 3), None), ("e4", "p", "z", datetime(2024, 1, 3), None), ("e5", "p", "q", datetime(2024, 1, 3), "madrid"), ("e6", "p", "q", datetime(2024, 6, 1), "rome"), ("e7", "a", "b", datetime(2024, 1, 3), None)]
    matches = [("m1", "p", "q", d(2), 2024, "porto open"), ("m2", "q", "p", d(20), 2024, "rome"), ("m0", "p", "q", date(2023, 1, 3), 2023, "porto open"), ("n1", "a", "b", d(2), 2024, "x"), ("n2", "a", "b", d(4), 2024, "y")]
    got = joins.map_events(spark.createDataFrame(events, "event string, a string, b string, at timestamp_ntz, tournament string"), spark.createDataFrame(matches, "match string, a string, b string, date date, year int, tournament string"), 30).collect()
    assert {r.event: (r.match, r.outcome) for r in got} == {"e1": ("m1", "mapped"), "e2": ("m1", "mapped"), "e3": (None, "unresolved"), "e4": (None, "no_match"), "e5": (None, "tournament_rejected"), "e6": (None, "too_far"), "e7": (None, "ambiguous")}


def test_event_mapping_meets_all_candidates(spark):
    """As by meeting each candidate, with repeated events, unknown days, years and names."""
    rng = random.Random(8)
    one = lambda *xs: rng.choice(xs)
    day_of = lambda: one(None, *[date(y, 1, 1) + timedelta(rng.randrange(0, 40, 2)) for y in (2023, 2024, 2025)] * 5)
    name = lambda: one(None, "", "porto", "porto open", "rome", "rome open")
    events = [(rng.randrange(500), one(1, 2, 3, None), one(2, 3, 4), x and datetime(x.year, x.month, x.day, 23), name()) for x in (day_of() for _ in range(700))]
    matches = [(one(None, i, i, i), one(1, 2, 3), one(2, 3), x, one(x.year, x.year, None) if x else 2024, name()) for i, x in ((i, day_of()) for i in range(40))]
    agree = lambda a, b: not set((a or "").split()) or not set((b or "").split()) or set(a.split()) <= set(b.split()) or set(b.split()) <= set(a.split())
    want = {}
    for event in {e[0] for e in events}:
        rows = [e for e in events if e[0] == event]
        met = [(e, m) for e in rows for m in matches if m[0] is not None and None not in e[1:3] and sorted(e[1:3]) == sorted(m[1:3])]
        same = [(e, m) for e, m in met if e[3] and m[4] == e[3].year]
        fits = [(abs((e[3].date() - m[3]).days) if e[3] and m[3] else None, m[0]) for e, m in same or met if agree(e[4], m[5])]
        gap = min([g for g, _ in fits if g is not None], default=None)
        best = {m for g, m in fits if g == gap}
        outcome = "unresolved" if any(None in e[1:3] for e in rows) else "no_match" if not met else "tournament_rejected" if not fits else "ambiguous" if len(best) > 1 else "too_far" if gap is not None and gap > 6 else "mapped"
        want[event] = (min(best) if outcome == "mapped" else None, outcome)
    got = joins.map_events(spark.createDataFrame(events, "event int, a int, b int, at timestamp_ntz, tournament string"), spark.createDataFrame(matches, "match int, a int, b int, date date, year int, tournament string"), 6).collect()
    assert {r.event: (r.match, r.outcome) for r in got} == want and {o for _, o in want.values()} == {"unresolved", "no_match", "tournament_rejected", "ambiguous", "too_far", "mapped"}


def test_event_mapping_of_one_busy_pair(spark):
    """600 million candidates of one pair are not met one by one."""
    from time import monotonic

    e = spark.range(30_000).select(F.col("id").alias("event"), F.lit(1).alias("a"), F.lit(2).alias("b"), F.date_add(F.lit(date(2024, 1, 1)), (F.col("id") % 200).cast("int")).cast("timestamp_ntz").alias("at"), F.lit("porto").alias("tournament"))
    m = spark.range(20_000).select(F.col("id").alias("match"), F.lit(2).alias("a"), F.lit(1).alias("b"), F.date_add(F.lit(date(2024, 1, 1)), (F.col("id") % 100 * 2).cast("int")).alias("date"), F.lit(2024).alias("year"), F.lit("porto open").alias("tournament"))
    began = monotonic()
    assert {(r.outcome, r["count"]) for r in joins.map_events(e, m, 10).groupBy("outcome").count().collect()} == {("ambiguous", 30_000)} and monotonic() - began < 60


def test_calibrators_fall_back(spark):
    rng = random.Random(6)
    rows = [(s, p, int(rng.random() < p**2)) for s in "ab" for p in [rng.uniform(0.02, 0.98) for _ in range(400)]] + [("c", 0.5, 1), ("one", 0.4, 1)] * 3
    df = spark.createDataFrame(rows, "s string, p double, y int")
    platt = calibrate.fit_platt(df, "p", "y", ["s"], least=100)
    assert {r.segment for r in platt.collect()} == {None, "a", "b"}
    given = spark.createDataFrame([("a", 0.9), ("c", 0.9), ("new", 0.9), ("a", None)], "s string, p double")
    got = {(r.s, r.p): r.calibrated for r in calibrate.apply_platt(given, platt, "p", ["s"]).collect()}
    assert 0.7 < got["a", 0.9] < 0.95 and got["c", 0.9] == got["new", 0.9] != got["a", 0.9] and got["a", None] is None
    steps = calibrate.fit_isotonic(df, "p", "y", ["s"], least=100)
    values = [(r.low, r.high, r.value) for r in steps.where("segment = 'a'").orderBy("low").collect()]
    assert all(a[1] < b[0] and a[2] < b[2] for a, b in zip(values, values[1:], strict=False))
    grid = spark.createDataFrame([("a", i / 50) for i in range(51)] + [("zz", 0.3)], "s string, p double")
    out = [r.calibrated for r in calibrate.apply_isotonic(grid, steps, "p", ["s"]).where("s = 'a'").orderBy("p").collect()]
    assert out == sorted(out) and out[0] == values[0][2] and out[-1] == values[-1][2]
    heavier = calibrate.fit_platt(df, "p", "y", over=3.0).first()
    assert heavier.intercept < platt.where("segment IS NULL").first().intercept and calibrate.fit_platt(df.limit(0), "p", "y").count() == 0
