"""Every query with SQL gives the SQL's rows on the smallest tables."""

from datetime import datetime, timedelta

import duckdb
import numpy as np
import pandas as pd
import pytest

from rallyframe import queries

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(frame, columns):
    number = lambda v: None if v is None or pd.isna(v) else round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted(map(tuple, frame[columns].map(number).astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, sf, con, name):
    got, want = queries.QUERIES[name](spark, sf).toPandas(), con.execute(queries.ORACLE_SQL[name]).fetchdf()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and plain(got, columns) == plain(want, columns)


def same_as_sql(spark, folder, name, **tables):
    """A query gives its SQL's rows on the given tables; NaN is no null."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    want = con.execute(f"select * from ({queries.ORACLE_SQL[name]})")
    columns = [c[0] for c in want.description]
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in queries.QUERIES[name](spark, str(folder)).select(columns).collect())


def half_scores(spark):
    """Orders whose scores lie halfway between hundredths, and others, by two priorities."""
    prices = [72_500.0, 142_500.0, 282_500.0, 287_500.0, 62_500.0, 187_500.0, *[1000.0 * i for i in range(2, 499, 7)]]
    rows = [(i, datetime(2024, 1, 1), f"{i % 2 + 1}", prices[i % len(prices)]) for i in range(900)]
    return spark.createDataFrame(rows, "o_orderkey long, o_orderdate timestamp_ntz, o_orderpriority string, o_totalprice double")


def test_segmented_isotonic_of_half_scores(spark, tmp_path):
    same_as_sql(spark, tmp_path, "segmented_isotonic", orders=half_scores(spark))


def event_rows(spark, rows):
    """(user, minute, value) as events."""
    return spark.createDataFrame([(i, datetime(2024, 1, 1) + timedelta(minutes=t), u, "view", v) for i, (u, t, v) in enumerate(rows)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")


def test_open_close_of_zeros_halves_and_nulls(spark, tmp_path):
    rows = [(1, 0, 0.0), (1, 1, 5.0), (2, 0, 0.0), (2, 1, 0.0), (3, 0, 30.72), (3, 1, 25.86), (4, 0, 25.6), (4, 1, 83.17), (5, 0, None), (5, 1, 3.0), (5, 2, 4.0), (5, 3, None), (6, 0, None), (7, 0, 0.0), (7, 1, -5.0), (8, 0, 5.0), (8, 1, 0.0), (9, 0, 3.0)]
    same_as_sql(spark, tmp_path, "open_close", events=event_rows(spark, rows))


def test_isotonic_calibration_of_half_scores(spark, tmp_path):
    same_as_sql(spark, tmp_path, "isotonic_calibration", orders=half_scores(spark))


def test_kernel_of_far_values(spark, tmp_path):
    """Weights too small for a double, alone and beside others."""
    rows = [(1, 0, 0.0), (1, 1, 500.0), (2, 0, 0.0), (2, 1, 280.0), (3, 0, 0.0), (3, 1, 1.0), (3, 2, 500.0), (3, 9, 2.5), (4, 0, None), (4, 5, 2.0), (5, 0, 1.0)]
    same_as_sql(spark, tmp_path, "knn_kernel_range_join", events=event_rows(spark, rows))


def test_all_but_the_random_one_have_sql():
    assert set(queries.QUERIES) - set(queries.ORACLE_SQL) == {"clustered_bootstrap"}


def test_clustered_bootstrap(spark, sf, con):
    """Means are exact, draws repeat, and intervals are those of resampled clusters."""
    got = {r.event_type: r for r in queries.QUERIES["clustered_bootstrap"](spark, sf).collect()}
    again = {r.event_type: r for r in queries.QUERIES["clustered_bootstrap"](spark, sf).collect()}
    sums = con.execute("select event_type, user_id, sum(value) s, count(value) n from events group by all").fetchdf()
    rng = np.random.default_rng(1)
    assert got == again and set(got) == set(sums.event_type)
    for kind, part in sums.groupby("event_type"):
        picks = rng.integers(0, len(part), (4000, len(part)))
        means = part.s.to_numpy()[picks].sum(1) / part.n.to_numpy()[picks].sum(1)
        low, high = np.quantile(means, [0.025, 0.975])
        r = got[kind]
        assert r["mean"] == pytest.approx(part.s.sum() / part.n.sum()) and r.clusters == len(part) and r.low < r["mean"] < r.high
        assert r.low == pytest.approx(low, abs=0.15 * (high - low)) and r.high == pytest.approx(high, abs=0.15 * (high - low))


def test_no_cross_joins(spark, sf):
    """Nothing but joins with a single row may lack a key."""
    for name, make in queries.QUERIES.items():
        plan = make(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name


def test_pushdown_and_pruning(spark, sf):
    plan = queries.QUERIES["filter_language"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan and "o_custkey" not in plan.split("ReadSchema")[1]


def test_windows_share_a_shuffle(spark, sf):
    plan = queries.QUERIES["cumulative_prior"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
