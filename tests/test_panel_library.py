"""Planted frames with known answers, and every query that has SQL against DuckDB on the smallest tables."""

import datetime as dt
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from panelspark.functions.distributions import chi2_tail, f_tail, normal_cdf, normal_ppf, t_two_sided
from panelspark.operators import asof, inference, panel, portfolio, series, signals
from panelspark.operators import xs as cross
from panelspark.plans import catalog
from panelspark.schemas import nan_to_null, require_columns
from panelspark.sources import io

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
D = dt.date


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="absent"):
        require_columns(spark.range(1), "absent")


def test_nan_becomes_null(spark):
    assert nan_to_null(spark.createDataFrame([(float("nan"),), (1.0,)], "x double")).filter("x is null").count() == 1


def test_asof_ties_nulls_and_no_match(spark):
    left = spark.createDataFrame([(1, D(2020, 1, 5)), (1, D(2020, 1, 1)), (2, D(2020, 1, 5))], "permno long, date date")
    right = spark.createDataFrame([(1, D(2020, 1, 5), 5.0), (1, D(2020, 1, 5), 7.0), (1, D(2020, 1, 3), 1.0), (2, D(2020, 1, 4), None)], "permno long, t date, x double")
    got = {(r.permno, r.date): (r.matched_time, r.x) for r in asof.asof_by_key(left, right, ["permno"], "date", "t", ["x"], ties=["x"]).collect()}
    assert got == {(1, D(2020, 1, 5)): (D(2020, 1, 5), 7.0), (1, D(2020, 1, 1)): (None, None), (2, D(2020, 1, 5)): (D(2020, 1, 4), None)}
    late = asof.asof_max_age(left, right, ["permno"], "date", "t", ["x"], 0)
    assert late.filter("x is not null").count() == 1


def test_later_rows_do_not_change_earlier_matches(spark):
    left = spark.createDataFrame([(1, D(2020, 1, 5))], "permno long, date date")
    right = spark.createDataFrame([(1, D(2020, 1, 3), 1.0)], "permno long, t date, x double")
    more = right.unionByName(spark.createDataFrame([(1, D(2020, 1, 6), 9.0)], "permno long, t date, x double"))
    one, two = (asof.asof_by_key(left, r, ["permno"], "date", "t", ["x"]).collect() for r in (right, more))
    assert one == two


def test_quintiles_of_25_names(spark):
    df = spark.createDataFrame([(D(2020, 1, 1), i, float(i)) for i in range(1, 26)], "date date, permno long, z_score double")
    assert [r.n for r in cross.qcut(df).groupBy("quintile").agg(F.count(F.lit(1)).alias("n")).collect()] == [5] * 5


def test_constant_cross_section_has_no_zscore(spark):
    df = spark.createDataFrame([(D(2020, 1, 1), i, 2.0) for i in range(5)], "date date, permno long, raw_signal double")
    assert cross.standardise(df).filter("z_score is not null").count() == 0


def test_forward_returns_compound(spark):
    days = [(1, D(2020, 1, 1) + dt.timedelta(i), 0.001) for i in range(30)]
    px = spark.createDataFrame(days, "permno long, date date, ret double")
    dates = spark.createDataFrame([(D(2020, 1, 5),), (D(2020, 1, 28),), (D(2020, 3, 1),)], "date date")
    got = {r.rebalance_date: (round(r.fwd_return, 12), r.n_days) for r in portfolio.forward_returns(px, dates, 10).collect()}
    assert got == {D(2020, 1, 5): (round(1.001**10 - 1, 12), 10), D(2020, 1, 28): (round(1.001**2 - 1, 12), 2)}


def test_drawdown_episode(spark):
    path = [0.1, -0.5, 1.5, -0.1]
    s = spark.createDataFrame([("s", D(2020, 1, 1 + i), r) for i, r in enumerate(path)], "series_id string, date date, ret double")
    got = sorted(series.drawdown_episodes(s).collect(), key=lambda r: r.peak_date)
    assert [(round(r.depth, 9), r.recovery_date) for r in got] == [(-0.5, D(2020, 1, 3)), (-0.1, None)]


def test_rolling_regression_recovers_betas(spark):
    rows = [(1, D(2020, 1, 1) + dt.timedelta(i), math.sin(i), math.cos(2 * i), math.sin(3 * i + 1)) for i in range(80)]
    df = spark.createDataFrame(rows, "permno long, date date, a double, b double, c double").withColumn("y", 0.5 + 1.2 * F.col("a") + 0.3 * F.col("b") - 0.1 * F.col("c"))
    r = signals.rolling_ols3(df, "y", ["a", "b", "c"], 60).collect()
    assert len(r) == 21 and all(abs(x.b1 - 1.2) < 1e-9 and abs(x.b2 - 0.3) < 1e-9 and abs(x.b3 + 0.1) < 1e-9 and x.residual_std < 1e-6 for x in r)


def test_neutral_weights_keep_constraints(spark):
    rows = [(D(2020, 1, 1), i, math.sin(7 * i), 1 + 0.1 * (i % 5), str(i % 3)) for i in range(60)]
    w = cross.neutral_weights(spark.createDataFrame(rows, "date date, permno long, alpha double, beta double, sector string"))
    e = portfolio.exposures(w).first()
    assert abs(e.net) < 1e-9 and abs(e.portfolio_beta) < 1e-9 and e.gross <= 1 + 1e-9


def test_distributions(spark):
    r = spark.range(1).select(
        normal_cdf(F.lit(1.96)).alias("a"), normal_ppf(F.lit(0.975)).alias("b"), t_two_sided(F.lit(2.228), F.lit(10.0)).alias("c"), chi2_tail(F.lit(3.841), F.lit(1.0)).alias("d"), f_tail(F.lit(4.965), F.lit(1.0), F.lit(10.0)).alias("e"),
    ).first()
    assert abs(r.a - 0.975) < 1e-4 and abs(r.b - 1.96) < 1e-3 and abs(r.c - 0.05) < 1e-4 and abs(r.d - 0.05) < 1e-4 and abs(r.e - 0.05) < 1e-4


def test_break_is_found(spark):
    rows = [("s", D(2020, 1, 1) + dt.timedelta(i), (0.0 if i < 40 else 1.0) + 0.1 * math.sin(5 * i)) for i in range(100)]
    s = inference.sup_f(spark.createDataFrame(rows, "series_id string, date date, ret double"))
    r = s.withColumn("p", inference.hansen_pvalue(F.col("sup_f"))).first()
    assert r.n_pre == 40 and r.p < 0.001
    p = spark.range(1).select(inference.hansen_pvalue(F.lit(8.85)).alias("p")).first().p
    assert abs(p - 0.05) < 0.01


def test_delisting_rows_lose(spark):
    p = spark.createDataFrame([(1, D(2020, 1, 1), 0.1, False)], "permno long, date date, ret double, is_delisting boolean")
    both = panel.with_delistings(p, spark.createDataFrame([(1, D(2020, 1, 1), -0.5)], "permno long, date date, ret double"))
    assert both.count() == 2 and [r.ret for r in panel.one_row_per_day(both).collect()] == [0.1]


def test_factor_file_block(spark):
    lines = spark.createDataFrame([("note",), ("202001, 1.0, x",), ("2020, 5, 5",)], "value string")
    assert [(r.date, r.a, r.b) for r in io.parse_factor_lines(lines, ["a", "b"]).collect()] == [(D(2020, 1, 31), 1.0, None)]


def _norm(v):
    if isinstance(v, float):
        return v + 0.0
    return str(v)[:10] if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, name):
    """Queries round their doubles; a value at a rounding edge may fall to either side, one unit of its last place apart."""
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'" if os.path.isfile(f"{SF}/{t}.parquet") else f"create view {t} as select * from '{SF}/{t}.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    rel = con.sql(catalog.SQL[name])
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    key = lambda r: tuple("" if v is None else "" if isinstance(v, float) else str(v) for v in r) + tuple(round(v, 5) if isinstance(v, float) else 0.0 for v in r) + tuple(v if isinstance(v, float) else 0.0 for v in r)
    mine = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=key)
    other = sorted((tuple(_norm(r[i]) for i in at) for r in rel.fetchall()), key=key)
    assert len(mine) == len(other)
    places = [max((len(repr(v).partition(".")[2]) if "e" not in repr(v) else 9 for r in (*mine, *other) if isinstance(v := r[i], float)), default=0) for i in range(len(cols))]
    for a, b in zip(mine, other, strict=True):
        for x, y, n in zip(a, b, places, strict=True):
            assert x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1.01 * 10.0**-n)) or str(x) == str(y), (name, a, b)
