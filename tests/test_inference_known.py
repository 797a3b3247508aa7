"""Regressions, diagnostics and inference against numpy and published values; sources and sinks round trip."""

import datetime as dt
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.functions import windows
from panelspark.operators import inference, panel, portfolio, regression, signals
from panelspark.operators import xs as cross
from panelspark.sources import io

D = dt.date


@pytest.fixture(scope="module")
def lines(spark):
    r = np.random.default_rng(3)
    rows, data = [], {}
    for key in ("a", "b"):
        x = np.column_stack([np.ones(60), r.normal(size=(60, 2))])
        y = x @ [0.01, 0.5, -0.2] + r.normal(size=60) * (1 + (key == "b") * np.abs(x[:, 1]))
        if key == "b":
            y[35:] += 3.0
        data[key] = (y, x)
        rows += [(key, D(2020, 1, 1) + dt.timedelta(i), float(y[i]), *map(float, x[i])) for i in range(60)]
    rows.append(("a", D(2021, 1, 1), None, 1.0, 0.0, 0.0))
    return spark.createDataFrame(rows, "series_id string, date date, ret double, one double, u double, v double"), data


X = ["one", "u", "v"]


def test_influence_of_any_design(lines):
    df, data = lines
    got = regression.influence(df, ["series_id"], "ret", X).orderBy("series_id", "date").collect()
    for key, (y, x) in data.items():
        own = [g for g in got if g.series_id == key]
        h = x @ np.linalg.inv(x.T @ x) @ x.T
        e, lev = y - h @ y, np.diag(h)
        assert np.allclose([g.residual for g in own], e) and np.allclose([g.leverage for g in own], lev)
        assert np.allclose([g.cooks for g in own], e**2 * lev / (3 * (e @ e / 60) * (1 - lev) ** 2))


def test_breusch_pagan_of_any_design(lines):
    df, data = lines
    for g in regression.breusch_pagan(df, ["series_id"], "ret", X).collect():
        y, x = data[g.series_id]
        e2 = (y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2
        left = e2 - x @ np.linalg.lstsq(x, e2, rcond=None)[0]
        r2 = 1 - left @ left / ((e2 - e2.mean()) @ (e2 - e2.mean()))
        assert g.lm == pytest.approx(60 * r2) and g.lm_p == pytest.approx(math.exp(-30 * r2)) and g.f == pytest.approx(r2 / 2 / ((1 - r2) / 57)) and 0 <= g.f_p <= 1


def test_hac_covariance_is_a_matrix(lines):
    df, data = lines
    got = {(g.series_id, g.lag, g.term_i, g.term_j): g["cov"] for g in regression.hac_covariance(df.dropna(), "series_id", "ret", X, [0, 4]).collect()}
    for key, (y, x) in data.items():
        for lag in (0, 4):
            want = inference.ols_hac(y, x, lag)[1]
            assert np.allclose([[got[key, lag, p, q] for q in X] for p in X], want)


def test_sup_f_of_any_design(lines):
    df, data = lines
    squared = lambda y, x: ((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum()
    for g in regression.sup_f(df.dropna(), "series_id", "ret", X).collect():
        y, x = data[g.series_id]
        f = {t: ((squared(y, x) - (u := squared(y[:t], x[:t]) + squared(y[t:], x[t:]))) / 3) / (u / 54) for t in range(9, 52)}
        best = max(f, key=f.get)
        assert g.n_pre == best and g.sup_f == pytest.approx(f[best]) and g.break_at == D(2020, 1, 1) + dt.timedelta(best)
        assert 0 <= g.p_value <= 1


def test_break_p_values(spark):
    one = spark.createDataFrame([(8.85,), (0.1,)], "f double")
    got = [r.p for r in one.select(inference.hansen_pvalue(F.col("f")).alias("p")).collect()]
    assert got[0] == pytest.approx(0.05, abs=0.006) and got[1] == 1
    with pytest.raises(ValueError, match="not tabulated"):
        inference.hansen_pvalue(F.col("f"), 1, 0.2)


def test_subsample_alpha_by_hand(spark):
    r = np.random.default_rng(4)
    x, y = r.normal(size=40), None
    y = 0.3 + 0.5 * x + r.normal(size=40) * 0.1
    df = spark.createDataFrame([("s", D(2020, 1, 1) + dt.timedelta(i), float(y[i]), float(x[i])) for i in range(40)], "series_id string, date date, ret double, mktrf double")
    got = {g.side: g for g in inference.subsample_alpha(df, ["2020-01-21"]).collect()}
    for side, part in (("pre", slice(0, 20)), ("post", slice(20, 40))):
        d = np.column_stack([np.ones(20), x[part]])
        b = np.linalg.lstsq(d, y[part], rcond=None)[0]
        e = y[part] - d @ b
        se = np.sqrt(e @ e / 18 * np.linalg.inv(d.T @ d)[0, 0])
        assert got[side].alpha == pytest.approx(b[0]) and got[side].beta == pytest.approx(b[1]) and got[side].t_alpha == pytest.approx(b[0] / se)
    assert inference.subsample_alpha(df, ["2020-01-04"]).filter("side = 'pre' and alpha is null").count() == 1


def test_quantile_points_and_expected_best(spark):
    q = inference.qq_points(spark.createDataFrame([("m", float(v)) for v in (3, 1, 2)], "month string, residual double"), ["month"]).orderBy("i").collect()
    assert [p.observed for p in q] == [1, 2, 3] and q[1].theoretical == pytest.approx(0) and q[0].p == pytest.approx(1 - 0.5 ** (1 / 3))
    t = spark.createDataFrame([("f", 0.1), ("f", 0.3), ("g", 0.2)], "family string, sharpe double")
    got = {r.family: r.expected_max for r in inference.expected_max_sharpe(t).collect()}
    from statistics import NormalDist

    z = NormalDist().inv_cdf
    assert got["g"] is None and got["f"] == pytest.approx(np.std([0.1, 0.3], ddof=1) * ((1 - inference.EULER) * z(0.5) + inference.EULER * z(1 - 1 / (2 * math.e))))
    d = spark.createDataFrame([(0.2, 0.1, 61, 0.0, 3.0)], "sr double, b double, n long, s double, k double")
    p = d.select(inference.deflated_sharpe(*(F.col(c) for c in ("sr", "b", "n", "s", "k"))).alias("p")).first().p
    assert p == pytest.approx(NormalDist().cdf(0.1 * math.sqrt(60) / math.sqrt(1 + 0.5 * 0.04)))


def test_synthetic_trials_keep_mean_and_deviation(spark):
    stats = spark.createDataFrame([("f", 0.5, 0.2)], "family string, mean double, sd double")
    for n in (3, 7, 20):
        x = [r.sharpe for r in inference.synthetic_trials(stats, n).collect()]
        assert len(x) == n and np.mean(x) == pytest.approx(0.5) and np.std(x, ddof=1) == pytest.approx(0.2)


def test_durbin_watson_of_known_series(spark):
    rows = [("up", i, float(i - 4.5)) for i in range(10)] + [("flip", i, float((-1) ** i)) for i in range(10)] + [("zero", i, 0.0) for i in range(3)]
    got = {r.permno: r.dw for r in inference.durbin_watson(spark.createDataFrame(rows, "permno string, month int, residual double"), ["permno"], "month").collect()}
    assert got["up"] == pytest.approx(9 / 82.5) and got["flip"] == pytest.approx(3.6) and got["zero"] is None


def test_breusch_pagan_needs_an_intercept(lines):
    df, _ = lines
    with pytest.raises(Exception, match="intercept"):
        regression.breusch_pagan(df, ["series_id"], "ret", ["u", "v"]).collect()
    with pytest.raises(ValueError, match="intercept"):
        regression.breusch_pagan(df, ["series_id"], "ret", ["one"])


@pytest.fixture(scope="module")
def panel_of_returns(spark):
    """Twelve names over 90 days with gaps, and two dates with universes of their own."""
    r = np.random.default_rng(5)
    x = r.normal(size=(90, 12)) * 0.01
    gone = r.random((90, 12)) < 0.01
    day = [D(2020, 1, 1) + dt.timedelta(i) for i in range(90)]
    rows = [(k, day[i], None if gone[i, k] and i % 2 else float(x[i, k])) for i in range(90) for k in range(12) if not (gone[i, k] and i % 2 == 0)]
    rows += [(99, D(2020, 1, 1) + dt.timedelta(i), 0.5) for i in range(3)]  # a name of no universe
    known = np.where(gone, np.nan, x)
    universe = {day[40]: list(range(9)), day[75]: [0, 2, 4, 5, 6, 7, 8, 9, 10, 11], day[10]: [1, 2, 3]}
    members = [(d, k) for d, names in universe.items() for k in names]
    return spark.createDataFrame(rows, "permno long, date date, ret double"), spark.createDataFrame(members, "date date, permno long"), day, known, universe


@pytest.mark.parametrize("shrink", [False, True])
def test_covariance_per_date_over_complete_days(panel_of_returns, monkeypatch, shrink):
    monkeypatch.setattr(portfolio, "BLOCK", 4)
    returns, members, day, known, universe = panel_of_returns
    got = portfolio.covariance(returns, members, 30, shrink=shrink, periods=2.0).collect()
    assert {g.date for g in got} == {day[40], day[75]}  # the first date has too few days behind it
    for at in (day[40], day[75]):
        names = universe[at]
        past = known[: day.index(at) + 1, names]
        past = past[~np.isnan(past).all(axis=1)][-30:]
        whole = past[~np.isnan(past).any(axis=1)]
        want = np.cov(whole.T, bias=True)
        shrinkage = 0.0
        if shrink:
            sd = np.sqrt(np.outer(np.diag(want), np.diag(want)))
            off = ~np.eye(len(names), dtype=bool)
            target = np.where(off, (want / sd)[off].mean() * sd, want)
            c = whole - whole.mean(0)
            pi = (((c * c).T @ (c * c)) / len(c) - want**2).sum()
            shrinkage = min(1.0, max(0.0, pi / ((target - want) ** 2).sum() / len(c)))
            want = shrinkage * target + (1 - shrinkage) * want
        own = [g for g in got if g.date == at]
        assert len(own) == len(names) * (len(names) + 1) // 2 and all(g.permno_i <= g.permno_j for g in own)
        assert all(g["cov"] == pytest.approx(2 * want[names.index(g.permno_i), names.index(g.permno_j)], rel=1e-9) and g.shrinkage == pytest.approx(shrinkage) for g in own)


def test_trailing_sums_meet_every_frame(spark):
    r = np.random.default_rng(2)
    rows = [(k, i, float(r.normal() + 100)) for k in (1, 2) for i in range(25 if k == 1 else 4)]
    df = spark.createDataFrame(rows, "permno long, date int, x double")
    got = {(g.permno, g.date): (g.s, g.q) for g in windows.trailing_sums(df, {"s": F.col("x"), "q": F.col("x") * F.col("x")}, 7).collect()}
    for k in (1, 2):
        own = [x for p, _, x in rows if p == k]
        for i in range(len(own)):
            last = np.array(own[max(0, i - 6) : i + 1])
            assert got[k, i] == (pytest.approx(last.sum(), rel=1e-14), pytest.approx((last**2).sum(), rel=1e-14))


def test_rolling_durbin_watson_of_explicit_residuals(spark):
    r = np.random.default_rng(8)
    x, y = r.normal(size=(40, 3)), r.normal(size=40)
    df = spark.createDataFrame([(1, i, float(y[i]), *map(float, x[i])) for i in range(40)], "permno long, date int, y double, a double, b double, c double")
    got = {g.date: g for g in signals.rolling_durbin_watson(df, "y", ["a", "b", "c"], 15).collect()}
    assert sorted(got) == list(range(14, 40))
    for i in range(14, 40):
        xs, ys = np.column_stack([np.ones(15), x[i - 14 : i + 1]]), y[i - 14 : i + 1]
        coef = np.linalg.lstsq(xs, ys, rcond=None)[0]
        e = ys - xs @ coef
        assert got[i].b2 == pytest.approx(coef[2]) and got[i].dw == pytest.approx((np.diff(e) ** 2).sum() / (e @ e)) and got[i].residual_std == pytest.approx(math.sqrt(e @ e / 14))


def _inside(v, group, beta, gross, cap):
    """A vector made to meet all constraints by neutralising and shrinking it."""
    for _ in range(2):
        v = v - (np.bincount(group, v) / np.bincount(group))[group]
        b = beta - (np.bincount(group, beta) / np.bincount(group))[group]
        v = v - (v @ b) / (b @ b) * b
    return v * min(1.0, cap / np.abs(v).max(), gross / np.abs(v).sum())


@pytest.mark.parametrize(("gross", "cap", "strength"), [(1.0, 0.05, 1.5), (1.5, 0.2, 4.0), (1.0, 0.02, 1.0)])
def test_neutral_weights_are_the_nearest_allowed(spark, gross, cap, strength):
    """All constraints hold, and no allowed portfolio lies on the target's side of the weights."""
    r = np.random.default_rng(11)
    rows, data = [], {}
    for at in (D(2020, 1, 31), D(2020, 2, 29)):
        alpha, beta, group = r.normal(size=60), r.normal(1, 0.4, size=60), r.integers(0, 5, size=60)
        data[at] = alpha, beta, group
        rows += [(at, k, float(alpha[k]), float(beta[k]), f"s{group[k]}") for k in range(60)]
    rows += [(D(2020, 1, 31), 100, None, 1.0, "s1"), (D(2020, 1, 31), 101, 1.0, 1.0, None), (D(2020, 3, 31), 1, 2.0, 1.0, "s1")]
    df = spark.createDataFrame(rows, "date date, permno long, alpha double, beta double, sector string")
    got = cross.neutral_weights(df, gross=gross, cap=cap, strength=strength).collect()
    assert {(g.date, g.permno): g.weight for g in got if g.permno >= 100 or g.date == D(2020, 3, 31)} == {(D(2020, 1, 31), 100): 0.0, (D(2020, 1, 31), 101): 0.0, (D(2020, 3, 31), 1): 0.0}
    for at, (alpha, beta, group) in data.items():
        w = np.array([g.weight for g in sorted(got, key=lambda g: g.permno) if g.date == at and g.permno < 100])
        assert np.abs(np.bincount(group, w)).max() < 1e-8 and abs(w @ beta) < 1e-8 and np.abs(w).max() <= cap + 1e-8 and np.abs(w).sum() <= gross + 1e-8
        free = _inside(alpha, group, beta, 1e9, 1e9)
        target = free * strength * min(gross, 60 * cap) / np.abs(free).sum()
        others = [_inside(target + s * r.normal(size=60), group, beta, gross, cap) for s in (0.0, 0.001, 0.01, 0.05) for _ in range(50)] + [w + t * (_inside(r.normal(size=60), group, beta, gross, cap) - w) for t in (0.01, 0.1) for _ in range(50)]
        assert max((target - w) @ (o - w) for o in others) < 1e-9


def test_joint_bootstrap_equals_drawn_rows(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(50, 3)) * 0.02
    y = 0.004 + x @ [0.5, -0.2, 0.1] + r.normal(size=50) * 0.01
    df = spark.createDataFrame([("s", D(2020, 1, 1) + dt.timedelta(i), float(y[i]), *map(float, x[i])) for i in range(50)], "series_id string, date date, ret double, a double, b double, c double")
    got = {g.block: g for g in inference.bootstrap_joint(df, ["a", "b", "c"], (3, 8, 60), replicates=40).collect()}
    assert sorted(got) == [3, 8]  # a block longer than the series is left out
    for block, g in got.items():
        rows = sorted((q.replicate, q.i) for q in inference.block_replicates(df, block, 40).collect())
        sharpe, alpha = [], []
        for k in range(40):
            at = [i for q, i in rows if q == k]
            assert len(at) == 50
            sharpe.append(y[at].mean() / y[at].std(ddof=1) * math.sqrt(12))
            alpha.append(np.linalg.lstsq(np.column_stack([np.ones(50), x[at]]), y[at], rcond=None)[0][0] * 12)
        assert (g.sharpe_low, g.sharpe_high) == pytest.approx(tuple(np.percentile(sharpe, [2.5, 97.5]))) and (g.alpha_low, g.alpha_high) == pytest.approx(tuple(np.percentile(alpha, [2.5, 97.5])))
        assert g.alpha_p == pytest.approx(min(1, 2 * min(np.mean(np.array(alpha) <= 0), np.mean(np.array(alpha) >= 0))))


def test_residual_momentum_depends_on_the_universe(spark):
    """Regressions of a date hold its own universe only; numpy repeats them with dummies."""
    r = np.random.default_rng(9)
    names, months = range(14), [D(2019 + i // 12, i % 12 + 1, 1) for i in range(18)]
    ends = [(D(2019 + (i + 1) // 12, (i + 1) % 12 + 1, 1) - dt.timedelta(1)) for i in range(18)]
    table = {(k, i): (float(r.normal()), float(r.uniform(1, 9))) for k in names for i in range(18) if not (k == 3 and i == 12)}
    rows = spark.createDataFrame([(k, months[i], ends[i], y, m, f"g{k % 3}") for (k, i), (y, m) in table.items()], "permno long, month date, last_date date, ret double, marketcap double, ggroup string")
    universe = {ends[15]: list(range(12)), ends[17] - dt.timedelta(1): [0, 1, 2, 3, 5, 7, 8, 9, 11, 13]}
    members = spark.createDataFrame([(d, k) for d, u in universe.items() for k in u], "date date, permno long")
    resid = signals.cross_residual_as_of(rows, members)
    got = {(g.rebalance_date, g.month, g.permno): g.residual for g in resid.collect()}
    seen = {(g.rebalance_date, g.permno): g for g in signals.residual_momentum_as_of(resid).collect()}
    for at, own in universe.items():
        last = max(i for i in range(18) if ends[i] <= at)
        want = {}
        for i in range(last + 1):
            here = [k for k in own if (k, i) in table]
            y = np.array([table[k, i][0] for k in here])
            x = np.column_stack([[k % 3 == g for k in here] for g in range(3)] + [[math.log(table[k, i][1]) for k in here]]).astype(float)
            e = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
            want |= {(k, i): v for k, v in zip(here, e, strict=True)}
        assert {(m, k) for d, m, k in got if d == at} == {(months[i], k) for k, i in want}
        assert all(got[at, months[i], k] == pytest.approx(v, abs=1e-9) for (k, i), v in want.items())
        for k in own:
            mine = [want[k, i] for i in range(last + 1) if (k, i) in want]
            assert seen[at, k].raw_signal == pytest.approx(sum(mine[-13:-2])) and seen[at, k].n_obs == 11


def test_checkpoint_is_taken_up_again(spark, tmp_path):
    dates = spark.createDataFrame([(D(2020, m, 1),) for m in range(1, 11)], "rebalance_date date")
    asked: list = []

    def compute(open_dates, broken=False):
        if not open_dates.isEmpty():
            asked.extend(sorted(r[0] for r in open_dates.collect()))
        weight = F.when(F.month("rebalance_date") == 6, F.raise_error("killed")).otherwise(F.month("rebalance_date").cast("double")) if broken else F.month("rebalance_date").cast("double")
        each = open_dates.withColumn("permno", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("weight", weight)
        return each.filter(F.month("rebalance_date") != 3)  # a date without rows is finished all the same

    root = f"file://{tmp_path}/run"
    with pytest.raises(Exception, match="killed"):
        io.resumable(dates, lambda d: compute(d, True), root, batch=2)
    assert [d.month for d in asked] == [1, 2, 3, 4, 5, 6]
    half = [r[0].month for r in io.finished(spark, root, dates.schema["rebalance_date"]).collect()]
    assert sorted(half) == [1, 2, 3, 4]
    asked.clear()
    got = io.resumable(dates, compute, root, batch=4)
    assert [d.month for d in asked] == [5, 6, 7, 8, 9, 10]
    assert sorted((r.rebalance_date.month, r.permno, r.weight) for r in got.collect()) == [(m, k, float(m)) for m in (1, 2, 4, 5, 6, 7, 8, 9, 10) for k in (1, 2)]
    asked.clear()
    assert io.resumable(dates, compute, root).count() == 18 and not asked


def test_period_inputs_gives_the_first_reason(spark):
    day = [D(2020, 1, 1) + dt.timedelta(i) for i in range(100)]
    returns = spark.createDataFrame([(k, day[i], 0.01) for k in range(6) for i in range(5, 95) if (i + k) % 2], "permno long, date date, ret double")
    at = {0: "no returns up to the date", 20: "no composite", 30: "short covariance window", 60: None, 70: "few common names", 90: "short holding period", 97: "no returns after the date", 99: "no universe"}
    members = spark.createDataFrame([(day[i], k) for i in at for k in range(6) if i != 99], "date date, permno long")
    composite = spark.createDataFrame([(day[i], k, None if k == 5 else 1.0) for i in at for k in range(6) if i not in (20, 99) and not (i == 70 and k < 3)], "date date, permno long, composite_z double")
    both = members.withColumns({"beta": F.lit(1.0), "sector": F.lit("s")})
    dates = spark.createDataFrame([(day[i],) for i in at], "date date")
    got = {g.date: g for g in portfolio.period_inputs(dates, members, returns, composite, both, both, window=40, holding=10, least=5).collect()}
    assert {(d - day[0]).days: g.skip_reason for d, g in got.items()} == at
    fine = got[day[60]]
    assert (fine.n_universe, fine.n_common, fine.n_alpha, fine.n_days, fine.n_holding) == (6, 6, 5, 56, 34)


def test_holding_and_idle_rows_by_number(spark):
    days = [(1, D(2020, 1, 1) + dt.timedelta(i * (1 if i < 5 else 9)), 0.01 * (i % 3), float(i % 2)) for i in range(12)]
    px = spark.createDataFrame(days, "permno long, date date, ret double, vol double")
    at = spark.createDataFrame([(D(2020, 1, 3),), (D(2019, 1, 1),)], "date date")
    got = {r.rebalance_date: (r.n_days, round(r.fwd_return, 9)) for r in portfolio.forward_returns(px, at, 4, max_days=1.5).collect()}
    assert got[D(2020, 1, 3)] == (2, round((1 + 0.01 * 0) * (1 + 0.01 * 1) - 1, 9)) and D(2019, 1, 1) not in got
    z = portfolio.zero_volume_share(px, at, n=3).collect()
    assert [(r.date, round(r.zero_share, 9), r.longest_run, r.n_rows) for r in z] == [(D(2020, 1, 3), round(2 / 3, 9), 1, 3)]
    adv = {r.date: r.adv for r in panel.trailing_adv(px.withColumn("prc", F.lit(-2.0)), at, 2).collect()}
    assert adv == {D(2020, 1, 3): 1.0}


def test_dated_files_and_filings(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/d/day=2020-02-01")
    spark.range(2).write.parquet(f"{tmp_path}/d/snap-2021-03-04")
    spark.range(1).write.parquet(f"{tmp_path}/d/other")
    got = {(r.file_date, r.n) for r in io.read_dated(spark, f"{tmp_path}/d").groupBy("file_date").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {(D(2020, 2, 1), 3), (D(2021, 3, 4), 2), (None, 1)}
    (tmp_path / "f.json").write_text('{"cik":"1","filings":{"recent":{"form":["10-K","10-K","8-K"],"accessionNumber":["a","a","b"],"filingDate":["2020-02-02","2020-01-02","2020-01-01"],"reportDate":["2020-01-01","2020-01-01","2020-01-01"],"primaryDocument":["x","y","z"]},"files":[]}}')
    assert [(r.accession_number, r.filing_date) for r in io.filings(spark.read.schema(io.FILINGS).json(f"{tmp_path}/f.json")).collect()] == [("a", D(2020, 1, 2))]


def test_csv_parquet_and_factor_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "i long, s string")
    assert {tuple(r) for r in io.load_csv(spark, io.save_csv(df, f"{tmp_path}/c"), "i long, s string").collect()} == {(1, "a,b"), (2, None)}
    assert io.load_parquet(spark, io.save_parquet(df, f"{tmp_path}/p", "zstd"), ["s"]).columns == ["s"]
    with pytest.raises(ValueError, match="codec"):
        io.save_parquet(df, f"{tmp_path}/q", "none at all")
    (tmp_path / "ff.txt").write_text("note\n202001, 1, 2, 3, 4, 5, 0.1\n2020, 9, 9, 9, 9, 9, 9\n")
    (tmp_path / "mom.txt").write_text("202001, 7\n")
    row = io.read_factors(spark, f"{tmp_path}/ff.txt", f"{tmp_path}/mom.txt").collect()
    assert len(row) == 1 and row[0].date == D(2020, 1, 31) and (row[0].mkt_rf, row[0].rf, row[0].mom) == (1, 0.1, 7)


def test_sparse_vectors_equal_explicit_weights(spark, tmp_path, monkeypatch):
    """Vectors, rows and yearly cosines of three corpora against counters; every split of common and rare terms gives the same."""
    texts = ["Alpha beta beta, the gamma2 x alpha-delta", "beta of gamma", "", "the of and", "alpha gamma gamma delta epsilon", "Delta beta alpha", None]
    rows = [(k, "Item 1" if k % 2 else "Item 7", t) for k, t in enumerate(texts * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, section_id string, text string").withColumns({"permno": F.lit(1).cast("long"), "year": (F.col("doc_id") + 2000).cast("int")})
    want = {}
    for section in ("Item 1", "Item 7"):
        own = {k: Counter(w for w in re.split(r"[^\w]+", (t or "").lower()) if re.fullmatch("[a-z]{2,}", w) and w not in ("the", "of", "and")) for k, s, t in rows if s == section}
        df = Counter(w for c in own.values() for w in c)
        for k, c in own.items():
            v = {w: n * (math.log((1 + len(own)) / (1 + df[w])) + 1) for w, n in c.items() if df[w] >= 2}
            size = math.sqrt(sum(x * x for x in v.values()))
            want |= {(k, w): x / size for w, x in v.items()}

    def keep(df):
        path = f"file://{tmp_path}/{len(list(tmp_path.iterdir()))}"
        df.write.parquet(path)
        return spark.read.parquet(path)

    for common in (1, 3, 1000):
        monkeypatch.setattr(signals, "COMMON", common)
        got = {(g.doc_id, g.term): g.weight for g in signals.term_weights(docs, keep).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())
        vectors = signals.term_vectors(docs, keep)
        for g in vectors.collect():
            assert g.ids == sorted(g.ids) and sorted(g.weights) == pytest.approx(sorted(v for (k, _), v in want.items() if k == g.doc_id))
        for g in signals.yearly_cosine(docs.withColumn("year", (F.col("doc_id") / 2).cast("int")), vectors).collect():
            k = 2 * g.year + (g.section_id == "Item 1")
            assert g.similarity == pytest.approx(sum(v * want.get((k - 2, w), 0) for (d, w), v in want.items() if d == k), abs=1e-12)


@pytest.mark.parametrize("pushed", [2, 1000])
def test_warehouse_reads_each_row_once(spark, monkeypatch, pushed):
    """Slices of the window, their edges and ids, short and long lists, decimals as doubles."""
    monkeypatch.setattr(io, "PUSHED_IDS", pushed)
    url, driver = f"jdbc:derby:memory:test{pushed};create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rows = [(k, D(2020, 1, 1) + dt.timedelta(i), f"{k}.{i:03d}") for k in range(6) for i in range(40)]
    spark.createDataFrame(rows, "permno long, date date, x string").withColumn("ret", F.col("x").cast("decimal(9,3)")).write.jdbc(url, "facts", properties={"driver": driver})
    for ids, start, end in (([1, 3, 4, 9], "2020-01-05", "2020-02-03"), ([2], "2020-01-07", "2020-01-07"), ([], "2020-01-01", "2020-03-01"), ([0, 5, 5], "2020-01-30", "2021-01-01")):
        want = spark.createDataFrame([(i,) for i in ids], "permno long")
        got = io.read_jdbc(spark, url, "facts", ["permno", "date", "ret"], want, start, end, parts=7, driver=driver)
        assert got.schema["ret"].dataType.typeName() == "double"
        assert sorted(map(tuple, got.collect())) == sorted((k, d, float(x)) for k, d, x in rows if k in ids and start <= str(d) <= end)
