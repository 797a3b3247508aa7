"""What the large panels shuffle and sort, read off the plans, and the values of the operators concerned."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from panelspark.functions.distributions import chi2_tail
from panelspark.functions.windows import trailing_sums
from panelspark.operators import portfolio, signals
from panelspark.operators import xs as cross
from panelspark.plans import adapters, q_core, q_panel

SF = "/root/testdata/sf0.001"
D = dt.date


def plan(df) -> list[str]:
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def dealt_by(df, *names: str) -> bool:
    """Whether the plan shuffles by all of the names."""
    return any("Exchange hashpartitioning(" in line and all(f"{n}#" in line.split("hashpartitioning(")[1] for n in names) for line in plan(df))


def some_prices(spark, names=5, days=90, seed=3):
    r = random.Random(seed)
    rows = [(i, D(2020, 1, 1) + dt.timedelta(k), r.choice((0.0, 0.01, -0.02)), float(r.choice((0, 5)))) for i in range(names) for k in range(days) if r.random() < 0.7]
    return rows, spark.createDataFrame(rows, "permno long, date date, ret double, vol double")


def test_betas_and_rolling_regressions_shuffle_no_day_of_a_security_again(spark):
    ivol = signals.idiosyncratic_volatility(adapters.returns_daily(spark, SF), adapters.factors_daily(spark, SF))
    for df in (q_core.beta_panel(spark, SF), ivol):
        assert sum("Exchange hashpartitioning(" in line and ("permno#" in line or "l_suppkey#" in line) for line in plan(df)) == 1


def test_trailing_sums_sort_once(spark):
    rows, df = some_prices(spark)
    got = trailing_sums(df, {"a": F.col("ret"), "b": F.col("ret") * F.col("vol")}, 7)
    assert sum("Sort [" in line for line in plan(got)) == 1
    for i in range(5):
        own = sorted((r[1], r[2], r[3]) for r in rows if r[0] == i)
        want = [(sum(x[1] for x in own[max(0, k - 6) : k + 1]), sum(x[1] * x[2] for x in own[max(0, k - 6) : k + 1])) for k in range(len(own))]
        have = [(r.a, r.b) for r in got.filter(F.col("permno") == i).orderBy("date").collect()]
        assert [v for w in have for v in w] == pytest.approx([v for w in want for v in w], abs=1e-12)


def test_realized_returns_repeat_no_weight_per_day(spark):
    rows, df = some_prices(spark)
    weights = [(D(2020, 1, 10), i, 0.1 * i) for i in range(7)] + [(D(2020, 2, 10), i, -0.2 * i) for i in range(4)] + [(D(2021, 1, 1), 0, 1.0)]
    got = portfolio.realized_returns(spark.createDataFrame(weights, "date date, permno long, weight double"), df, 5)
    assert not dealt_by(got, "permno", "day")
    days = sorted({r[1] for r in rows})
    ret = {(r[0], r[1]): r[2] for r in rows}
    want = {}
    for date in {w[0] for w in weights}:
        held = [d for d in days if d > date][:5]
        if held:
            total = 0.0
            for _, i, w in (x for x in weights if x[0] == date):
                g = 1.0
                for d in held:
                    g *= 1 + ret.get((i, d), 0.0)
                total += w * (g - 1)
            want[date] = (pytest.approx(total), sum(x[0] == date for x in weights))
    assert {r.date: (r.realized_return, r.n_names) for r in got.collect()} == want


def test_zero_volume_share_repeats_no_row_per_date(spark):
    rows, df = some_prices(spark)
    dates = [D(2019, 12, 31), D(2020, 1, 2), D(2020, 1, 31), D(2020, 2, 1), D(2020, 3, 20), D(2020, 6, 30)]
    got = portfolio.zero_volume_share(df, spark.createDataFrame([(d,) for d in dates], "date date"), 9)
    assert not dealt_by(got, "permno", "k")
    want = {}
    for i in range(5):
        for date in dates:
            last = sorted(r for r in rows if r[0] == i and r[1] <= date)[-9:]
            if last:
                top = now = 0
                for r in last:
                    now = now + 1 if r[2] == 0 else 0
                    top = max(top, now)
                want[date, i] = (pytest.approx(sum(r[3] == 0 for r in last) / len(last)), top, len(last))
    assert {(r.date, r.permno): (r.zero_share, r.longest_run, r.n_rows) for r in got.collect()} == want


def test_residuals_as_of_shuffle_no_member_and_month(spark):
    months = spark.createDataFrame([(i, D(2020, m, 1), D(2020, m, 28), ((i * 7 + m * 3) % 11) / 100, 10.0 + i * i + m, "ab"[i % 2]) for i in range(8) for m in range(1, 7)], "permno long, month date, last_date date, ret double, marketcap double, ggroup string")
    members = spark.createDataFrame([(D(2020, 5, 29), i) for i in range(7)] + [(D(2020, 6, 30), i) for i in range(2, 8)], "date date, permno long")
    got = signals.cross_residual_as_of(months, members, 3)
    assert not dealt_by(got, "permno", "month")
    have = {(r.rebalance_date, r.month, r.permno): r.residual for r in got.collect()}
    want = {}
    for date, names in ((D(2020, 5, 29), range(7)), (D(2020, 6, 30), range(2, 8))):
        near = months.filter(F.col("permno").isin(*names) & F.col("month").between(D(2020, date.month - 2, 1), D(2020, date.month, 1)))
        want |= {(date, r.month, r.permno): r.residual for r in signals.cross_residual(near).collect()}
    assert have == pytest.approx(want, abs=1e-12)


def test_composites_read_each_panel_once(spark):
    r = random.Random(5)
    panel = lambda n: spark.createDataFrame([(D(2020, 1, 1 + k), i, r.random() if r.random() < 0.8 else None) for k in range(3) for i in range(n)], "date date, permno long, z_score double")
    panels = {"gp": panel(9), "ivol": panel(8), "resmom": panel(9), "pead": panel(7)}
    variants = {"3sig": ("gp", "ivol", "resmom"), "4sig": tuple(panels), "no_resmom": ("gp", "ivol", "pead")}
    got = cross.composites(panels, variants)
    assert sum("Union" in line for line in plan(got)) == 1
    for v, use in variants.items():
        cols = ["date", "permno", "n_signals", "composite_raw", "composite_z"]
        one = cross.composite({n: panels[n] for n in use}).select(*cols)
        have, want = ({(c, r.date, r.permno): r[c] for r in df.collect() for c in cols[2:]} for df in (got.filter(F.col("variant") == v), one))
        assert have == pytest.approx(want)


def test_texts_move_once_and_terms_stay_with_their_document(spark):
    docs = q_panel.latest_texts(spark, SF, q_panel.latest(spark, SF))
    words = docs.select("section_id", "doc_id", F.explode(F.split("text", " ")).alias("term")).groupBy("section_id", "doc_id", "term").count()
    assert not dealt_by(words, "term")
    want = signals.latest_filing(adapters.sections(spark, SF)).select("doc_id", "text")
    assert sorted(map(tuple, docs.select("doc_id", "text").collect())) == sorted(map(tuple, want.collect()))


def test_yearly_cosine_moves_vectors_to_pairs_only(spark):
    docs = spark.createDataFrame([(1, "Item 1", y, 10 + y) for y in (0, 1, 2, 4)] + [(1, "Item 7", y, 20 + y) for y in (0, 1)] + [(2, "Item 1", 1, 31)], "permno long, section_id string, year int, doc_id long")
    vectors = spark.createDataFrame([(10, "Item 1", [1, 2], [0.6, 0.8]), (11, "Item 1", [2, 5], [0.8, 0.6]), (14, "Item 1", [2], [1.0]), (20, "Item 7", [3], [1.0]), (21, "Item 7", [4], [1.0])], "doc_id long, section_id string, ids array<long>, weights array<double>")
    got = signals.yearly_cosine(docs, vectors)
    assert not dealt_by(got.select("similarity"), "permno", "section_id") or not any("Window" in line and "ids#" in line for line in plan(got))
    assert {(r.permno, r.section_id, r.year): r.similarity for r in got.collect()} == {(1, "Item 1", 1): pytest.approx(0.64), (1, "Item 1", 2): 0.0, (1, "Item 7", 1): 0.0}


def test_chi2_tail_of_a_large_statistic_is_zero(spark):
    """The case of breusch_pagan on six copies of sf0.1, where its SQL's series of 400 terms ends too early."""
    assert spark.range(1).select(chi2_tail(F.lit(920.415207), F.lit(5.0)).alias("p")).first().p == pytest.approx(0, abs=1e-12)
