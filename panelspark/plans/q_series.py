"""Queries of trading costs, series metrics, diagnostics and inference."""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.distributions import normal_cdf as spark_normal_cdf
from ..operators import costs, inference, portfolio, regression, series, signals
from ..operators.asof import asof_by_key, last_before
from ..schemas import r6 as R, ratio
from . import adapters as a
from .q_core import BETA, IC, LIMITS, PANELS, REAL, SECTOR, WEIGHTS, WPANELS, beta_panel, dykstra_sql, period_ic, weighted
from .q_panel import BP, EPS, EXCESS, RESID, RESID_ASOF, kept, ols3_sql, residuals, residuals_as_of
from .registry import query
from .sql_functions import chi2_tail, f_tail, normal_cdf, normal_ppf, normal_two_sided

SER = "ser as (select cast(s_nationkey as varchar) as series_id, date, round(avg(ret), 13) as ret from returns_monthly join supplier on s_suppkey = permno group by 1, 2)"


def monthly_series(spark: SparkSession, d: str) -> DataFrame:
    """A return series per nation."""
    s = a.table(spark, d, "supplier").select(F.col("s_suppkey").alias("permno"), F.col("s_nationkey").cast("string").alias("series_id"))
    return a.returns_monthly(spark, d).join(s, "permno").groupBy("series_id", "date").agg(F.round(F.avg("ret"), 13).alias("ret"))


def with_market(spark: SparkSession, d: str) -> DataFrame:
    f = a.factors_monthly(spark, d)
    return monthly_series(spark, d).join(F.broadcast(f), "date")


# metrics --------------------------------------------------------------------------------------------------------------

SHARPE = "sh as (select series_id, count(ret) as n_obs, pow(product(1 + ret), 12.0::double / count(ret)) - 1 as ann_return, stddev_samp(ret) * sqrt(12) as ann_vol from ser group by 1), sc as (select *, case when ann_vol >= 1e-10 then ann_return / ann_vol end as sharpe from sh)"
SHARPE_CI = ", ".join(f"round(sharpe{x}, 6) + 0.0::double as {c}" for c, x in (("sharpe", ""), ("ci_low", " - 1.96::double * sqrt((12 + 0.5::double * sharpe * sharpe) / n_obs)"), ("ci_high", " + 1.96::double * sqrt((12 + 0.5::double * sharpe * sharpe) / n_obs)")))
CURVE = "eq as (select *, product(1 + ret) over (partition by series_id order by date) as cum from ser), dd as (select *, max(cum) over (partition by series_id order by date) as peak, cum / max(cum) over (partition by series_id order by date) - 1 as drawdown from eq)"


@query("ann_return", f"with {SER}, {SHARPE} select series_id, round(ann_return, 6) + 0.0::double as ann_return from sh", "returns_monthly")
def q_ann(spark, d):
    return R(monthly_series(spark, d).groupBy("series_id").agg(series.ann_return(F.col("ret")).alias("ann_return")))


@query("ann_vol", f"with {SER}, {SHARPE} select series_id, round(ann_vol, 6) as ann_vol from sh", "returns_monthly")
def q_vol(spark, d):
    return R(monthly_series(spark, d).groupBy("series_id").agg(series.ann_vol(F.col("ret")).alias("ann_vol")))


@query("sharpe_ci", f"with {SER}, {SHARPE} select series_id, n_obs, round(sharpe, 6) + 0.0::double as sharpe, round(sqrt((12 + 0.5 * sharpe * sharpe) / n_obs), 6) as se from sc", "returns_monthly")
def q_sharpe(spark, d):
    return R(series.sharpe_ci(monthly_series(spark, d)).select("series_id", "n_obs", "sharpe", "se"))


@query("hit_rate", f"with {SER} select series_id, round(avg(case when ret > 0 then 1.0::double else 0 end), 6) as hit_rate from ser group by 1", "returns_monthly")
def q_hit(spark, d):
    return R(series.win_loss(monthly_series(spark, d)).select("series_id", "hit_rate"))


@query("moments", f"with {SER} select series_id, round(avg(ret), 7) + 0.0::double as mean, round(stddev_samp(ret), 7) as std, round(skewness(ret), 5) + 0.0::double as skew, round(kurtosis(ret), 5) + 0.0::double as kurt from ser group by 1", "returns_monthly")
def q_moments(spark, d):
    return R(R(series.moments(monthly_series(spark, d)), "mean", "std", digits=7), "skew", "kurt", digits=5)


@query("win_loss", f"with {SER} select series_id, round(avg(case when ret > 0 then 1.0::double else 0 end), 6) as hit_rate, round(avg(ret) filter (where ret > 0), 7) as mean_win, round(avg(ret) filter (where ret < 0), 7) as mean_loss, max(ret) as best, min(ret) as worst, round(case when avg(ret) filter (where ret < 0) is null then 'inf'::double else abs(avg(ret) filter (where ret > 0) / avg(ret) filter (where ret < 0)) end, 5) as win_loss_ratio from ser group by 1", "returns_monthly")
def q_win(spark, d):
    w = series.win_loss(monthly_series(spark, d))
    return R(R(R(w, "hit_rate"), "mean_win", "mean_loss", digits=7), "win_loss_ratio", digits=5)


@query("equity_curve", f"with {SER}, {CURVE} select series_id, date, round(cum, 6) as cum, round(peak, 6) as peak, round(drawdown, 6) + 0.0::double as drawdown from dd", "returns_monthly")
def q_curve(spark, d):
    return R(series.equity_curve(monthly_series(spark, d)).select("series_id", "date", "cum", "peak", "drawdown"))


EPISODES = """ep0 as (select *, row_number() over (partition by series_id order by date) as k, sum(case when cum < peak then 0 else 1 end) over (partition by series_id order by date) as spell from dd),
tops as (select series_id, spell, date as peak_date, k as k_peak, lead(date) over (partition by series_id order by date) as recovery_date, lead(k) over (partition by series_id order by date) as k_back from ep0 where not cum < peak),
deep as (select series_id, spell, arg_min(date, cum) as trough_date, arg_min(k, cum) as k_low, min(drawdown) as depth from ep0 where cum < peak group by 1, 2),
ep as (select series_id, peak_date, trough_date, recovery_date, round(depth, 6) as depth, cast(k_low - k_peak as int) as periods_to_trough, cast(k_back - k_low as int) as periods_to_recovery from deep join tops using (series_id, spell))"""


@query("drawdown_episodes", f"with {SER}, {CURVE}, {EPISODES} select * from ep", "returns_monthly")
def q_episodes(spark, d):
    return R(series.drawdown_episodes(monthly_series(spark, d)), "depth")


@query("worst_drawdowns", f"with {SER}, {CURVE}, {EPISODES} select series_id, peak_date, depth, rk from (select *, row_number() over (partition by series_id order by depth, peak_date) as rk from ep) where rk <= 10", "returns_monthly")
def q_worst(spark, d):
    e = R(series.drawdown_episodes(monthly_series(spark, d)), "depth")
    rk = F.row_number().over(Window.partitionBy("series_id").orderBy("depth", "peak_date"))
    return e.select("series_id", "peak_date", "depth", rk.cast("long").alias("rk")).filter("rk <= 10")


@query("max_drawdown", f"with {SER}, {CURVE} select series_id, round(least(min(drawdown), 0), 6) + 0.0::double as max_drawdown from dd group by 1", "returns_monthly")
def q_maxdd(spark, d):
    return R(series.max_drawdown(monthly_series(spark, d)))


@query("perf_suite", f"with {SER}, {SHARPE}, {CURVE} select s.series_id, n_obs, round(ann_return, 6) + 0.0::double as ann_return, round(sharpe, 6) + 0.0::double as sharpe, round(m.dd, 6) + 0.0::double as max_drawdown, m.best, m.worst from sc s join (select series_id, least(min(drawdown), 0) as dd, max(ret) as best, min(ret) as worst from dd group by 1) m using (series_id)", "returns_monthly")
def q_suite(spark, d):
    return R(series.perf_suite(monthly_series(spark, d)).select("series_id", "n_obs", "ann_return", "sharpe", "max_drawdown", "best", "worst"), "ann_return", "sharpe", "max_drawdown")


@query("split_metrics", "with " + SER.replace("ser as", "ser0 as") + ", ser as (select series_id || case when date < date '1998-07-01' then '-in' else '-out' end as series_id, date, ret from ser0), " + SHARPE + " select series_id, n_obs, round(ann_return, 6) + 0.0::double as ann_return, round(sharpe, 6) + 0.0::double as sharpe from sc", "returns_monthly")
def q_split(spark, d):
    s = monthly_series(spark, d)
    side = F.when(F.col("date") < F.to_date(F.lit("1998-07-01")), "-in").otherwise("-out")
    return R(series.sharpe_ci(s.withColumn("series_id", F.concat("series_id", side))).select("series_id", "n_obs", "ann_return", "sharpe"))


@query("rolling_sharpe", f"with {SER} select series_id, date, round(case when count(ret) over w = 12 then avg(ret) over w / nullif(stddev_samp(ret) over w, 0) * sqrt(12) end, 5) + 0.0::double as rolling_sharpe from ser window w as (partition by series_id order by date rows between 11 preceding and current row)", "returns_monthly")
def q_rolling(spark, d):
    return R(series.rolling_sharpe(monthly_series(spark, d)).select("series_id", "date", "rolling_sharpe"), digits=5)


@query("yearly_compound", f"with {SER} select series_id, cast(year(date) as int) as year, round(product(1 + ret) - 1, 7) + 0.0::double as year_return, count(ret) as n from ser group by 1, 2", "returns_monthly")
def q_yearly(spark, d):
    return R(series.yearly_compound(monthly_series(spark, d)), digits=7)


# costs ----------------------------------------------------------------------------------------------------------------

SPREAD = """nx as (select *, lead(high) over w as h1, lead(low) over w as l1 from returns_daily window w as (partition by permno order by date)),
bg as (select *, pow(ln(high / low), 2) + pow(ln(h1 / l1), 2) as b, pow(ln(greatest(high, h1) / least(low, l1)), 2) as g from nx),
al as (select *, (sqrt(2 * b) - sqrt(b)) / (3 - 2 * sqrt(2)) - sqrt(g / (3 - 2 * sqrt(2))) as al from bg),
sp as (select *, case when h1 is not null then greatest(2 * (exp(al) - 1) / (1 + exp(al)), 0) end as spread from al),
rs as (select *, case when count(spread) over w20 >= 10 then avg(spread) over w20 end as spread_mean, count(*) over w20 as k20, avg(abs(prc) * vol) over w20 as adv, stddev_samp(ret) over w60 as sigma from sp
  window w20 as (partition by permno order by date rows between 19 preceding and current row), w60 as (partition by permno order by date rows between 59 preceding and current row)),
st as (select m.date, p.permno, case when r.k20 >= 10 then r.spread_mean * 1e4 end as spread_bps, case when r.k20 >= 10 then r.adv end as adv, case when r.k20 >= 10 then r.sigma end as sigma
  from month_ends m cross join (select distinct permno from returns_daily) p asof join rs r on r.permno = p.permno and m.date >= r.date)"""


@query("spread_daily", f"with {SPREAD} select permno, date, round(spread, 6) as spread from sp", "returns_daily", "month_ends")
def q_spread(spark, d):
    return R(costs.daily_spread(a.returns_daily(spark, d)).select("permno", "date", "spread"))


@query("spread_rolling", f"with {SPREAD} select permno, date, round(spread_mean, 6) as spread_mean from rs", "returns_daily", "month_ends")
def q_spread_mean(spark, d):
    return R(costs.rolling_spread(a.returns_daily(spark, d)).select("permno", "date", "spread_mean"))


@query("name_stats", f"with {SPREAD} select date, permno, round(spread_bps, 4) as spread_bps, round(adv, 2) as adv, round(sigma, 8) as sigma from st", "returns_daily", "month_ends")
def q_stats(spark, d):
    s = costs.name_stats(a.returns_daily(spark, d), a.month_ends(spark, d))
    return R(R(R(s, "spread_bps", digits=4), "adv", digits=2), "sigma", digits=8)


@query("impact_bps", "select permno, date, round(case when vol > 0 then 0.1 * abs(ret) * sqrt(marketcap / (abs(prc) * vol)) * 1e4 else 0 end, 8) as impact from returns_daily", "returns_daily")
def q_impact(spark, d):
    return R(a.returns_daily(spark, d).select("permno", "date", costs.impact_bps(F.col("marketcap"), F.abs("prc") * F.col("vol"), F.abs("ret")).alias("impact")), digits=8)


@query("short_borrow", "select permno, date, round(case when ret < 0 then -ret * 1e6 * 0.005 / 12 else 0 end, 6) as borrow from returns_monthly", "returns_monthly")
def q_borrow(spark, d):
    return R(a.returns_monthly(spark, d).select("permno", "date", costs.short_borrow(F.col("ret") * 1e6).alias("borrow")))


COSTS = f"""wts as (select date, permno, round(w, 8) as weight from k3), dts as (select date, lead(date) over (order by date) as nd from (select distinct date from wts)),
tr as (select coalesce(n.date, p.date) as date, coalesce(n.permno, p.permno) as permno, coalesce(n.weight, 0) as weight, coalesce(p.weight, 0) as prior from wts n full join (select d.nd as date, w.permno, w.weight from wts w join dts d using (date) where d.nd is not null) p on p.date = n.date and p.permno = n.permno),
{SPREAD},
nc0 as (select t.*, abs(t.weight - t.prior) * 1e6 as trade, coalesce(s.spread_bps, 10) as sb, s.adv, coalesce(s.sigma, 0) as sg from tr t left join st s on s.date = t.date and s.permno = t.permno),
nc as (select *, trade * 1 / 1e4 as commission, trade * sb / 2 / 1e4 as half_spread, trade * case when trade > 0 and adv > 0 then 0.1 * sg * sqrt(trade / adv) * 1e4 else 0 end / 1e4 as impact, case when weight < 0 then -weight * 1e6 * 0.005 / 12 else 0 end as borrow from nc0 where trade > 0 or weight < 0),
pc as (select date, sum(commission + half_spread + impact + borrow) / 1e6 * 1e4 as cost_bps, count(*) filter (where trade > 0) as n_trades from nc group by 1)"""
CPANELS = (*WPANELS,)


def weights_once(spark, d):
    """The portfolios' weights, written: trades, costs and returns read them several times."""
    return kept(weighted(spark, d).select("date", "permno", "weight"), "weights")


def trades8(w):
    return costs.trades(w.withColumn("weight", F.round("weight", 8)))


def costed(spark, d, w=None):
    return costs.name_costs(trades8(weights_once(spark, d) if w is None else w), costs.name_stats(a.returns_daily(spark, d), a.month_ends(spark, d)))


@query("trade_delta", f"with {WEIGHTS}, {COSTS} select date, permno, round(weight - prior, 8) + 0.0::double as delta from tr", *CPANELS)
def q_trades(spark, d):
    return R(trades8(weights_once(spark, d)).select("date", "permno", "delta"), digits=8)


@query("name_cost", f"with {WEIGHTS}, {COSTS} select date, permno, round(commission, 7) as commission, round(half_spread, 7) as half_spread, round(impact, 7) as impact, round(borrow, 7) as borrow from nc", *CPANELS)
def q_name_cost(spark, d):
    return R(costed(spark, d).select("date", "permno", "commission", "half_spread", "impact", "borrow"), digits=7)


@query("period_cost", f"with {WEIGHTS}, {COSTS} select date, round(cost_bps, 4) as cost_bps, n_trades from pc", *CPANELS)
def q_period_cost(spark, d):
    return R(costs.period_costs(costed(spark, d)).select("date", "cost_bps", "n_trades"), digits=4)


NET = "nt as (select g.date, g.rr as realized_return, coalesce(pc.cost_bps / 1e4, 0) as drag from (select date, sum(w * g) as rr from hold group by date) g left join pc using (date))"


def net(spark, d):
    w = weights_once(spark, d)
    return costs.net_returns(portfolio.realized_returns(w, a.returns_daily(spark, d), calendar=a.trading_days(spark, d)), costs.period_costs(costed(spark, d, w)))


@query("net_returns", f"with {WEIGHTS}, {COSTS}, {REAL.format(w='k3', keys='date')}, {NET} select date, round(realized_return, 6) + 0.0::double as realized_return, round(drag, 6) as drag, round(realized_return - drag, 6) + 0.0::double as net_return from nt", *CPANELS)
def q_net(spark, d):
    return R(net(spark, d).select("date", "realized_return", F.coalesce("drag", F.lit(0.0)).alias("drag"), "net_return"))


@query("cost_sensitivity", f"with {WEIGHTS}, {COSTS}, {REAL.format(w='k3', keys='date')}, {NET}, sn as (select scale, date, realized_return - scale * drag as net_return from nt, (values (1.0::double), (0.75::double), (0.5::double)) v(scale)) select scale, date, round(net_return, 6) + 0.0::double as net_return, round(product(1 + net_return) over (partition by scale order by date) - 1, 6) + 0.0::double as cumulative from sn", *CPANELS)
def q_sensitivity(spark, d):
    return R(costs.cost_sensitivity(net(spark, d)), "net_return", "cumulative")


# attribution and whole study --------------------------------------------------------------------------------------------


SIGNALS = {"gp": 400, "ivol": 400, "resmom": 400, "pead": 90}
VARIANTS = {"3sig": ("gp", "ivol", "resmom"), "4sig": ("gp", "ivol", "resmom", "pead"), "no_resmom": ("gp", "ivol", "pead")}


def signal_panels(spark, d):
    """Aligned panels of the four signals; what is visible on a date is at most 400 days old, earnings drift 90."""
    from ..operators import xs as cross

    u = a.universe(spark, d)
    f, r = a.fundamentals(spark, d), a.returns_daily(spark, d)
    gp = signals.gross_profitability(f)
    ivol = signals.idiosyncratic_volatility(r, a.factors_daily(spark, d)).select("permno", "date_filed", "raw_signal")
    ivol = last_before(ivol, a.month_ends(spark, d), time="date_filed", calendar=a.trading_days(spark, d))
    mom = signals.residual_momentum_as_of(residuals_as_of(spark, d)).select(F.col("rebalance_date").alias("date"), "permno", "date_filed", "raw_signal")
    pead = signals.earnings_drift(f).select("permno", "date_filed", "raw_signal")
    raw = {"gp": gp, "ivol": ivol, "pead": pead}
    out = {n: cross.align_signal(x.withColumn("raw_signal", F.round("raw_signal", 9)), u, max_age=SIGNALS[n]) for n, x in raw.items()}
    # already as of each date
    fresh = F.when(F.datediff("date", "date_filed") <= SIGNALS["resmom"], F.round("raw_signal", 9))
    known = u.join(mom, ["date", "permno"], "left").select("date", "permno", fresh.alias("raw_signal"))
    out["resmom"] = cross.standardise(known).select("date", "permno", "raw_signal", "winsorized", "z_score")
    return {n: out[n] for n in SIGNALS}


def _aligned_sql(name: str) -> str:
    z = f"(win_{name} - avg(win_{name}) over d) / nullif(case when stddev_samp(win_{name}) over d >= 1e-12 then stddev_samp(win_{name}) over d end, 0)"
    join = "left join raw_resmom s on u.permno = s.permno and u.date = s.date" if name == "resmom" else f"asof left join raw_{name} s on u.permno = s.permno and u.date >= s.date_filed"
    return f"""got_{name} as (select u.date, u.permno, case when date_diff('day', s.date_filed, u.date) <= {SIGNALS[name]} then s.raw_signal end as x from universe u {join}),
win_{name} as (select date, permno, case when x is not null then greatest(least(x, quantile_cont(x, 0.99) over (partition by date)), quantile_cont(x, 0.01) over (partition by date)) end as win_{name} from got_{name}),
z_{name} as (select date, permno, {z} as z from win_{name} window d as (partition by date))"""


RAW_SIGNALS = f"""{EXCESS}, {ols3_sql('ex', 60)}, {RESID_ASOF}, {EPS},
raw_gp as (select permno, rdq as date_filed, round((revtq - cogsq) / nullif(atq, 0), 9) as raw_signal from fundamentals),
raw_ivol as (select permno, date as date_filed, round(residual_std * sqrt(252), 9) as raw_signal from ols),
raw_resmom as (select date, permno, date_filed, round(raw_signal, 9) as raw_signal from aresmom),
raw_pead as (select permno, rdq as date_filed, round(case when k = 8 and sd > 0 then greatest(least(surprise / sd, 3), -3) end, 9) as raw_signal from (select *, stddev_samp(surprise) over w as sd, count(surprise) over w as k from eps window w as (partition by permno order by fyearq, fqtr rows between 7 preceding and current row)))"""
SIGNALS_SQL = ",\n".join([RAW_SIGNALS, *map(_aligned_sql, SIGNALS)])
SPANELS = ("universe", "returns_daily", "returns_monthly", "factors_daily", "fundamentals", "month_ends")


def _composite_sql(name: str, use) -> str:
    """A composite as CTE comp_<name>; a null z-score counts as missing."""
    each = ", ".join(f"z_{s}.z{' * -1' if s == 'ivol' else ''} as z_{s}" for s in use)
    joins = " ".join(f"left join z_{s} on z_{s}.date = u.date and z_{s}.permno = u.permno" for s in use)
    count = " + ".join(f"(z_{s} is not null)::bigint" for s in use)
    total = " + ".join(f"coalesce(z_{s}, 0)" for s in use)
    return f"""zu_{name} as (select u.date, u.permno, {each} from universe u {joins}), zn_{name} as (select *, {count} as n_signals, ({total}) / nullif({count}, 0) as composite_raw from zu_{name} where {count} >= 2),
comp_{name} as (select *, case when stddev_samp(composite_raw) over d >= 1e-12 then (composite_raw - avg(composite_raw) over d) / stddev_samp(composite_raw) over d end as composite_z from zn_{name} window d as (partition by date))"""


@query("composite", f"with {SIGNALS_SQL}, {_composite_sql('all', SIGNALS)} select date, permno, {', '.join(f'round(z_{s}, 6) + 0.0::double as z_{s}' for s in SIGNALS)}, n_signals, round(composite_raw, 6) + 0.0::double as composite_raw, round(composite_z, 6) + 0.0::double as composite_z from comp_all", *SPANELS)
def q_composite(spark, d):
    from ..operators import xs as cross

    return R(cross.composite(signal_panels(spark, d)))


def held(spark, d, alphas, key: str):
    """Realised returns of neutral weights along ``alpha`` for each value of ``key`` and date."""
    from ..operators import xs as cross

    b = R(beta_panel(spark, d), "beta", digits=9).filter("beta is not null").select("date", "permno", "beta")
    s = portfolio.sector_last(a.fundamentals(spark, d), a.month_ends(spark, d))
    w = cross.neutral_weights(alphas.join(b, ["date", "permno"]).join(s, ["date", "permno"]), by=(key, "date"), **LIMITS)
    return portfolio.realized_returns(kept(w.select(key, "date", "permno", "weight"), "weights"), a.returns_daily(spark, d), keys=(key, "date"), calendar=a.trading_days(spark, d))


def held_sql(key: str, alphas: str) -> str:
    """The same as CTE held (key, date, realized_return, n_names) over rows (key, date, permno, alpha)."""
    w0 = f"w0 as (select x.{key}, x.date, x.permno, x.alpha, round(b.beta, 9) as beta, s.sector from ({alphas}) x join beta b on b.date = x.date and b.permno = x.permno join sec s on s.date = x.date and s.permno = x.permno where b.beta is not null)"
    return f"""{BETA.replace('win as', 'bwin as').replace('from win join', 'from bwin join')}, {SECTOR}, {w0}, {dykstra_sql(f'{key}, date')},
days as (select day, row_number() over (order by day) as k from (select distinct date as day from returns_daily)),
first_day as (select w.date, min(k) as k0 from (select distinct date from k3) w join days on day > w.date group by 1),
rets as (select f.date, r.permno, product(1 + r.ret) - 1 as g from first_day f join days on k >= k0 and k < k0 + 21 join returns_daily r on r.date = day group by 1, 2),
held as (select k3.{key}, k3.date, sum(w * coalesce(g, 0)) as realized_return, count(*) as n_names from k3 join first_day using (date) left join rets on rets.date = k3.date and rets.permno = k3.permno group by 1, 2)"""


ALONE = " union all ".join(f"select '{s}' as signal, date, permno, round(z, 9){' * -1' if s == 'ivol' else ''} as alpha from z_{s} where z is not null" for s in SIGNALS)


@query("single_signal_attribution", f"with {SIGNALS_SQL}, {held_sql('signal', ALONE)}, att as (select signal, product(1 + realized_return) - 1 as cumulative, avg(realized_return) as mean, stddev_samp(realized_return) as std, count(*) as n from held group by 1) select signal, round(cumulative, 6) + 0.0::double as cumulative, round(mean, 6) + 0.0::double as mean, round(std, 6) as std, n, round(mean / nullif(std, 0) * sqrt(12), 6) + 0.0::double as sharpe from att", *SPANELS)
def q_attribution(spark, d):
    """Each signal alone, as it is known on the date: neutral weights, the returns after it, and their moments."""
    z = None
    for name, p in signal_panels(spark, d).items():
        one = p.filter("z_score is not null").select(F.lit(name).alias("signal"), "date", "permno", (F.round("z_score", 9) * (-1 if name == "ivol" else 1)).alias("alpha"))
        z = one if z is None else z.unionByName(one)
    g = held(spark, d, z, "signal").groupBy("signal").agg((F.product(1 + F.col("realized_return")) - 1).alias("cumulative"), F.avg("realized_return").alias("mean"), F.stddev_samp("realized_return").alias("std"), F.count(F.lit(1)).alias("n"))
    return R(g.withColumn("sharpe", ratio(F.col("mean"), F.col("std")) * F.sqrt(F.lit(12.0))))


_VARIANT_ROWS = " union all ".join(f"select '{v}' as variant, date, permno, round(composite_z, 9) as alpha from comp_{v} where composite_z is not null" for v in VARIANTS)


@query("strategy_variants", f"with {SIGNALS_SQL}, {', '.join(_composite_sql(v, use) for v, use in VARIANTS.items())}, {held_sql('variant', _VARIANT_ROWS)}, pw as (select *, case when date < date '1999-01-01' then 'first' else 'second' end as part from held) select variant, part, date, round(realized_return, 6) + 0.0::double as realized_return, n_names from pw", *SPANELS)
def q_variants(spark, d):
    """One realised-return row per (variant, date), with the date window it is in: three signals, four, and without residual momentum."""
    from ..operators import xs as cross

    out = cross.composites(signal_panels(spark, d), VARIANTS).select("variant", "date", "permno", F.round("composite_z", 9).alias("alpha")).filter("alpha is not null")
    part = F.when(F.col("date") < F.to_date(F.lit("1999-01-01")), "first").otherwise("second")
    return R(held(spark, d, out, "variant").withColumn("part", part).select("variant", "part", "date", "realized_return", "n_names"))


COV_DAYS, HOLDING, COMMON = 500, 21, 75
#: A calendar that begins and ends before and after the data, so that every reason to skip a period occurs.
CALENDAR = "cal as (select cast(m - cast(greatest(0, isodow(m) - 5) as int) as date) as date from (select last_day(cast(unnest(generate_series(date_trunc('month', min(date)) - interval 3 month, max(date) + interval 2 month, interval 1 month)) as date)) as m from returns_daily))"
INPUTS = f"""pu as (select distinct date, permno from universe), pd as (select u.date, count(distinct r.date) filter (where r.date <= u.date) as n_days, count(distinct r.date) filter (where r.date > u.date) as n_holding from pu u join returns_daily r on r.permno = u.permno group by 1),
pe as (select permno, min(date) as f, max(date) as l from returns_daily group by 1),
pn as (select u.date, u.permno, c.composite_z as alpha, c.permno is not null as a, b.permno is not null as b, s.permno is not null as c, coalesce(e.f <= u.date, false) as p, coalesce(e.l > u.date, false) as q
  from pu u left join pe e on e.permno = u.permno left join comp_all c on c.date = u.date and c.permno = u.permno left join (select * from beta where beta is not null) b on b.date = u.date and b.permno = u.permno left join (select * from sec where sector is not null) s on s.date = u.date and s.permno = u.permno),
pg as (select date, count(*) as n_universe, count(*) filter (where a) as n_composite, count(*) filter (where b) as n_beta, count(*) filter (where c) as n_sector, count(*) filter (where p) as n_past, count(*) filter (where q) as n_future, count(*) filter (where a and b and c and p and q) as n_common, count(*) filter (where a and b and c and p and q and alpha is not null) as n_alpha from pn group by 1),
pi as (select cal.date, {', '.join(f'coalesce({c}, 0) as {c}' for c in ('n_universe', 'n_composite', 'n_beta', 'n_sector', 'n_past', 'n_future', 'n_common', 'n_alpha', 'n_days', 'n_holding'))} from cal left join pg on pg.date = cal.date left join pd on pd.date = cal.date)"""


@query("period_inputs", f"with {SIGNALS_SQL}, {_composite_sql('all', SIGNALS)}, {BETA.replace('win as', 'bwin as').replace('from win join', 'from bwin join')}, {SECTOR}, {CALENDAR}, {INPUTS} select *, case when n_universe = 0 then 'no universe' when n_days = 0 then 'no returns up to the date' when n_holding = 0 then 'no returns after the date' when n_composite = 0 then 'no composite' when n_days < {COV_DAYS} then 'short covariance window' when n_holding < {HOLDING} then 'short holding period' when n_common < {COMMON} then 'few common names' end as skip_reason from pi", *SPANELS)
def q_inputs(spark, d):
    from ..operators import xs as cross
    from ..operators.calendar import rebalance_dates

    r = a.returns_daily(spark, d)
    span = r.agg(F.add_months(F.min("date"), -3).alias("start"), F.add_months(F.max("date"), 2).alias("end"))
    s = portfolio.sector_last(a.fundamentals(spark, d), a.month_ends(spark, d))
    c = cross.composite(signal_panels(spark, d))
    return portfolio.period_inputs(rebalance_dates(span), a.universe(spark, d), r, c, beta_panel(spark, d), s, COV_DAYS, HOLDING, COMMON)


# diagnostics and inference ----------------------------------------------------------------------------------------------


@query("durbin_watson", f"with {RESID} select permno, round(sum(pow(residual - p, 2)) / nullif(sum(residual * residual), 0), 6) as dw, count(residual) as n from (select *, lag(residual) over (partition by permno order by month) as p from resid) group by permno", "returns_monthly", "fundamentals")
def q_dw(spark, d):
    return R(inference.durbin_watson(residuals(spark, d), ["permno"], "month"))


@query("dw_panel", f"""with {EXCESS}, {ols3_sql('ex', 60)}, lat as (select g.permno, m.date as as_of, o.n_obs as k1, o.b1, o.b2, o.b3 from (select distinct permno from ex) g cross join month_ends m asof join ols o on o.permno = g.permno and m.date >= o.date),
ek as (select *, row_number() over (partition by permno order by date) as k from ex), er as (select a.permno, a.as_of, e.date, y - b1 * x1 - b2 * x2 - b3 * x3 as e from lat a join ek e on e.permno = a.permno and e.k <= a.k1 and e.k > a.k1 - 60 where b1 is not null),
ec as (select *, e - avg(e) over (partition by permno, as_of) as r from er), el as (select *, lag(r) over (partition by permno, as_of order by date) as p from ec),
dwp as (select permno, as_of, sum(pow(r - p, 2)) / nullif(sum(r * r), 0) as dw from el group by 1, 2),
dc as (select case when dw < 1.44 then 'positive' when dw < 1.73 then 'unclear low' when dw <= 2.27 then 'none' when dw <= 2.56 then 'unclear high' else 'negative' end as class, dw from dwp)
select class, count(*) as n, round(avg(dw), 6) as mean_dw from dc group by 1""", "returns_daily", "factors_daily", "month_ends")
def q_dw_panel(spark, d):
    """Durbin-Watson of the last 60 residuals of each name's three-factor regression at every month end, by class."""
    r = a.returns_daily(spark, d).join(F.broadcast(a.factors_daily(spark, d)), "date").withColumn("excess", F.col("ret") - F.col("rf"))
    b = signals.rolling_durbin_watson(r.select("permno", "date", "excess", "mktrf", "smb", "hml"), "excess", ["mktrf", "smb", "hml"], 60)
    grid = r.select("permno").distinct().crossJoin(F.broadcast(a.month_ends(spark, d).select(F.col("date").alias("as_of"))))
    dw = asof_by_key(grid, b, ["permno"], "as_of", "date", ["b1", "dw"]).filter("b1 is not null")
    label = F.when(F.col("dw") < 1.44, "positive").when(F.col("dw") < 1.73, "unclear low").when(F.col("dw") <= 2.27, "none").when(F.col("dw") <= 2.56, "unclear high").otherwise("negative")
    return R(dw.groupBy(label.alias("class")).agg(F.count(F.lit(1)).alias("n"), F.avg("dw").alias("mean_dw")))


@query("qq_points", f"with {RESID}, qr as (select month, residual, row_number() over (partition by month order by residual) as i, count(*) over (partition by month) as n from resid), qd as (select i, n, case when i = 1 then 1 - pow(0.5::double, 1.0::double / n) when i = n then pow(0.5::double, 1.0::double / n) else (i - 0.3175::double) / (n + 0.365::double) end as p from (select distinct i, n from qr)), qt as (select *, {normal_ppf('p')} as t from qd) select month, round(residual, 6) + 0.0::double as observed, cast(i as int) as i, n, round(p, 6) as p, round(t, 6) + 0.0::double as theoretical from qr join qt using (i, n)", "returns_monthly", "fundamentals")
def q_qq(spark, d):
    return R(inference.qq_points(residuals(spark, d), ["month"]))


@query("breusch_pagan", f"with {RESID}, {BP} select month, n, cast(k as int) as k, round(r2, 6) + 0.0::double as r2, round(lm, 6) + 0.0::double as lm, round(f, 6) + 0.0::double as f, round({chi2_tail('lm', '(k - 1)')}, 6) as lm_p, round({f_tail('f', '(k - 1)', '(n - k)')}, 6) as f_p from bp", "returns_monthly", "fundamentals")
def q_bp(spark, d):
    return R(inference.breusch_pagan(residuals(spark, d)))


def hac_sql(source: str, key: str, lags) -> str:
    top = max(lags)
    cols = ", ".join(f"coalesce(sum(e * lag{j}), 0) as g{j}" for j in range(top + 1))
    lagged = ", ".join(f"lag(e, {j}) over (partition by {key} order by date) as lag{j}" for j in range(top + 1))
    each = " union all ".join(f"select {key}, n, mean, sd, {lag} as lag, sqrt(greatest(g0 + {' + '.join(f'2 * (1 - {j} / {lag + 1}.0::double) * g{j}' for j in range(1, lag + 1)) or '0'}, 0)) / n as hac_se from hg" for lag in lags)
    return f"hd as (select *, x - avg(x) over (partition by {key}) as e from {source}), hl as (select *, {lagged} from hd), hg as (select {key}, count(*) as n, avg(x) as mean, stddev_samp(x) as sd, {cols} from hl group by {key}), hac as ({each})"


HAC_OUT = "n, lag, round(mean, 7) + 0.0::double as mean, round(hac_se, 7) as hac_se, round(mean / nullif(sd / sqrt(n), 0), 5) + 0.0::double as naive_t, round(mean / nullif(hac_se, 0), 5) + 0.0::double as hac_t from hac"


def hac_rounded(g):
    return R(R(g, "mean", "hac_se", digits=7), "naive_t", "hac_t", digits=5)


@query("hac_mean", f"with {SER}, sx as (select series_id, date, ret as x from ser), {hac_sql('sx', 'series_id', (3, 5))} select series_id, {HAC_OUT}", "returns_monthly")
def q_hac(spark, d):
    return hac_rounded(inference.hac_mean(monthly_series(spark, d), (3, 5)))


@query("ic_hac_table", f"with {IC}, sx as (select signal as series_id, rebalance_date as date, round(ic_pearson, 10) as x from ic where ic_pearson is not null), {hac_sql('sx', 'series_id', (3, 5))} select series_id, {HAC_OUT}", *PANELS)
def q_ic_hac(spark, d):
    s = period_ic(spark, d).select(F.col("signal").alias("series_id"), F.col("rebalance_date").alias("date"), F.round("ic_pearson", 10).alias("ret"))
    return hac_rounded(inference.hac_mean(s, (3, 5)))


MKT = "mk as (select last_day(cast(l_shipdate as date)) as date, round(avg(l_discount) - 0.05, 8) as x from lineitem group by 1)"
DESIGN = ["one", "mkt_rf"]
#: Each series on the market: x, y and the moments of both per series.
LINE = f"{SER}, {MKT}, ln0 as (select series_id, date, ret as y, x from ser join mk using (date)), ln as (select *, count(*) over s as n, x - avg(x) over s as dx, y - avg(y) over s as dy from ln0 window s as (partition by series_id)), lm as (select *, sum(dx * dx) over s as sxx, sum(dx * dy) over s as sxy from ln window s as (partition by series_id)), lr as (select *, dy - sxy / sxx * dx as e, 1.0::double / n + dx * dx / sxx as h from lm)"


def design(spark, d):
    return with_market(spark, d).withColumn("one", F.lit(1.0))


@query("design_influence", f"with {LINE} select series_id, date, round(h, 6) as leverage, round(e, 7) + 0.0::double as residual, round(e * e * h / (2 * avg(e * e) over (partition by series_id) * pow(1 - h, 2)), 6) as cooks from lr", "returns_monthly")
def q_influence(spark, d):
    """Leverage and Cook's distance of any design; here each series on a constant and the market."""
    return R(R(regression.influence(design(spark, d), ["series_id"], "ret", DESIGN).select("series_id", "date", "leverage", "residual", "cooks"), "residual", digits=7), "leverage", "cooks")


@query("design_breusch_pagan", f"with {LINE}, bq as (select *, e * e as q, e * e - avg(e * e) over (partition by series_id) as dq from lr), br as (select series_id, any_value(n) as n, pow(sum(dq * dx), 2) / any_value(sxx) / nullif(sum(dq * dq), 0) as r2 from bq group by 1) select series_id, n, round(r2, 6) as r2, round(n * r2, 5) as lm, round(r2 / ((1 - r2) / (n - 2)), 5) as f from br", "returns_monthly")
def q_design_bp(spark, d):
    g = regression.breusch_pagan(design(spark, d), ["series_id"], "ret", DESIGN).select("series_id", "n", "r2", "lm", "f")
    return R(R(g, "r2"), "lm", "f", digits=5)


@query("hac_cov", f"with {LINE}, sc as (select *, e * x as u from lr), sl as (select *, {', '.join(f'lag(e, {j}) over w as e{j}, lag(u, {j}) over w as u{j}' for j in range(1, 5))} from sc window w as (partition by series_id order by date)), sg as (select series_id, any_value(n) as n, any_value(sxx) as sxx, avg(x) as mx, sum(e * e) + {' + '.join(f'2 * {1 - j / 5!r}::double * coalesce(sum(e * e{j}), 0)' for j in range(1, 5))} as s00, sum(e * u) + {' + '.join(f'{1 - j / 5!r}::double * (coalesce(sum(e * u{j}), 0) + coalesce(sum(u * e{j}), 0))' for j in range(1, 5))} as s01, sum(u * u) + {' + '.join(f'2 * {1 - j / 5!r}::double * coalesce(sum(u * u{j}), 0)' for j in range(1, 5))} as s11 from sl group by 1), sa as (select *, 1.0::double / n + mx * mx / sxx as a00, -mx / sxx as a01, 1 / sxx as a11 from sg) select series_id, 4 as lag, i as term_i, j as term_j, round(v, 9) + 0.0::double as cov from (select series_id, 'one' as i, 'one' as j, a00 * (s00 * a00 + s01 * a01) + a01 * (s01 * a00 + s11 * a01) as v from sa union all select series_id, 'one', 'mkt_rf', a00 * (s00 * a01 + s01 * a11) + a01 * (s01 * a01 + s11 * a11) from sa union all select series_id, 'mkt_rf', 'one', a00 * (s00 * a01 + s01 * a11) + a01 * (s01 * a01 + s11 * a11) from sa union all select series_id, 'mkt_rf', 'mkt_rf', a01 * (s00 * a01 + s01 * a11) + a11 * (s01 * a01 + s11 * a11) from sa)", "returns_monthly")
def q_hac_cov(spark, d):
    return R(regression.hac_covariance(design(spark, d), "series_id", "ret", DESIGN, [4]), digits=9)


def _sse(p: str) -> str:
    """Squared errors of y on a constant and x, from the sums with this prefix."""
    return f"greatest(({p}yy - {p}y * {p}y / {p}n) - pow({p}xy - {p}x * {p}y / {p}n, 2) / nullif({p}xx - {p}x * {p}x / {p}n, 0), 0)"


_SUMS = {"n": "1.0::double", "x": "dx", "y": "dy", "xx": "dx * dx", "xy": "dx * dy", "yy": "dy * dy"}
#: A break in constant and slope: sums before each row, of all rows, and of what is left.
CHOW = f"""cs as (select series_id, date, row_number() over w - 1 as t, n, {', '.join(f'coalesce(sum({e}) over (w rows between unbounded preceding and 1 preceding), 0) as p{c}, sum({e}) over s as a{c}' for c, e in _SUMS.items())} from ln window w as (partition by series_id order by date), s as (partition by series_id)),
cd as (select *, {', '.join(f'a{c} - p{c} as r{c}' for c in _SUMS)} from cs where t >= greatest(ceil(n * 0.15), 3) and t <= least(floor(n * 0.85), n - 3)),
ce as (select *, {_sse('p')} + {_sse('r')} as apart, {_sse('a')} as whole from cd), cf as (select *, greatest(((whole - apart) / 2) / (apart / (n - 4)), 0) as f from ce where apart > 0),
cb as (select *, -1.65::double + 1.06::double * f as hx from cf qualify row_number() over (partition by series_id order by f desc, t) = 1)"""


@query("sup_f_regression", f"with {LINE}, {CHOW} select series_id, round(f, 6) as sup_f, t as n_pre, date as break_at, round(case when hx <= 0 then 1.0::double else {chi2_tail('hx', '4.7::double')} end, 6) as p_value from cb", "returns_monthly")
def q_supf_regression(spark, d):
    """A break in constant and market slope of each series; tested against numpy."""
    return R(regression.sup_f(design(spark, d), "series_id", "ret", DESIGN))


FACTORS = ("mkt_rf", "smb", "hml", "rmw", "cma", "mom")
SIX = "sm as (select series_id, date, ret, " + ", ".join(FACTORS) + " from ser join factors_monthly using (date))"
SPAN_LAGS = (4, 6, 8)


def spanning_sql() -> str:
    """CTE spans: coefficient and HAC error of each term, from the part of it that the other terms leave."""
    terms = ["one", *FACTORS]
    out, ends = ["s0 as (select *, 1.0::double as one from sm)"], []
    for t, term in enumerate(terms):
        order = [x for x in terms if x != term]
        last = "s0"
        for i, f in enumerate(order):
            rest = [*order[i + 1 :], term, "y"]
            cols = ", ".join(f"{'ret' if c == 'y' and i == 0 else c} - coalesce(sum({'ret' if c == 'y' and i == 0 else c} * {f}) over w / nullif(sum({f} * {f}) over w, 0), 0) * {f} as {c}" for c in rest)
            out.append(f"o{t}_{i} as (select series_id, date, ret, {cols} from {last} window w as (partition by series_id))")
            last = f"o{t}_{i}"
        out.append(f"e{t} as (select series_id, date, ret, {term} as x, sum(y * {term}) over w / sum({term} * {term}) over w as coef, y - sum(y * {term}) over w / sum({term} * {term}) over w * {term} as e from {last} window w as (partition by series_id))")
        lagged = ", ".join(f"lag(x * e, {j}) over (partition by series_id order by date) as u{j}" for j in range(max(SPAN_LAGS) + 1))
        out.append(f"u{t} as (select *, {lagged} from e{t})")
        sums = ", ".join(f"coalesce(sum(u0 * u{j}), 0) as g{j}" for j in range(max(SPAN_LAGS) + 1))
        out.append(f"m{t} as (select series_id, any_value(coef) as coef, sum(x * x) as xx, sum(e * e) as sse, var_pop(ret) * count(*) as sst, count(*) as n, {sums} from u{t} group by 1)")
        name = "alpha" if term == "one" else term
        for lag in SPAN_LAGS:
            s2 = " + ".join(["g0", *[f"2 * (1 - {j} / {lag + 1}.0::double) * g{j}" for j in range(1, lag + 1)]])
            ends.append(f"select series_id, {lag} as lag, '{name}' as term, coef, sqrt({s2}) / xx as se, 1 - sse / sst as r2, n from m{t}")
    return ", ".join(out) + f", spans as ({' union all '.join(ends)})"


@query("spanning_regression", f"with {SER}, {SIX}, {spanning_sql()}, sa as (select *, max(coef) filter (where term = 'alpha') over (partition by series_id, lag) * 12 as ann_alpha from spans where n >= 30) select series_id, lag, term, round(coef, 6) + 0.0::double as coef, round(se, 6) as se, round(coef / se, 6) + 0.0::double as t_stat, round(r2, 6) as r2, round(1 - (1 - r2) * (n - 1) / (n - 7), 6) + 0.0::double as adj_r2, round(ann_alpha, 6) + 0.0::double as ann_alpha, n from sa", "returns_monthly", "factors_monthly")
def q_spanning(spark, d):
    return R(inference.spanning_regression(with_market(spark, d), list(FACTORS), list(SPAN_LAGS)))


CUTOFFS = ("1997-01-01", "1999-07-01")


@query("subsample_alpha", f"with {SER}, {MKT}, r as (select s.series_id, s.ret, x, c.cutoff, case when s.date < c.cutoff then 'pre' else 'post' end as side from ser s join mk using (date), (values {', '.join(f"(date '{c}')" for c in CUTOFFS)}) c(cutoff)), g as (select series_id, cutoff, side, count(*) as n, avg(ret) as mean, covar_pop(ret, x) as c, var_pop(x) as v, var_pop(ret) as vy, avg(x) as mx from r group by 1, 2, 3), h as (select *, c / nullif(v, 0) as b from g), k as (select *, mean - b * mx as al, sqrt(greatest(n * (vy - b * c), 0) / case when n > 2 then n - 2 end * (1.0::double / n + mx * mx / nullif(n * v, 0))) as se from h) select series_id, cutoff, side, n, round(mean, 7) + 0.0::double as mean, round(case when n >= 5 then al end, 6) + 0.0::double as alpha, round(case when n >= 5 then b end, 5) + 0.0::double as beta, round(case when n >= 5 then al / nullif(se, 0) end, 4) + 0.0::double as t_alpha from k", "returns_monthly")
def q_subsample(spark, d):
    g = inference.subsample_alpha(with_market(spark, d), CUTOFFS, factor="mkt_rf")
    return R(R(R(R(g, "mean", digits=7), "alpha"), "beta", digits=5), "t_alpha", digits=4)


def draws_sql(blocks, source: str = "ser") -> str:
    """Rows that moving blocks of each length draw from the series, 100 replicates."""
    state = "((((replicate * 1103515 + k * 12345 + 7919 + 12820163) % 16777213) * 1140671 + 12820163) % 16777213 * 1140671 + 12820163) % 16777213"
    return f"""num as (select *, row_number() over (partition by series_id order by date) - 1 as i, count(*) over (partition by series_id) as n from {source}),
bl as (select unnest([{', '.join(map(str, blocks))}]) as block),
dr as (select series_id, n, block, replicate, k, {state} % (n - block + 1) as start
  from (select distinct series_id, n, block from num, bl where n >= block) z, (select unnest(generate_series(0, 99)) as replicate), (select unnest(generate_series(0, 200)) as k) where k <= (n - 1) // block),
rw as (select d.block, d.replicate, s.* from dr d, (select unnest(generate_series(0, {max(blocks) - 1})) as o) o join num s on s.series_id = d.series_id and s.i = d.start + o.o where o.o < d.block and d.k * d.block + o.o < d.n)"""


BOOT = f"{draws_sql((6,))}, bx as (select series_id, replicate, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(12) as x from rw group by 1, 2), bs as (select series_id, quantile_cont(x, 0.025) as low, quantile_cont(x, 0.975) as high, count(x) as n_replicates from bx group by 1)"
POINT = "pt as (select series_id, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(12) as sharpe from ser group by 1)"


@query("bootstrap_sharpe", f"with {SER}, {BOOT}, {POINT} select series_id, round(sharpe, 5) + 0.0::double as sharpe, round(low, 5) + 0.0::double as low, round(high, 5) + 0.0::double as high, n_replicates from bs join pt using (series_id)", "returns_monthly")
def q_boot(spark, d):
    return R(inference.bootstrap_sharpe(monthly_series(spark, d), replicates=100), digits=5)


BLOCKS = (3, 4, 6, 8)


def alpha_sql(source: str, keys: str) -> str:
    """CTE al (keys, alpha, sharpe) of groups of rows: the constant's part that no factor explains, by successive orthogonalisation."""
    cols = [*FACTORS, "one"]
    steps = [f"g0 as (select {keys}, ret, {', '.join(FACTORS)}, 1.0::double as one from {source})"]
    for i, f in enumerate(FACTORS):
        rest = ", ".join(f"{c} - coalesce(sum({c} * {f}) over w / nullif(sum({f} * {f}) over w, 0), 0) * {f} as {c}" for c in cols[i + 1 :])
        steps.append(f"g{i + 1} as (select {keys}, ret, {rest} from g{i} window w as (partition by {keys}))")
    return ", ".join(steps) + f", al as (select {keys}, sum(ret * one) / sum(one * one) as alpha, avg(ret) / stddev_samp(ret) as sharpe, count(*) as n from g{len(FACTORS)} group by {keys})"


def _interval(c: str, scale: str) -> str:
    two = f"least(1.0::double, 2 * least(avg(case when {c} <= 0 then 1.0::double else 0 end), avg(case when {c} >= 0 then 1.0::double else 0 end)))"
    return f"round(quantile_cont({c}, 0.025) * {scale}, 6) + 0.0::double as {c}_low, round(quantile_cont({c}, 0.975) * {scale}, 6) + 0.0::double as {c}_high, round({two}, 6) as {c}_p"


@query("bootstrap_alpha", f"with {SER}, {SIX}, {draws_sql(BLOCKS, 'sm')}, {alpha_sql('rw', 'series_id, block, replicate')}, pt as (select * from ({alpha_sql('sm', 'series_id').replace('al as', 'point as').join(('with ', ' select * from point'))})), bt as (select series_id, block, any_value(n) as n, cast(count(*) as int) as n_replicates, {_interval('sharpe', 'sqrt(12)')}, {_interval('alpha', '12')} from al group by 1, 2) select bt.*, round(pt.sharpe * sqrt(12), 6) + 0.0::double as sharpe, round(pt.alpha * 12, 6) + 0.0::double as alpha from bt join pt using (series_id)", "returns_monthly", "factors_monthly")
def q_boot_alpha(spark, d):
    return R(inference.bootstrap_joint(with_market(spark, d), FACTORS, BLOCKS, replicates=100))


@query("sharpe_ci_compare", f"with {SER}, {SHARPE}, {BOOT} select series_id, {SHARPE_CI}, round(low, 6) + 0.0::double as boot_low, round(high, 6) + 0.0::double as boot_high from sc join bs using (series_id)", "returns_monthly")
def q_compare(spark, d):
    s = monthly_series(spark, d)
    b = inference.bootstrap_sharpe(s, replicates=100).select("series_id", F.col("low").alias("boot_low"), F.col("high").alias("boot_high"))
    return R(series.sharpe_ci(s).select("series_id", "sharpe", "ci_low", "ci_high").join(b, "series_id"))


SIG_LAGS, SIG_BLOCKS = (3, 6, 12), (3, 6, 12)


@query("series_significance", f"with {SER}, sx as (select series_id, date, ret as x from ser), {hac_sql('sx', 'series_id', SIG_LAGS)}, {draws_sql(SIG_BLOCKS)}, bx as (select series_id, block, replicate, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(12) as x from rw group by 1, 2, 3), bs as (select series_id, block, quantile_cont(x, 0.025) as low, quantile_cont(x, 0.975) as high from bx group by 1, 2), {POINT}, hp as (select *, mean / nullif(hac_se, 0) as hac_t from hac) select series_id, n, lag, block, round(mean, 6) + 0.0::double as mean, round(hac_se, 6) as hac_se, round(mean / nullif(sd / sqrt(n), 0), 6) + 0.0::double as naive_t, round(hac_t, 6) + 0.0::double as hac_t, round({normal_two_sided('hac_t')}, 6) as p_value, round(sharpe, 6) + 0.0::double as sharpe, round(low, 6) + 0.0::double as low, round(high, 6) + 0.0::double as high, low > 0 or high < 0 as excludes_zero from hp join bs using (series_id) join pt using (series_id)", "returns_monthly")
def q_significance(spark, d):
    """HAC and bootstrap of each series' mean, over several lags and block lengths."""
    s = monthly_series(spark, d)
    h = inference.hac_mean(s, SIG_LAGS).withColumn("p_value", inference.normal_two_sided(F.col("hac_t")))
    b = functools.reduce(DataFrame.unionByName, [inference.bootstrap_sharpe(s, block, replicates=100).withColumn("block", F.lit(block)) for block in SIG_BLOCKS])
    both = h.join(b.drop("n_replicates"), "series_id").withColumn("excludes_zero", (F.col("low") > 0) | (F.col("high") < 0))
    return R(both)


def trials(spark, d):
    """Moments of each nation's series; the nations of a region are a family of trials."""
    t = inference.trial_moments(monthly_series(spark, d))
    region = a.table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("series_id"), F.col("n_regionkey").cast("string").alias("family"))
    return t.withColumnsRenamed({"sr": "sharpe"}).join(region, "series_id")


TRIALS = "tr as (select s.series_id, cast(n_regionkey as varchar) as family, count(ret) as n, avg(ret) / nullif(stddev_samp(ret), 0) as sharpe, skewness(ret) as skew, kurtosis(ret) + 3 as kurt from ser s join nation on cast(n_nationkey as varchar) = s.series_id group by 1, 2)"


def expected_sql(source: str, keys: str, name: str) -> str:
    """CTE of the expected best Sharpe ratio of each group of trials."""
    best = f"sd * ((1 - {inference.EULER}) * {normal_ppf('(1 - 1.0::double / n)')} + {inference.EULER} * {normal_ppf(f'(1 - 1.0::double / (n * {math.e}))')})"
    return f"{name}_g as (select {keys}, stddev_samp(sharpe) as sd, count(*) as n from {source} group by all), {name} as (select *, case when n >= 2 and sd * sd >= 1e-12 then {best} end as expected_max from {name}_g)"


def dsr_sql() -> str:
    return normal_cdf("((sharpe - expected_max) * sqrt(n - 1) / sqrt(case when 1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe > 0 then 1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe end))")


@query("expected_max_sharpe", f"with {SER}, {TRIALS}, {expected_sql('tr', 'family', 'ex')} select family, round(sd, 6) as sd, n, round(expected_max, 6) + 0.0::double as expected_max from ex", "returns_monthly")
def q_expected(spark, d):
    return R(inference.expected_max_sharpe(trials(spark, d)))


@query("deflated_sharpe", f"with {SER}, {TRIALS}, {expected_sql('tr', 'family', 'ex')} select series_id, family, round(sharpe, 6) + 0.0::double as sharpe, round(expected_max, 6) + 0.0::double as expected_max, round({dsr_sql()}, 6) as dsr from tr join (select family, expected_max from ex) using (family)", "returns_monthly")
def q_deflated(spark, d):
    t = trials(spark, d)
    e = inference.expected_max_sharpe(t).select("family", "expected_max")
    own = t.join(e, "family")
    return R(own.select("series_id", "family", "sharpe", "expected_max", inference.deflated_sharpe(F.col("sharpe"), F.col("expected_max"), F.col("n"), F.col("skew"), F.col("kurt")).alias("dsr")))


COUNTS = (3, 7, 20)
SYNTHETIC = f"""fm as (select family, avg(sharpe) as mean, stddev_samp(sharpe) as sd from tr group by 1),
zi as (select trials, i, 0.05::double + 0.9::double * i / (trials - 1) as p from (select unnest([{', '.join(map(str, COUNTS))}]) as trials), (select unnest(generate_series(0, {max(COUNTS) - 1})) as i) where i < trials), zq as (select *, {normal_ppf('p')} as z from zi),
sy as (select family, trials, mean + sd * (z - avg(z) over w) / stddev_samp(z) over w as sharpe from fm, zq window w as (partition by family, trials))"""


@query("synthetic_trials", f"with {SER}, {TRIALS}, {SYNTHETIC}, {expected_sql('sy', 'family, trials', 'ex')} select series_id, family, cast(trials as int) as trials, round(sharpe, 6) + 0.0::double as sharpe, round(expected_max, 6) + 0.0::double as expected_max, round({dsr_sql()}, 6) as dsr from tr join (select family, trials, expected_max from ex) using (family)", "returns_monthly")
def q_synthetic(spark, d):
    """Deflated ratios of each series against 3, 7 and 20 pseudo-trials of its family."""
    t = trials(spark, d)
    g = t.groupBy("family").agg(F.avg("sharpe").alias("mean"), F.stddev_samp("sharpe").alias("sd"))
    out = None
    for n in COUNTS:
        e = inference.expected_max_sharpe(inference.synthetic_trials(g, n)).select("family", F.lit(n).alias("trials"), "expected_max")
        out = e if out is None else out.unionByName(e)
    dsr = inference.deflated_sharpe(F.col("sharpe"), F.col("expected_max"), F.col("n"), F.col("skew"), F.col("kurt"))
    return R(t.join(out, "family").select("series_id", "family", "trials", "sharpe", "expected_max", dsr.alias("dsr")))


SUPF = """pf as (select *, row_number() over w - 1 as k, count(*) over (partition by series_id) as n, sum(ret) over (w rows between unbounded preceding and 1 preceding) as s1, sum(ret * ret) over (w rows between unbounded preceding and 1 preceding) as q1, sum(ret) over (partition by series_id) as s, sum(ret * ret) over (partition by series_id) as q from ser window w as (partition by series_id order by date)),
pg as (select *, q1 - s1 * s1 / k as l, q - q1 - pow(s - s1, 2) / (n - k) as r, q - s * s / n as t from pf where k > 0 and k >= ceil(n * 0.15) and k <= n - ceil(n * 0.15)),
ph as (select *, (t - l - r) / nullif((l + r) / (n - 2), 0) as f from pg),
pb as (select * from ph qualify row_number() over (partition by series_id order by f desc, k) = 1)"""


@query("sup_f_break", f"with {SER}, {SUPF} select series_id, round(f, 4) as sup_f, date as break_date, round(s1 / k, 6) + 0.0::double as pre_mean, round((s - s1) / (n - k), 6) + 0.0::double as post_mean, k as n_pre, n - k as n_post from pb", "returns_monthly")
def q_supf(spark, d):
    return R(R(inference.sup_f(monthly_series(spark, d)), "sup_f", digits=4), "pre_mean", "post_mean")


BREAK = ", bk as (select *, count(*) over () as tests from pb), bv as (select *, -0.99::double + 1.02::double * f as hx from bk), bw as (select *, case when hx <= 0 then 1.0::double else " + chi2_tail("hx", "3.0::double") + " end as p_value from bv)"


@query("break_table", f"with {SER}, {SUPF}{BREAK} select series_id, round(f, 6) as sup_f, date as break_date, round(s1 / k, 6) + 0.0::double as pre_mean, round((s - s1) / (n - k), 6) + 0.0::double as post_mean, k as n_pre, n - k as n_post, round(p_value, 6) as p_value, p_value < 0.05 as rejects, p_value * tests < 0.05 as rejects_bonferroni from bw", "returns_monthly")
def q_breaks(spark, d):
    b = inference.sup_f(monthly_series(spark, d))
    n = b.agg(F.count(F.lit(1)).alias("tests"))
    b = b.withColumn("p_value", inference.hansen_pvalue(F.col("sup_f"))).crossJoin(F.broadcast(n))
    return R(b.withColumns({"rejects": F.col("p_value") < 0.05, "rejects_bonferroni": F.col("p_value") * F.col("tests") < 0.05}).drop("tests"))


@query("hansen_pvalue", f"with {SER}, {SUPF}{BREAK} select series_id, round(f, 6) as sup_f, round(p_value, 6) as p_value from bw", "returns_monthly")
def q_hansen(spark, d):
    return R(inference.sup_f(monthly_series(spark, d)).select("series_id", "sup_f", inference.hansen_pvalue(F.col("sup_f")).alias("p_value")))


@query("normal_scores", f"with {SER}, sx as (select series_id, date, ret as x from ser), {hac_sql('sx', 'series_id', (3,))}, ns as (select series_id, mean / nullif(hac_se, 0) as hac_t from hac) select series_id, round(hac_t, 6) + 0.0::double as hac_t, round({normal_cdf('hac_t')}, 6) as p from ns", "returns_monthly")
def q_scores(spark, d):
    return R(inference.hac_mean(monthly_series(spark, d), (3,)).select("series_id", "hac_t", spark_normal_cdf("hac_t").alias("p")))


