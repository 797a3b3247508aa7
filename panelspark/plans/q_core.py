"""Queries of as-of joins, cross-sectional transforms and sorts, holding-period returns and portfolios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.windows import xs
from ..operators import asof, portfolio, series, xs as cross
from ..operators.calendar import month_end_trading_days, rebalance_dates
from ..schemas import r6, ratio
from . import adapters as a
from .q_panel import kept
from .registry import query
from .sql_functions import t_two_sided

R = r6
HOLD = 21

# SQL pieces: each is a WITH entry that uses the ones before it
ALIGNED = """
got as (
  select u.date, u.permno, case when date_diff('day', s.date_filed, u.date) <= 400 then s.raw_signal end as raw_signal
  from universe u asof left join raw_signal s on u.permno = s.permno and u.date >= s.date_filed
), lim as (
  select *, quantile_cont(raw_signal, 0.01) over (partition by date) as lo, quantile_cont(raw_signal, 0.99) over (partition by date) as hi from got
), win as (select date, permno, raw_signal, case when raw_signal is not null then greatest(least(raw_signal, hi), lo) end as winsorized from lim
), aligned as (
  select *, case when stddev_samp(winsorized) over (partition by date) >= 1e-12 then (winsorized - avg(winsorized) over (partition by date)) / stddev_samp(winsorized) over (partition by date) end as z_score from win
)"""


def qcut_sql(source: str, x: str, n: int, by: str, name: str, least: int | None = None) -> str:
    probs = ", ".join(f"{i / n!r}" for i in range(n + 1))
    return f"""(select * exclude (e, c), case when {x} is not null and c >= {least or n} and len(e) >= 2 then cast(greatest(1, len(list_filter(e, lambda q: q < {x}))) as int) end as {name}
  from (select s.*, g.e, g.c from {source} s left join (select {by}, list_distinct(quantile_cont({x}, [{probs}])) as e, count({x}) as c from {source} group by {by}) g using ({by})))"""


FWD = f"""
px as (select permno, date, ret, row_number() over (partition by permno order by date) as k from returns_daily where ret is not null),
ahead as (select permno, date, sum(ln(1 + ret)) over w as lr, count(*) over w as n_days from px window w as (partition by permno order by date rows between current row and {HOLD - 1} following)),
grid as (select c.date as rebalance_date, p.permno from month_ends c, (select distinct permno from px) p),
fwd as (select g.rebalance_date, g.permno, exp(f.lr) - 1 as fwd_return, f.n_days from grid g asof join ahead f on g.permno = f.permno and g.rebalance_date < f.date)"""
SORTED = f"{ALIGNED},\nsorted as {qcut_sql('aligned', 'z_score', 5, 'date', 'quintile')}"
PANELS = ("universe", "raw_signal", "returns_daily")


def aligned(spark: SparkSession, d: str) -> DataFrame:
    return cross.align_signal(a.raw_signal(spark, d), a.universe(spark, d))


def sorted_names(spark: SparkSession, d: str) -> DataFrame:
    # rounded edges and values, as the z-scores of both engines differ in the last digit
    return cross.qcut(aligned(spark, d).withColumn("z_score", F.round("z_score", 9)))


def forward(spark: SparkSession, d: str) -> DataFrame:
    return portfolio.forward_returns(a.returns_daily(spark, d), a.month_ends(spark, d), HOLD)


def with_caps(spark: SparkSession, d: str) -> DataFrame:
    """Universe rows with the month's market cap."""
    m = a.returns_monthly(spark, d).select("permno", F.trunc("date", "MM").alias("m"), "marketcap")
    return a.universe(spark, d).withColumn("m", F.trunc("date", "MM")).join(m, ["permno", "m"]).drop("m")


CAPS = "caps as (select u.date, u.permno, m.marketcap from universe u join returns_monthly m on m.permno = u.permno and date_trunc('month', m.date) = date_trunc('month', u.date))"
ROUNDED = SORTED.replace("sorted as", "a9 as (select date, permno, raw_signal, winsorized, round(z_score, 9) as z_score from aligned),\nsorted as").replace("from aligned s ", "from a9 s ").replace("from aligned group", "from a9 group")


@query("asof_by_key", "select u.date, u.permno, s.date_filed as matched_time, round(s.raw_signal, 8) as raw_signal from universe u asof left join raw_signal s on u.permno = s.permno and u.date >= s.date_filed", "universe", "raw_signal")
def q_asof(spark, d):
    return R(asof.asof_by_key(a.universe(spark, d), a.raw_signal(spark, d), ["permno"], "date", "date_filed", ["raw_signal"]), "raw_signal", digits=8)


@query("asof_global", "select x.date, (select max(m.date) from month_ends m where m.date <= x.date) as matched_time from (select distinct date from returns_daily) x", "returns_daily", "month_ends")
def q_asof_global(spark, d):
    return asof.asof_global(a.returns_daily(spark, d).select("date").distinct(), a.month_ends(spark, d), "date", "date")


@query("asof_month_lookup", "select x.date, (select max(m.date) from (select distinct last_day(date) as date from returns_daily) m where m.date <= x.date) as matched_time from month_ends x", "returns_daily", "month_ends")
def q_asof_month(spark, d):
    stats = a.returns_daily(spark, d).select(F.last_day("date").alias("date")).distinct()
    return asof.asof_global(a.month_ends(spark, d), stats, "date", "date")


@query("asof_marketcap", "select g.date, g.permno, r.date as matched_time, r.marketcap from (select c.date, p.permno from month_ends c, (select distinct permno from returns_daily) p) g asof left join returns_daily r on g.permno = r.permno and g.date >= r.date", "returns_daily", "month_ends")
def q_asof_cap(spark, d):
    px = a.returns_daily(spark, d)
    grid = px.select("permno").distinct().crossJoin(F.broadcast(a.month_ends(spark, d))).select("date", "permno")
    return asof.asof_by_key(grid, px, ["permno"], "date", "date", ["marketcap"])


@query("asof_max_age", "select u.date, u.permno, case when u.date - s.date_filed <= 90 then s.date_filed end as matched_time, case when u.date - s.date_filed <= 90 then round(s.raw_signal, 8) end as raw_signal from universe u asof left join raw_signal s on u.permno = s.permno and u.date >= s.date_filed", "universe", "raw_signal")
def q_asof_age(spark, d):
    return R(asof.asof_max_age(a.universe(spark, d), a.raw_signal(spark, d), ["permno"], "date", "date_filed", ["raw_signal"], 90), "raw_signal", digits=8)


@query("align_signal", f"with {ALIGNED} select date, permno, round(raw_signal, 6) as raw_signal, round(winsorized, 6) as winsorized, round(z_score, 6) + 0.0::double as z_score from aligned", *PANELS)
def q_align(spark, d):
    return R(aligned(spark, d))


@query("xs_winsorize", "select date, permno, round(greatest(least(ret, hi), lo), 6) as winsorized from (select *, quantile_cont(ret, 0.05) over (partition by date) as lo, quantile_cont(ret, 0.95) over (partition by date) as hi from returns_daily)", "returns_daily")
def q_winsorize(spark, d):
    return R(cross.standardise(a.returns_daily(spark, d), "ret", p=0.05).select("date", "permno", "winsorized"))


@query("xs_zscore", "select date, permno, round(case when stddev_samp(ret) over w >= 1e-12 then (ret - avg(ret) over w) / stddev_samp(ret) over w end, 6) + 0.0::double as z_score from returns_daily window w as (partition by date)", "returns_daily")
def q_zscore(spark, d):
    return R(cross.standardise(a.returns_daily(spark, d), "ret", p=0).select("date", "permno", "z_score"))


@query("qcut", f"with {ROUNDED} select date, permno, quintile from sorted", *PANELS)
def q_qcut(spark, d):
    return sorted_names(spark, d).select("date", "permno", "quintile")


@query("median_split", f"with {CAPS} select date, permno, case when marketcap < quantile_cont(marketcap, 0.5) over (partition by date) then 'Small' else 'Big' end as size from caps", "universe", "returns_monthly")
def q_median(spark, d):
    return cross.split_at(with_caps(spark, d), "marketcap", [0.5], ["Small", "Big"]).select("date", "permno", "size")


@query("tercile_split", f"with {CAPS} select date, permno, case when marketcap < quantile_cont(marketcap, {1 / 3!r}) over (partition by date) then 'Small' when marketcap < quantile_cont(marketcap, {2 / 3!r}) over (partition by date) then 'Mid' else 'Big' end as size from caps", "universe", "returns_monthly")
def q_tercile(spark, d):
    return cross.split_at(with_caps(spark, d), "marketcap", [1 / 3, 2 / 3], ["Small", "Mid", "Big"]).select("date", "permno", "size")


@query("size_quintile", f"with {CAPS} select date, permno, bucket from {qcut_sql('caps', 'marketcap', 5, 'date', 'bucket')}", "universe", "returns_monthly")
def q_size_quintile(spark, d):
    return cross.qcut(with_caps(spark, d), "marketcap", name="bucket").select("date", "permno", "bucket")


BREAKS = """brk as (select date, quantile_cont(marketcap, 0.2) as p20, quantile_cont(marketcap, 0.4) as p40, quantile_cont(marketcap, 0.6) as p60, quantile_cont(marketcap, 0.8) as p80,
  quantile_cont(marketcap, 0.5) as median, count(*) as n_names from caps join supplier on s_suppkey = permno where s_nationkey % 3 = 0 and marketcap > 0 group by 1 having count(*) >= 5)"""


def reference_breaks(spark, d):
    s = a.table(spark, d, "supplier").filter("s_nationkey % 3 = 0").select(F.col("s_suppkey").alias("permno"))
    return cross.breakpoints(with_caps(spark, d).join(s, "permno", "left_semi"), by="date", least=5)


@query("nyse_breakpoints", f"with {CAPS}, {BREAKS} select date, round(p20, 4) as p20, round(p40, 4) as p40, round(p60, 4) as p60, round(p80, 4) as p80, round(median, 4) as median, n_names from brk", "universe", "returns_monthly")
def q_breakpoints(spark, d):
    return R(reference_breaks(spark, d), digits=4)


BUCKETED = "bkt as (select c.*, case when marketcap <= round(p20, 4) then 1 when marketcap <= round(p40, 4) then 2 when marketcap <= round(p60, 4) then 3 when marketcap <= round(p80, 4) then 4 else 5 end as size_bucket from caps c join brk using (date))"


def bucketed(spark, d):
    return cross.breakpoint_bucket(with_caps(spark, d), R(reference_breaks(spark, d), digits=4), by="date")


@query("breakpoint_bucket", f"with {CAPS}, {BREAKS}, {BUCKETED} select date, permno, size_bucket from bkt", "universe", "returns_monthly")
def q_bucket(spark, d):
    return bucketed(spark, d).select("date", "permno", "size_bucket")


DOUBLE = f"ds0 as (select b.date, b.permno, b.size_bucket, a.z_score from bkt b join a9 a on a.date = b.date and a.permno = b.permno where a.z_score is not null), ds as {qcut_sql('ds0', 'z_score', 2, 'date, size_bucket', 'sig_bucket', 5)}"


def double_sorted(spark, d):
    z = aligned(spark, d).withColumn("z_score", F.round("z_score", 9)).filter(F.col("z_score").isNotNull()).select("date", "permno", "z_score")
    return cross.qcut(bucketed(spark, d).join(z, ["date", "permno"]), n=2, by=("date", "size_bucket"), name="sig_bucket", least=5)


@query("double_sort", f"with {ROUNDED}, {CAPS}, {BREAKS}, {BUCKETED}, {DOUBLE} select date, permno, size_bucket, sig_bucket from ds", *PANELS)
def q_double(spark, d):
    return double_sorted(spark, d).select("date", "permno", "size_bucket", "sig_bucket")


@query("exclude_top_n", f"with {CAPS}, t as (select n, date, permno, marketcap, row_number() over (partition by n, date order by marketcap desc, permno) <= n as is_top from caps, (values (0), (5), (10)) v(n)) select n, date, count(*) filter (where not is_top) as n_kept, round(sum(marketcap) filter (where not is_top), 2) as cap_kept from t group by 1, 2", "universe", "returns_monthly")
def q_exclude(spark, d):
    caps = with_caps(spark, d)
    out = None
    for n in (0, 5, 10):
        one = cross.exclude_top_n(caps, n).groupBy(F.lit(n).alias("n"), "date").agg(F.count_if(~F.col("is_top")).alias("n_kept"), F.round(F.sum(F.when(~F.col("is_top"), F.col("marketcap"))), 2).alias("cap_kept"))
        out = one if out is None else out.unionByName(one)
    return out


@query("fwd_returns", f"with {FWD} select rebalance_date, permno, round(fwd_return, 6) + 0.0::double as fwd_return, n_days from fwd", "month_ends", "returns_daily")
def q_fwd(spark, d):
    return R(forward(spark, d))


@query("fwd_returns_calendar", f"with {FWD.split('fwd as')[0].rstrip().rstrip(',')}, x as (select g.rebalance_date, g.permno, p.date, p.ret, row_number() over (partition by g.rebalance_date, g.permno order by p.date) as k from grid g join px p on p.permno = g.permno and p.date > g.rebalance_date and p.date <= g.rebalance_date + 33) select rebalance_date, permno, round(exp(sum(ln(1 + ret))) - 1, 12) + 0.0::double as fwd_return, count(*) as n_days from x where k <= 21 group by 1, 2", "month_ends", "returns_daily")
def q_fwd_cal(spark, d):
    return R(portfolio.forward_returns(a.returns_daily(spark, d), a.month_ends(spark, d), HOLD, max_days=1.6), digits=12)


LEGS = "legs as (select s.date, s.permno, s.quintile, f.fwd_return, c.marketcap from sorted s join fwd f on f.rebalance_date = s.date and f.permno = s.permno left join caps c on c.date = s.date and c.permno = s.permno)"
LS_EW = "ls as (select date, avg(fwd_return) filter (where quintile = 5) as long_return, avg(fwd_return) filter (where quintile = 1) as short_return, count(*) filter (where quintile = 5) as n_long, count(*) filter (where quintile = 1) as n_short from legs group by date)"
LS_VW = "ls as (select date, sum(marketcap * fwd_return) filter (where quintile = 5) / sum(marketcap) filter (where quintile = 5) as long_return, sum(marketcap * fwd_return) filter (where quintile = 1) / sum(marketcap) filter (where quintile = 1) as short_return, count(*) filter (where quintile = 5) as n_long, count(*) filter (where quintile = 1) as n_short from legs group by date)"
LS_OUT = "select date, round(long_return, 6) + 0.0::double as long_return, round(short_return, 6) + 0.0::double as short_return, round(long_return - short_return, 6) + 0.0::double as ls_return, n_long, n_short from ls"


def ls_ew(spark, d):
    return portfolio.long_short(sorted_names(spark, d), forward(spark, d))


@query("long_short_ew", f"with {ROUNDED}, {FWD}, {CAPS}, {LEGS}, {LS_EW} {LS_OUT}", *PANELS)
def q_ls_ew(spark, d):
    return R(ls_ew(spark, d))


@query("long_short_vw", f"with {ROUNDED}, {FWD}, {CAPS}, {LEGS}, {LS_VW} {LS_OUT}", *PANELS)
def q_ls_vw(spark, d):
    s = sorted_names(spark, d).join(with_caps(spark, d), ["date", "permno"], "left")
    return R(portfolio.long_short(s, forward(spark, d), weight="marketcap"))


@query("ew_vw_compare", f"with {ROUNDED}, {FWD}, {CAPS}, {LEGS}, z as (select date, permno, quintile, fwd_return, marketcap, case when marketcap < quantile_cont(marketcap, 0.5) over (partition by date) then 'Small' else 'Big' end as size from legs where marketcap is not null), g as (select date, size, avg(fwd_return) filter (where quintile = 5) - avg(fwd_return) filter (where quintile = 1) as ew, sum(marketcap * fwd_return) filter (where quintile = 5) / sum(marketcap) filter (where quintile = 5) - sum(marketcap * fwd_return) filter (where quintile = 1) / sum(marketcap) filter (where quintile = 1) as vw from z group by 1, 2) select size, round(avg(ew) * 12, 6) + 0.0::double as ew_ann, round(avg(vw) * 12, 6) + 0.0::double as vw_ann, round(avg(ew) * 12 - avg(vw) * 12, 6) + 0.0::double as gap, count(*) as n_dates from g where ew is not null and vw is not null group by 1", *PANELS)
def q_ew_vw(spark, d):
    f = forward(spark, d).withColumnRenamed("rebalance_date", "date")
    s = sorted_names(spark, d).join(f, ["date", "permno"]).join(with_caps(spark, d), ["date", "permno"])
    s = cross.split_at(s, "marketcap", [0.5], ["Small", "Big"]).drop("n_days")
    base, ret = s.drop("fwd_return"), s.select(F.col("date").alias("rebalance_date"), "permno", "fwd_return")
    ew = portfolio.long_short(base, ret, by=("date", "size")).select("date", "size", F.col("ls_return").alias("ew"))
    vw = portfolio.long_short(base, ret, weight="marketcap", by=("date", "size")).select("date", "size", F.col("ls_return").alias("vw"))
    both = ew.join(vw, ["date", "size"]).filter("ew is not null and vw is not null")
    return R(both.groupBy("size").agg((F.avg("ew") * 12).alias("ew_ann"), (F.avg("vw") * 12).alias("vw_ann"), (F.avg("ew") * 12 - F.avg("vw") * 12).alias("gap"), F.count(F.lit(1)).alias("n_dates")))


STATS = "select {b}, round(avg(m), 6) + 0.0::double as mean_return, round(stddev_samp(m), 6) as std_return, count(*) as n_dates, round(avg(n), 6) as mean_names, round(pow(1 + avg(m), 12) - 1, 6) + 0.0::double as ann_return, round(avg(m) / nullif(stddev_samp(m), 0) * sqrt(12), 6) + 0.0::double as sharpe from (select date, {b}, avg(fwd_return) as m, count(*) as n from {src} group by date, {b}) group by {b}"


@query("bucket_stats", f"with {ROUNDED}, {FWD}, {CAPS}, {LEGS} {STATS.format(b='quintile', src='legs')}", *PANELS)
def q_bucket_stats(spark, d):
    s = sorted_names(spark, d).join(forward(spark, d).withColumnRenamed("rebalance_date", "date"), ["date", "permno"])
    return R(portfolio.bucket_stats(s))


@query("double_sort_stats", f"with {ROUNDED}, {FWD}, {CAPS}, {BREAKS}, {BUCKETED}, {DOUBLE}, dsr as (select ds.*, f.fwd_return from ds join fwd f on f.rebalance_date = ds.date and f.permno = ds.permno) {STATS.format(b='size_bucket, sig_bucket', src='dsr')}", *PANELS)
def q_double_stats(spark, d):
    s = double_sorted(spark, d).join(forward(spark, d).withColumnRenamed("rebalance_date", "date"), ["date", "permno"])
    return R(portfolio.bucket_stats(s, ("size_bucket", "sig_bucket")))


@query("size5_series", f"with {ROUNDED}, {FWD}, {CAPS}, {BREAKS}, {BUCKETED}, top as (select b.date, s.quintile, b.marketcap, f.fwd_return from bkt b join sorted s on s.date = b.date and s.permno = b.permno join fwd f on f.rebalance_date = b.date and f.permno = b.permno where b.size_bucket = 5), g as (select date, avg(fwd_return) filter (where quintile = 5) - avg(fwd_return) filter (where quintile = 1) as ew, sum(marketcap * fwd_return) filter (where quintile = 5) / sum(marketcap) filter (where quintile = 5) - sum(marketcap * fwd_return) filter (where quintile = 1) / sum(marketcap) filter (where quintile = 1) as vw, count(*) filter (where quintile = 5) as n_long, count(*) filter (where quintile = 1) as n_short, sum(marketcap) filter (where quintile = 5) as cap_long, sum(marketcap) filter (where quintile = 1) as cap_short from top group by 1) select date, round(ew, 6) + 0.0::double as ew, round(vw, 6) + 0.0::double as vw, n_long, n_short, round(cap_long, 2) as cap_long, round(cap_short, 2) as cap_short from g where n_long > 0 and n_short > 0 and cap_long > 0 and cap_short > 0", *PANELS)
def q_size5(spark, d):
    f = forward(spark, d).select(F.col("rebalance_date").alias("date"), "permno", "fwd_return")
    s = bucketed(spark, d).filter("size_bucket = 5").join(sorted_names(spark, d).select("date", "permno", "quintile"), ["date", "permno"]).join(f, ["date", "permno"])

    def leg(k, c):
        return F.sum(F.when(F.col("quintile") == k, c))

    cap, ret = F.col("marketcap"), F.col("fwd_return")
    g = s.groupBy("date").agg(
        (F.avg(F.when(F.col("quintile") == 5, ret)) - F.avg(F.when(F.col("quintile") == 1, ret))).alias("ew"), (ratio(leg(5, cap * ret), leg(5, cap)) - ratio(leg(1, cap * ret), leg(1, cap))).alias("vw"),
        F.count_if(F.col("quintile") == 5).alias("n_long"), F.count_if(F.col("quintile") == 1).alias("n_short"), F.round(leg(5, cap), 2).alias("cap_long"), F.round(leg(1, cap), 2).alias("cap_short"),
    )
    return R(g.filter("n_long > 0 and n_short > 0 and cap_long > 0 and cap_short > 0"))


@query("top_name_profile", f"with {ROUNDED}, {FWD}, {CAPS}, {LEGS}, t as (select *, row_number() over (partition by date order by marketcap desc, permno) <= 5 as is_top from legs where marketcap is not null) select permno, count(*) as n_months, round(avg(marketcap), 5) as mean_cap, round(avg(quintile), 6) as mean_bucket, round(avg(fwd_return), 6) + 0.0::double as mean_return, round(count(*) / sum(count(*)) over (), 6) as share from t where is_top group by permno", *PANELS)
def q_top_profile(spark, d):
    f = forward(spark, d).select(F.col("rebalance_date").alias("date"), "permno", "fwd_return")
    s = sorted_names(spark, d).join(f, ["date", "permno"]).join(with_caps(spark, d), ["date", "permno"])
    t = cross.exclude_top_n(s, 5).filter("is_top").groupBy("permno").agg(F.count(F.lit(1)).alias("n_months"), F.avg("marketcap").alias("mean_cap"), F.avg("quintile").alias("mean_bucket"), F.avg("fwd_return").alias("mean_return"))
    total = t.agg(F.sum("n_months").alias("t"))
    return R(t.crossJoin(F.broadcast(total)).withColumn("share", F.col("n_months") / F.col("t")).drop("t"), "mean_bucket", "mean_return", "share").withColumn("mean_cap", F.round("mean_cap", 5))


@query("coverage_by_year", f"with {ROUNDED} select cast(year(date) as int) as year, quintile, count(*) as n_rows, count(distinct date) as n_dates, round(count(*) / count(distinct date), 6) as per_date from sorted where quintile is not null group by 1, 2", *PANELS)
def q_coverage(spark, d):
    s = sorted_names(spark, d).filter("quintile is not null")
    return R(s.groupBy(F.year("date").alias("year"), "quintile").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("date").alias("n_dates")).withColumn("per_date", F.col("n_rows") / F.col("n_dates")))


@query("bucket_drilldown", f"with {ROUNDED}, {FWD}, {CAPS}, {LEGS}, r as (select date, permno, quintile, round(fwd_return, 8) as fwd_return from legs where quintile is not null) select date, quintile, permno, rk, round(fwd_return, 6) + 0.0::double as fwd_return from (select *, row_number() over (partition by date, quintile order by fwd_return, permno) as rk from r) where rk <= 3", *PANELS)
def q_drill(spark, d):
    f = forward(spark, d).select(F.col("rebalance_date").alias("date"), "permno", F.round("fwd_return", 8).alias("fwd_return"))
    s = sorted_names(spark, d).filter("quintile is not null").join(f, ["date", "permno"])
    rk = F.row_number().over(Window.partitionBy("date", "quintile").orderBy("fwd_return", "permno"))
    return R(s.select("date", "quintile", "permno", rk.cast("long").alias("rk"), "fwd_return").filter("rk <= 3"))


@query("left_attach", f"with {ROUNDED}, {FWD}, {CAPS} select s.date, s.permno, s.quintile, round(f.fwd_return, 6) + 0.0::double as fwd_return, c.marketcap from sorted s left join fwd f on f.rebalance_date = s.date and f.permno = s.permno left join caps c on c.date = s.date and c.permno = s.permno where f.fwd_return is not null", *PANELS)
def q_attach(spark, d):
    f = forward(spark, d).select(F.col("rebalance_date").alias("date"), "permno", "fwd_return")
    s = sorted_names(spark, d).select("date", "permno", "quintile").join(f, ["date", "permno"], "left").join(with_caps(spark, d), ["date", "permno"], "left")
    return R(s.filter(F.col("fwd_return").isNotNull()), "fwd_return")


@query("semi_filter", "select r.date, r.permno, r.ret from returns_daily r where exists (select 1 from universe u where u.permno = r.permno and date_trunc('month', u.date) = date_trunc('month', r.date))", "returns_daily", "universe")
def q_semi(spark, d):
    u = a.universe(spark, d).select("permno", F.trunc("date", "MM").alias("m")).distinct()
    return a.returns_daily(spark, d).withColumn("m", F.trunc("date", "MM")).join(u, ["permno", "m"], "left_semi").select("date", "permno", "ret")


@query("common_universe", f"with {ALIGNED}, {FWD}, c as (select x.date, x.permno from aligned x join fwd f on f.rebalance_date = x.date and f.permno = x.permno join (select distinct permno from fundamentals where gsector is not null) s on s.permno = x.permno where x.z_score is not null) select date, permno from c qualify count(*) over (partition by date) >= 5", *PANELS)
def q_common(spark, d):
    z = aligned(spark, d).filter("z_score is not null").select("date", "permno")
    f = forward(spark, d).select(F.col("rebalance_date").alias("date"), "permno")
    s = a.fundamentals(spark, d).filter("gsector is not null").select("permno").distinct()
    both = z.join(f, ["date", "permno"], "left_semi").join(s, "permno", "left_semi")
    return both.withColumn("n", F.count(F.lit(1)).over(xs("date"))).filter("n >= 5").select("date", "permno")


BETA = """dates as (select date, mktrf, row_number() over (order by date) as k from factors_daily),
asd as (select m.date as as_of, count(*) as k0 from month_ends m join factors_daily f on f.date <= m.date group by 1),
win as (select as_of, d.date, d.mktrf from asd join dates d on k <= k0 and k > k0 - 120),
beta as (select as_of as date, permno, count(*) as n_obs, case when count(*) >= 10 and var_pop(mktrf) >= 1e-20 then covar_pop(ret, mktrf) / var_pop(mktrf) end as beta from win join returns_daily r using (date) group by 1, 2)"""


def beta_panel(spark, d):
    return portfolio.betas(a.returns_daily(spark, d), a.factors_daily(spark, d), a.month_ends(spark, d), 120, 10)


@query("beta_ols", f"with {BETA} select date, permno, round(beta, 6) + 0.0::double as beta, n_obs from beta", "returns_daily", "factors_daily", "month_ends")
def q_beta(spark, d):
    return R(beta_panel(spark, d))


SECTOR = "sec as (select m.date, p.permno, f.gsector as sector from month_ends m cross join (select distinct permno from fundamentals) p asof join fundamentals f on f.permno = p.permno and m.date >= f.rdq)"


@query("sector_last", f"with {SECTOR} select * from sec", "month_ends", "fundamentals")
def q_sector(spark, d):
    return portfolio.sector_last(a.fundamentals(spark, d), a.month_ends(spark, d))


COV_MONTHS = 24
#: Per date: the months on which one of its names has a return, the last of them, those complete, and the centred returns on these.
WINDOWED = f"""cday as (select u.date, r.date as day, count(*) as n, row_number() over (partition by u.date order by r.date desc) as back, count(*) over (partition by u.date) as n_days, any_value(un.n_names) as n_names
  from universe u join returns_monthly r on r.permno = u.permno and r.date <= u.date join (select date, count(*) as n_names from universe group by 1) un on un.date = u.date group by u.date, r.date),
cfull as (select date, day from cday where back <= {COV_MONTHS} and n_days >= {COV_MONTHS} and n = n_names qualify count(*) over (partition by date) >= 2),
cent as (select f.date, f.day, u.permno, r.ret - avg(r.ret) over (partition by f.date, u.permno) as x from cfull f join universe u on u.date = f.date join returns_monthly r on r.permno = u.permno and r.date = f.day)"""


@query("cov_sample", f"with {WINDOWED} select a.date, a.permno as permno_i, b.permno as permno_j, round(avg(a.x * b.x), 9) + 0.0::double as cov from cent a join cent b on a.date = b.date and a.day = b.day where a.permno <= b.permno group by 1, 2, 3", "universe", "returns_monthly")
def q_cov(spark, d):
    return R(portfolio.covariance(a.returns_monthly(spark, d), a.universe(spark, d), COV_MONTHS).drop("shrinkage"), digits=9)


@query("cov_shrink", f"""with {WINDOWED}, s as (select a.date, a.permno as i, b.permno as j, avg(a.x * b.x) as s, avg(pow(a.x * b.x, 2)) as m4, count(*) as t from cent a join cent b on a.date = b.date and a.day = b.day where a.permno <= b.permno group by 1, 2, 3),
v as (select date, i as k, s as v from s where i = j), r as (select s.date, avg(s / nullif(sqrt(vi.v * vj.v), 0)) as rho from s join v vi on vi.k = i and vi.date = s.date join v vj on vj.k = j and vj.date = s.date where i < j group by 1),
t as (select s.*, case when i = j then s else coalesce(rho, 0) * sqrt(vi.v * vj.v) end as target, case when i = j then 1.0::double else 2.0::double end as w from s join v vi on vi.k = i and vi.date = s.date join v vj on vj.k = j and vj.date = s.date left join r on r.date = s.date),
g as (select date, greatest(0, least(1, coalesce(sum(w * (m4 - s * s)) / nullif(sum(w * pow(target - s, 2)), 0) / max(t), 0))) as shrinkage from t group by 1)
select t.date, i as permno_i, j as permno_j, round((shrinkage * target + (1 - shrinkage) * s) * 12, 8) + 0.0::double as cov, round(shrinkage, 8) as shrinkage from t join g using (date)""", "universe", "returns_monthly")
def q_shrink(spark, d):
    return R(portfolio.covariance(a.returns_monthly(spark, d), a.universe(spark, d), COV_MONTHS, shrink=True, periods=12.0), digits=8)


def weighted(spark, d):
    z = aligned(spark, d).filter("z_score is not null").select("date", "permno", F.round("z_score", 9).alias("alpha"))
    b = R(beta_panel(spark, d), "beta", digits=9).filter("beta is not null").select("date", "permno", "beta")
    s = portfolio.sector_last(a.fundamentals(spark, d), a.month_ends(spark, d))
    return cross.neutral_weights(z.join(b, ["date", "permno"]).join(s, ["date", "permno"]), **LIMITS)


#: Constraints of the test portfolios; all of them bind on some dates.
LIMITS = {"gross": 1.0, "cap": 0.03, "strength": 1.0}
ROUNDS = 50_000


def dykstra_sql(keys: str) -> str:
    """CTE k3 with weight w of the rows of w0 (keys, permno, alpha, beta, sector): rounds of the projections until a date no longer moves."""
    g, cap, st = (f"{LIMITS[c]!r}::double" for c in ("gross", "cap", "strength"))
    return f"""kb as (select *, beta - avg(beta) over s as b, alpha - avg(alpha) over s as am from w0 window s as (partition by {keys}, sector)),
kc as (select *, sum(b * b) over d as bb, sum(am * b) over d as ab from kb window d as (partition by {keys})),
ke as (select *, am - case when bb > 1e-18 then ab / bb else 0 end * b as an from kc),
k0 as (select {keys}, permno, alpha, beta, sector, b, bb, coalesce(an * {st} * least({g}, {cap} * count(*) over (partition by {keys})) / nullif(sum(abs(an)) over (partition by {keys}), 0), 0) as x from ke),
dyk as (
  select *, 0.0::double as p, 0.0::double as q, 0 as it, false as done from k0
  union all
  select {keys}, permno, alpha, beta, sector, b, bb, x, p, q, it,
         max(abs(x - x0)) over (partition by {keys}) < 1e-13 and max(abs(x)) over (partition by {keys}) <= {cap} + 1e-10 and sum(abs(x)) over (partition by {keys}) <= {g} + 1e-10 as done
  from (select *, m - case when bb > 1e-18 then sum(m * b) over (partition by {keys}) / bb else 0 end * b as x
  from (select * exclude (z), z - avg(z) over (partition by {keys}, sector) as m
  from (select * exclude (v, level), z, v - z as q
  from (select *, sign(v) * greatest(abs(v) - greatest(level, 0), 0) as z
  from (select * exclude (c), max(c) over (partition by {keys}) as level
  from (select *, (sum(abs(v)) over (partition by {keys} order by abs(v) desc, permno rows unbounded preceding) - {g}) / row_number() over (partition by {keys} order by abs(v) desc, permno) as c
  from (select {keys}, permno, alpha, beta, sector, b, bb, x as x0, x + p - y as p, y + q as v, it + 1 as it
  from (select *, greatest(least(x + p, {cap}), -{cap}) as y from dyk where it < {ROUNDS} and not done))))))))
),
k3 as (select {keys}, permno, alpha, beta, sector, x as w from dyk qualify it = max(it) over (partition by {keys}))"""


def weights_sql() -> str:
    return "w0 as (select x.date, x.permno, round(x.z_score, 9) as alpha, round(b.beta, 9) as beta, s.sector from aligned x join beta b on b.date = x.date and b.permno = x.permno join sec s on s.date = x.date and s.permno = x.permno where x.z_score is not null and b.beta is not null),\n" + dykstra_sql("date")


WEIGHTS = f"{ALIGNED}, {BETA.replace('win as', 'bwin as').replace('from win join', 'from bwin join')}, {SECTOR}, {weights_sql()}"
WPANELS = (*PANELS, "factors_daily")


@query("neutral_weights", f"with {WEIGHTS} select date, permno, round(w, 6) + 0.0::double as weight from k3", *WPANELS)
def q_weights(spark, d):
    return R(weighted(spark, d).select("date", "permno", "weight"))


@query("exposures", f"with {WEIGHTS} select date, round(sum(abs(w)), 6) as gross, round(sum(w), 6) + 0.0::double as net, count(*) filter (where w > 1e-8) as n_long, count(*) filter (where w < -1e-8) as n_short, round(sum(w * beta), 6) + 0.0::double as portfolio_beta, round(sum(w * alpha), 6) + 0.0::double as expected_alpha from k3 group by date", *WPANELS)
def q_exposures(spark, d):
    return R(portfolio.exposures(weighted(spark, d)))


REAL = """days as (select distinct date as day from returns_daily), dk as (select day, row_number() over (order by day) as k from days),
first as (select w.date, min(k) as k0 from (select distinct date from {w}) w join dk on day > w.date group by 1),
hold as (select h.{keys}, h.permno, any_value(h.w) as w, product(1 + coalesce(r.ret, 0)) - 1 as g from {w} h join first f on f.date = h.date join dk on k >= k0 and k < k0 + 21 left join returns_daily r on r.permno = h.permno and r.date = dk.day group by h.{keys}, h.permno)"""


@query("realized_return", f"with {WEIGHTS}, {REAL.format(w='k3', keys='date')} select date, round(sum(w * g), 6) + 0.0::double as realized_return, count(*) as n_names from hold group by date", *WPANELS)
def q_realized(spark, d):
    w = kept(weighted(spark, d).select("date", "permno", "weight"), "weights")
    return R(portfolio.realized_returns(w, a.returns_daily(spark, d), calendar=a.trading_days(spark, d)))


@query("liquidity_zero_share", """with w as (select permno, date, avg(case when vol < 30 then 1.0::double else 0 end) over (partition by permno order by date rows between 59 preceding and current row) as zero_share from returns_daily)
select m.date, p.permno, round(w.zero_share, 6) as zero_share from month_ends m cross join (select distinct permno from returns_daily) p asof join w on w.permno = p.permno and m.date >= w.date""", "returns_daily", "month_ends")
def q_zero_share(spark, d):
    px = a.returns_daily(spark, d).withColumn("vol", F.when(F.col("vol") >= 30, F.col("vol")).otherwise(0.0))
    return R(portfolio.zero_volume_share(px, a.month_ends(spark, d), calendar=a.trading_days(spark, d)).select("date", "permno", "zero_share"))


@query("liquidity_zero_run", """with k as (select permno, date, case when ret < -0.01 then 1 else 0 end as flat, row_number() over (partition by permno order by date) as k from returns_daily),
g as (select m.date, p.permno, x.k from month_ends m cross join (select distinct permno from k) p asof join k x on x.permno = p.permno and m.date >= x.date),
w as (select g.date, g.permno, k.k, k.flat, sum(1 - k.flat) over (partition by g.date, g.permno order by k.k) as island from g join k on k.permno = g.permno and k.k <= g.k and k.k > g.k - 60),
r as (select date, permno, island, sum(flat) as n from w group by 1, 2, 3)
select date, permno, cast(max(n) as int) as longest_run from r group by 1, 2""", "returns_daily", "month_ends")
def q_zero_run(spark, d):
    px = a.returns_daily(spark, d).withColumn("ret", F.when(F.col("ret") >= -0.01, 1.0).otherwise(0.0))
    return portfolio.zero_volume_share(px, a.month_ends(spark, d), calendar=a.trading_days(spark, d)).select("date", "permno", "longest_run")


@query("liquidity_screens", """with l as (select permno, avg(case when vol < 30 then 1.0::double else 0 end) as share, avg(prc) as price, avg(prc * vol) as adv from returns_daily group by 1)
select screen, count(*) filter (where share > s or price < p or adv < v) as n_excluded, count(*) as n_names, round(count(*) filter (where share > s or price < p or adv < v) / count(*), 6) as share_excluded
from l, (values ('loose', 0.9::double, 500::double, 1000::double), ('base', 0.45::double, 1300::double, 60000::double), ('strict', 0.4::double, 1400::double, 70000::double)) t(screen, s, p, v) group by screen""", "returns_daily")
def q_screens(spark, d):
    px = a.returns_daily(spark, d)
    stats = px.groupBy("permno").agg(F.avg(F.when(F.col("vol") < 30, 1.0).otherwise(0.0)).alias("share"), F.avg("prc").alias("price"), F.avg(F.col("prc") * F.col("vol")).alias("adv"))
    grid = F.explode(F.array(*[F.struct(F.lit(n).alias("screen"), F.lit(s).alias("s"), F.lit(p).alias("p"), F.lit(v).alias("v")) for n, s, p, v in (("loose", 0.9, 500.0, 1000.0), ("base", 0.45, 1300.0, 60000.0), ("strict", 0.4, 1400.0, 70000.0))]))
    bad = F.count_if((F.col("share") > F.col("t.s")) | (F.col("price") < F.col("t.p")) | (F.col("adv") < F.col("t.v")))
    g = stats.withColumn("t", grid).groupBy(F.col("t.screen").alias("screen")).agg(bad.alias("n_excluded"), F.count(F.lit(1)).alias("n_names"))
    return R(g.withColumn("share_excluded", F.col("n_excluded") / F.col("n_names")))


@query("profile_percentiles", "select round(quantile_cont(ret, 0.01), 6) as p1, round(quantile_cont(ret, 0.25), 6) + 0.0::double as p25, round(quantile_cont(ret, 0.5), 6) + 0.0::double as p50, round(quantile_cont(ret, 0.75), 6) + 0.0::double as p75, round(quantile_cont(ret, 0.99), 6) as p99, min(ret) as low, max(ret) as high, round(avg(ret), 6) + 0.0::double as mean, permno from returns_daily group by permno", "returns_daily")
def q_profile(spark, d):
    ps = (0.01, 0.25, 0.5, 0.75, 0.99)
    g = a.returns_daily(spark, d).groupBy("permno").agg(F.percentile("ret", F.array(*map(F.lit, ps))).alias("q"), F.min("ret").alias("low"), F.max("ret").alias("high"), F.avg("ret").alias("mean"))
    return R(g.select("permno", *[F.col("q")[i].alias(f"p{int(p * 100)}") for i, p in enumerate(ps)], "low", "high", "mean"))


@query("rebalance_calendar", "select date from month_ends", "month_ends")
def q_calendar(spark, d):
    return a.month_ends(spark, d)


@query("month_end_trading_days", "select date_trunc('month', date) as month, max(date) as date from returns_daily group by 1", "returns_daily")
def q_month_end(spark, d):
    return month_end_trading_days(a.returns_daily(spark, d))


IC = f"""{ALIGNED}, {FWD}, p as (select x.date as rebalance_date, 'gp' as signal, round(x.z_score, 9) as z, round(f.fwd_return, 9) as r from aligned x join fwd f on f.rebalance_date = x.date and f.permno = x.permno where x.z_score is not null
 union all select f.rebalance_date, 'size' as signal, c.marketcap as z, round(f.fwd_return, 9) as r from caps c join fwd f on f.rebalance_date = c.date and f.permno = c.permno),
rk as (select *, rank() over (partition by rebalance_date, signal order by z) + (count(*) over (partition by rebalance_date, signal, z) - 1) / 2.0::double as rz, rank() over (partition by rebalance_date, signal order by r) + (count(*) over (partition by rebalance_date, signal, r) - 1) / 2.0::double as rr from p),
ic as (select rebalance_date, signal, case when count(*) >= 10 then corr(z, r) end as ic_pearson, case when count(*) >= 10 then corr(rz, rr) end as ic_spearman, count(*) as n_names from rk group by 1, 2)"""
IC = f"{CAPS}, {IC}"


def signal_panel(spark, d):
    f = forward(spark, d).select(F.col("rebalance_date"), "permno", F.round("fwd_return", 9).alias("r"))
    z = aligned(spark, d).filter("z_score is not null").select(F.col("date").alias("rebalance_date"), "permno", F.lit("gp").alias("signal"), F.round("z_score", 9).alias("z"))
    c = with_caps(spark, d).select(F.col("date").alias("rebalance_date"), "permno", F.lit("size").alias("signal"), F.col("marketcap").alias("z"))
    return z.unionByName(c).join(f, ["rebalance_date", "permno"])


def period_ic(spark, d):
    return series.period_ic(signal_panel(spark, d))


@query("period_ic", f"with {IC} select rebalance_date, signal, round(ic_pearson, 6) + 0.0::double as ic_pearson, round(ic_spearman, 6) + 0.0::double as ic_spearman, n_names from ic", *PANELS)
def q_ic(spark, d):
    return R(period_ic(spark, d))


@query("ic_summary", f"with {IC}, it as (select signal, year(rebalance_date) as year, count(ic_pearson) as n, avg(ic_pearson) / (stddev_samp(ic_pearson) / sqrt(count(ic_pearson))) as t from ic where ic_pearson is not null group by 1, 2), ip as (select signal, year, {t_two_sided('t', '(n - 1)')} as p from it), isum as (select signal, cast(year(rebalance_date) as int) as year, count(ic_pearson) as n, round(avg(ic_pearson), 6) + 0.0::double as mean_ic, round(stddev_samp(ic_pearson), 6) as std_ic, round(avg(ic_pearson) / (stddev_samp(ic_pearson) / sqrt(count(ic_pearson))), 6) + 0.0::double as t_stat, round(avg(ic_pearson) / stddev_samp(ic_pearson), 6) + 0.0::double as ir, round(avg(case when ic_pearson > 0 then 1.0::double else 0 end), 6) as hit_rate from ic where ic_pearson is not null group by 1, 2) select isum.*, round(p, 6) as p_value from isum join ip on ip.signal = isum.signal and ip.year = isum.year", *PANELS)
def q_ic_summary(spark, d):
    got = series.ic_summary(period_ic(spark, d).withColumn("year", F.year("rebalance_date")), ["signal", "year"])
    return R(got)


@query("ic_ci", f"with {IC} select signal, round(avg(ic_pearson), 6) + 0.0::double as mean_ic, round(stddev_samp(ic_pearson) / sqrt(count(*)), 6) as se, round(avg(ic_pearson) - 1.96 * stddev_samp(ic_pearson) / sqrt(count(*)), 6) + 0.0::double as low, round(avg(ic_pearson) + 1.96 * stddev_samp(ic_pearson) / sqrt(count(*)), 6) + 0.0::double as high from ic where ic_pearson is not null group by 1", *PANELS)
def q_ic_ci(spark, d):
    g = period_ic(spark, d).filter("ic_pearson is not null").groupBy("signal").agg(F.avg("ic_pearson").alias("mean_ic"), (F.stddev_samp("ic_pearson") / F.sqrt(F.count(F.lit(1)))).alias("se"))
    return R(g.withColumns({"low": F.col("mean_ic") - 1.96 * F.col("se"), "high": F.col("mean_ic") + 1.96 * F.col("se")}))


@query("regime_label", f"with {IC}, y as (select cast(year(rebalance_date) as int) as year, avg(ic_pearson) as m from ic group by 1) select year, round(m, 6) + 0.0::double as mean_ic, case when m > 0 then 'bull' else 'bear' end as regime from y", *PANELS)
def q_regime(spark, d):
    return R(series.regimes(period_ic(spark, d)))


CORR = "cs as (select x.date as rebalance_date, x.permno, x.z_score as gp, c.marketcap as size, m.ret as mom from aligned x join caps c on c.date = x.date and c.permno = x.permno join returns_monthly m on m.permno = x.permno and date_trunc('month', m.date) = date_trunc('month', x.date) where x.z_score is not null), pc as (select rebalance_date, 'gp' as signal_a, 'mom' as signal_b, corr(gp, mom) as correlation, count(*) as n_names from cs group by 1 union all select rebalance_date, 'gp', 'size', corr(gp, size), count(*) from cs group by 1 union all select rebalance_date, 'mom', 'size', corr(mom, size), count(*) from cs group by 1)"


def wide_signals(spark, d):
    z = aligned(spark, d).filter("z_score is not null").select("date", "permno", F.col("z_score").alias("gp"))
    m = a.returns_monthly(spark, d).select("permno", F.trunc("date", "MM").alias("m"), F.col("ret").alias("mom"))
    both = z.join(with_caps(spark, d).withColumnRenamed("marketcap", "size"), ["date", "permno"]).withColumn("m", F.trunc("date", "MM")).join(m, ["permno", "m"])
    return both.select(F.col("date").alias("rebalance_date"), "permno", "gp", "mom", "size")


@query("period_corr", f"with {ALIGNED}, {CAPS}, {CORR} select rebalance_date, signal_a, signal_b, round(case when n_names >= 10 then correlation end, 6) + 0.0::double as correlation, n_names from pc", *PANELS, "returns_monthly")
def q_corr(spark, d):
    return R(series.period_corr(wide_signals(spark, d), ["gp", "mom", "size"]))


@query("corr_summary", f"with {ALIGNED}, {CAPS}, {CORR}, g as (select signal_a, signal_b, avg(case when n_names >= 10 then correlation end) as m, stddev_samp(case when n_names >= 10 then correlation end) as s from pc group by 1, 2) select signal_a, signal_b, round(m, 6) + 0.0::double as mean_corr, round(s, 6) + 0.0::double as std_corr from (select * from g union all select signal_b, signal_a, m, s from g union all select v, v, 1.0::double, 0.0::double from (values ('gp'), ('mom'), ('size')) t(v))", *PANELS, "returns_monthly")
def q_corr_summary(spark, d):
    return R(series.corr_summary(series.period_corr(wide_signals(spark, d), ["gp", "mom", "size"]), ["gp", "mom", "size"]))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Signal, quintiles, forward returns, long-short series and its Sharpe ratio with interval."""
    s = ls_ew(spark, d).select(F.lit("gp_ew").alias("series_id"), "date", F.col("ls_return").alias("ret"))
    return R(series.sharpe_ci(s))


query("flagship", f"with {ROUNDED}, {FWD}, {CAPS}, {LEGS}, {LS_EW}, s as (select long_return - short_return as ret from ls), m as (select count(ret) as n, pow(product(1 + ret), 12.0::double / count(ret)) - 1 as ann, stddev_samp(ret) * sqrt(12) as vol from s), z as (select *, case when vol >= 1e-10 then ann / vol end as sharpe from m), e as (select *, sqrt((12 + 0.5 * sharpe * sharpe) / n) as se from z) select 'gp_ew' as series_id, n as n_obs, round(ann, 6) + 0.0::double as ann_return, round(vol, 6) as ann_vol, round(sharpe, 6) + 0.0::double as sharpe, round(se, 6) as se, round(sharpe - 1.96 * se, 6) as ci_low, round(sharpe + 1.96 * se, 6) as ci_high from e", *PANELS)(flagship)
