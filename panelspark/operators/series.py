"""Metrics of many return series at once (keyed by series_id), and information coefficients of signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import t_two_sided
from ..functions.windows import adjusted_kurtosis, adjusted_skew, average_rank, so_far, trailing
from ..schemas import ratio, require_columns

PERIODS = 12.0


def ann_return(r: Column, periods: float = PERIODS) -> Column:
    return F.pow(F.product(1 + r), F.lit(periods) / F.count(r)) - 1


def ann_vol(r: Column, periods: float = PERIODS) -> Column:
    return F.stddev_samp(r) * F.sqrt(F.lit(periods))


def sharpe_ci(s: DataFrame, by: Sequence[str] = ("series_id",), periods: float = PERIODS, rf: float = 0.0) -> DataFrame:
    """Geometric annual return over volatility, its standard error and 95 % interval; NULL below a volatility of 1e-10."""
    r = F.col("ret")
    m = require_columns(s, *by, "ret").groupBy(*by).agg(F.count(r).alias("n_obs"), ann_return(r, periods).alias("ann_return"), ann_vol(r, periods).alias("ann_vol"))
    m = m.withColumn("sharpe", F.when(F.col("ann_vol") >= 1e-10, (F.col("ann_return") - rf) / F.col("ann_vol")))
    m = m.withColumn("se", F.sqrt((periods + 0.5 * F.col("sharpe") * F.col("sharpe")) / F.col("n_obs")))
    return m.withColumns({"ci_low": F.col("sharpe") - 1.96 * F.col("se"), "ci_high": F.col("sharpe") + 1.96 * F.col("se")})


def moments(s: DataFrame, by: Sequence[str] = ("series_id",)) -> DataFrame:
    r = F.col("ret")
    return s.groupBy(*by).agg(F.avg(r).alias("mean"), F.stddev_samp(r).alias("std"), adjusted_skew(r).alias("skew"), adjusted_kurtosis(r).alias("kurt"))


def win_loss(s: DataFrame, by: Sequence[str] = ("series_id",)) -> DataFrame:
    r = F.col("ret")
    g = s.groupBy(*by).agg(
        F.avg(F.when(r > 0, 1.0).otherwise(0.0)).alias("hit_rate"), F.avg(F.when(r > 0, r)).alias("mean_win"), F.avg(F.when(r < 0, r)).alias("mean_loss"), F.max(r).alias("best"), F.min(r).alias("worst")
    )
    return g.withColumn("win_loss_ratio", F.when(F.col("mean_loss").isNull(), F.lit(float("inf"))).otherwise(F.abs(F.col("mean_win") / F.col("mean_loss"))))


def equity_curve(s: DataFrame) -> DataFrame:
    """Adds cum, peak and drawdown. The first value is the first peak, so an initial loss is no drawdown."""
    w = so_far("series_id")
    own = s.filter(F.col("ret").isNotNull()).withColumn("cum", F.product(1 + F.col("ret")).over(w))
    own = own.withColumn("peak", F.max("cum").over(w))
    return own.withColumn("drawdown", F.col("cum") / F.col("peak") - 1)


def drawdown_episodes(s: DataFrame) -> DataFrame:
    """One row per spell below a peak: peak, trough and recovery dates, depth, periods down and back (NULL if not back)."""
    w = Window.partitionBy("series_id").orderBy("date")
    e = equity_curve(s).withColumns({"k": F.row_number().over(w), "under": F.col("cum") < F.col("peak")})
    e = e.withColumn("spell", F.sum(F.when(~F.col("under"), 1).otherwise(0)).over(so_far("series_id")))
    tops = e.filter(~F.col("under")).select("series_id", "spell", F.col("date").alias("peak_date"), F.col("k").alias("k_peak"), F.lead("date").over(w).alias("recovery_date"), F.lead("k").over(w).alias("k_back"))
    deep = e.filter("under").groupBy("series_id", "spell").agg(F.min_by("date", F.struct("cum", "date")).alias("trough_date"), F.min_by("k", F.struct("cum", "date")).alias("k_low"), F.min("drawdown").alias("depth"))
    got = deep.join(tops, ["series_id", "spell"])
    return got.select("series_id", "peak_date", "trough_date", "recovery_date", "depth", (F.col("k_low") - F.col("k_peak")).alias("periods_to_trough"), (F.col("k_back") - F.col("k_low")).alias("periods_to_recovery"))


def max_drawdown(s: DataFrame) -> DataFrame:
    return equity_curve(s).groupBy("series_id").agg(F.least(F.min("drawdown"), F.lit(0.0)).alias("max_drawdown"))


def perf_suite(s: DataFrame) -> DataFrame:
    """All metrics, one row per series."""
    return sharpe_ci(s).join(moments(s), "series_id").join(win_loss(s), "series_id").join(max_drawdown(s), "series_id")


def rolling_sharpe(s: DataFrame, n: int = 12, periods: float = PERIODS) -> DataFrame:
    w = trailing(n, "series_id")
    full = F.count("ret").over(w) == n
    return s.withColumn("rolling_sharpe", F.when(full, ratio(F.avg("ret").over(w), F.stddev_samp("ret").over(w)) * F.sqrt(F.lit(periods))))


def yearly_compound(s: DataFrame) -> DataFrame:
    return s.groupBy("series_id", F.year("date").alias("year")).agg((F.product(1 + F.col("ret")) - 1).alias("year_return"), F.count("ret").alias("n"))


def period_ic(panel: DataFrame, least: int = 10) -> DataFrame:
    """rebalance_date, signal, z, r -> Pearson and Spearman correlation per date and signal; NULL below ``least`` names."""
    keys = ("rebalance_date", "signal")
    own = require_columns(panel, *keys, "z", "r").withColumn("rz", average_rank(F.col("z"), *keys)).withColumn("rr", average_rank(F.col("r"), *keys))
    n = F.count(F.lit(1))
    return own.groupBy(*keys).agg(F.when(n >= least, F.corr("z", "r")).alias("ic_pearson"), F.when(n >= least, F.corr("rz", "rr")).alias("ic_spearman"), n.alias("n_names"))


def ic_summary(ic: DataFrame, by: Sequence[str] = ("signal",), column: str = "ic_pearson") -> DataFrame:
    x = F.col(column)
    g = ic.filter(x.isNotNull()).groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean_ic"), F.stddev_samp(x).alias("std_ic"), F.avg(F.when(x > 0, 1.0).otherwise(0.0)).alias("hit_rate"))
    g = g.withColumns({"t_stat": ratio(F.col("mean_ic"), F.col("std_ic") / F.sqrt("n")), "ir": ratio(F.col("mean_ic"), F.col("std_ic"))})
    return g.withColumn("p_value", t_two_sided(F.col("t_stat"), (F.col("n") - 1).cast("double")))


def regimes(ic: DataFrame) -> DataFrame:
    """year, mean_ic, regime: bull where the mean over signals and dates is above zero."""
    return ic.groupBy(F.year("rebalance_date").alias("year")).agg(F.avg("ic_pearson").alias("mean_ic")).withColumn("regime", F.when(F.col("mean_ic") > 0, "bull").otherwise("bear"))


def period_corr(wide: DataFrame, signals: Sequence[str], least: int = 10) -> DataFrame:
    """Correlation of every pair of signal columns per date, all pairs in one aggregation."""
    pairs = [(x, y) for i, x in enumerate(signals) for y in signals[i + 1 :]]
    both = [F.col(x).isNotNull() & F.col(y).isNotNull() for x, y in pairs]
    g = wide.groupBy("rebalance_date").agg(F.array(*[F.struct(F.lit(x).alias("signal_a"), F.lit(y).alias("signal_b"), F.when(F.count_if(ok) >= least, F.corr(x, y)).alias("correlation"), F.count_if(ok).alias("n_names")) for (x, y), ok in zip(pairs, both, strict=True)]).alias("p"))
    return g.select("rebalance_date", F.explode("p").alias("p")).select("rebalance_date", "p.*")


def corr_summary(pairs: DataFrame, signals: Sequence[str]) -> DataFrame:
    """Symmetric mean and deviation over dates, with the diagonal."""
    g = pairs.groupBy("signal_a", "signal_b").agg(F.avg("correlation").alias("mean_corr"), F.stddev_samp("correlation").alias("std_corr"))
    back = g.select(F.col("signal_b").alias("signal_a"), F.col("signal_a").alias("signal_b"), "mean_corr", "std_corr")
    own = pairs.select(F.explode(F.array("signal_a", "signal_b")).alias("signal_a")).distinct().select("signal_a", F.col("signal_a").alias("signal_b"), F.lit(1.0).alias("mean_corr"), F.lit(0.0).alias("std_corr"))
    return g.unionByName(back).unionByName(own)
