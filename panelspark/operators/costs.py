"""Trading costs: spread from high and low, impact, borrow, trades between periods, net returns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import trailing
from ..schemas import ratio
from .asof import asof_by_key

_K = 3 - 2 * math.sqrt(2)


def daily_spread(prices: DataFrame) -> DataFrame:
    """Adds spread: high-low estimate from this day and the next, at least 0; NULL on the last day."""
    w = Window.partitionBy("permno").orderBy("date")
    own = prices.withColumns({"h1": F.lead("high").over(w), "l1": F.lead("low").over(w)})

    def log2(h: Column, low: Column) -> Column:
        return F.pow(F.ln(ratio(h, low)), F.lit(2))

    beta = log2(F.col("high"), F.col("low")) + log2(F.col("h1"), F.col("l1"))
    gamma = log2(F.greatest("high", "h1"), F.least("low", "l1"))
    alpha = (F.sqrt(2 * beta) - F.sqrt(beta)) / _K - F.sqrt(gamma / _K)
    spread = 2 * (F.exp(alpha) - 1) / (1 + F.exp(alpha))
    return own.withColumn("spread", F.when(F.col("h1").isNotNull(), F.greatest(spread, F.lit(0.0)))).drop("h1", "l1")


def rolling_spread(prices: DataFrame, n: int = 20) -> DataFrame:
    """Adds spread_mean over n rows with at least max(n / 2, 5) values."""
    w = trailing(n)
    return daily_spread(prices).withColumn("spread_mean", F.when(F.count("spread").over(w) >= max(n / 2, 5), F.avg("spread").over(w)))


def name_stats(prices: DataFrame, dates: DataFrame) -> DataFrame:
    """date, permno, spread_bps, adv (20 rows), sigma (60 rows) at each date; NULL with fewer than 10 rows."""
    w20, w60 = trailing(20), trailing(60)
    own = rolling_spread(prices).withColumns({
        "k": F.count(F.lit(1)).over(w20), "adv": F.avg(F.abs("prc") * F.col("vol")).over(w20), "sigma": F.stddev_samp("ret").over(w60), "spread_bps": F.col("spread_mean") * 1e4,
    })
    enough = F.col("k") >= 10
    own = own.select("permno", "date", *[F.when(enough, F.col(c)).alias(c) for c in ("spread_bps", "adv", "sigma")])
    grid = prices.select("permno").distinct().crossJoin(F.broadcast(dates.select(F.col("date").alias("as_of"))))
    got = asof_by_key(grid, own, ["permno"], "as_of", "date", ["spread_bps", "adv", "sigma"])
    return got.filter("matched_time is not null").select(F.col("as_of").alias("date"), "permno", "spread_bps", "adv", "sigma")


def impact_bps(trade: Column, adv: Column, sigma: Column, kappa: float = 0.1) -> Column:
    return F.when((trade > 0) & (adv > 0), kappa * sigma * F.sqrt(trade / adv) * 1e4).otherwise(0.0)


def short_borrow(position: Column, rate: float = 0.005, periods: float = 12.0) -> Column:
    return F.when(position < 0, -position * rate / periods).otherwise(0.0)


def trades(weights: DataFrame, nav: float = 1e6) -> DataFrame:
    """date, permno, weight, prior, delta, trade of every name held in a period or the one before; the first starts from nothing."""
    days = weights.select("date").distinct().withColumn("next_date", F.lead("date").over(Window.orderBy("date")))  # one row a period
    now = weights.select("date", "permno", "weight", F.lit(None).cast("double").alias("prior"))
    was = weights.join(F.broadcast(days), "date").filter("next_date is not null").select(F.col("next_date").alias("date"), "permno", F.lit(None).cast("double").alias("weight"), F.col("weight").alias("prior"))
    both = now.unionByName(was).groupBy("date", "permno").agg(F.coalesce(F.max("weight"), F.lit(0.0)).alias("weight"), F.coalesce(F.max("prior"), F.lit(0.0)).alias("prior"))
    return both.withColumn("delta", F.col("weight") - F.col("prior")).withColumn("trade", F.abs("delta") * nav)


def name_costs(traded: DataFrame, stats: DataFrame, nav: float = 1e6, commission_bps: float = 1.0, kappa: float = 0.1, rate: float = 0.005, periods: float = 12.0) -> DataFrame:
    """Dollars of commission, spread, impact and borrow per name. Without statistics: 10 bps spread, endless volume, no volatility."""
    own = traded.join(stats, ["date", "permno"], "left")
    t = F.col("trade")
    spread, adv, sigma = F.coalesce("spread_bps", F.lit(10.0)), F.coalesce("adv", F.lit(float("inf"))), F.coalesce("sigma", F.lit(0.0))
    own = own.withColumns({
        "commission": t * commission_bps / 1e4, "half_spread": t * spread / 2 / 1e4, "impact": t * impact_bps(t, adv, sigma, kappa) / 1e4, "borrow": short_borrow(F.col("weight") * nav, rate, periods),
    })
    own = own.filter((t > 0) | (F.col("weight") < 0))
    return own.withColumn("cost", F.col("commission") + F.col("half_spread") + F.col("impact") + F.col("borrow"))


def period_costs(costs: DataFrame, nav: float = 1e6) -> DataFrame:
    """Totals per period in basis points, the drag on its return, and the number of trades."""
    g = costs.groupBy("date").agg(*[(F.sum(c) / nav * 1e4).alias(f"{c}_bps") for c in ("commission", "half_spread", "impact", "borrow", "cost")], F.count_if(F.col("trade") > 0).alias("n_trades"))
    return g.withColumn("drag", F.col("cost_bps") / 1e4)


def net_returns(gross: DataFrame, period: DataFrame) -> DataFrame:
    return gross.join(period.select("date", "drag", "n_trades"), "date", "left").withColumn("net_return", F.col("realized_return") - F.coalesce("drag", F.lit(0.0)))


def cost_sensitivity(net: DataFrame, scales: tuple[float, ...] = (1.0, 0.75, 0.5)) -> DataFrame:
    """scale, date, net_return, cumulative at shares of the cost."""
    s = net.withColumn("scale", F.explode(F.array(*[F.lit(x) for x in scales]))).withColumn("net_return", F.col("realized_return") - F.col("scale") * F.coalesce("drag", F.lit(0.0)))
    w = Window.partitionBy("scale").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return s.select("scale", "date", "net_return", (F.product(1 + F.col("net_return")).over(w) - 1).alias("cumulative"))
