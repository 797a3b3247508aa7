"""Diagnostics and inference of many keyed series or regressions in one job."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import chi2_tail, f_tail, normal_cdf, normal_ppf
from ..functions.windows import adjusted_kurtosis, adjusted_skew
from ..schemas import ratio

EULER = 0.5772156649015329


def durbin_watson(df: DataFrame, key: Sequence[str], order: str, e: str = "residual") -> DataFrame:
    """sum of squared changes over sum of squares, in order; NULL where all residuals are zero."""
    step = F.col(e) - F.lag(e).over(Window.partitionBy(*key).orderBy(order))
    return df.withColumn("__d", step).groupBy(*key).agg(ratio(F.sum(F.col("__d") * F.col("__d")), F.sum(F.col(e) * F.col(e))).alias("dw"), F.count(e).alias("n"))


def qq_points(df: DataFrame, key: Sequence[str], e: str = "residual") -> DataFrame:
    """Sorted residuals with Filliben's order-statistic medians as normal quantiles."""
    w = Window.partitionBy(*key)
    i, n = F.row_number().over(w.orderBy(e)), F.count(F.lit(1)).over(w)
    own = df.select(*key, F.col(e).alias("observed"), i.alias("i"), n.alias("n"))
    top = F.pow(F.lit(0.5), 1 / F.col("n"))
    p = F.when(F.col("i") == 1, 1 - top).when(F.col("i") == F.col("n"), top).otherwise((F.col("i") - 0.3175) / (F.col("n") + 0.365))
    return own.withColumn("p", p).withColumn("theoretical", normal_ppf("p"))


def breusch_pagan(df: DataFrame, key: str = "month", group: str = "ggroup") -> DataFrame:
    """LM and F tests of squared residuals on group dummies and log size, by the same within-group demeaning."""
    cell, day = Window.partitionBy(key, group), Window.partitionBy(key)
    own = df.withColumn("q", F.col("residual") * F.col("residual"))
    own = own.withColumns({"qy": F.col("q") - F.avg("q").over(cell), "qs": F.col("log_size") - F.avg("log_size").over(cell)})
    own = own.withColumns({"sxx": F.sum(F.col("qs") * F.col("qs")).over(day), "sxy": F.sum(F.col("qy") * F.col("qs")).over(day)})
    left = F.col("qy") - F.when(F.col("sxx") > 1e-12, F.col("sxy") / F.col("sxx")).otherwise(0.0) * F.col("qs")
    g = own.withColumn("left", left).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(group).alias("groups"), F.sum(F.col("left") * F.col("left")).alias("sse"), (F.var_pop("q") * F.count(F.lit(1))).alias("sst"))
    g = g.withColumns({"r2": 1 - ratio(F.col("sse"), F.col("sst")), "k": F.col("groups") + 1})
    g = g.withColumns({"lm": F.col("n") * F.col("r2"), "f": ratio(F.col("r2") / (F.col("k") - 1), (1 - F.col("r2")) / (F.col("n") - F.col("k")))})
    return g.withColumns({"lm_p": chi2_tail("lm", (F.col("k") - 1).cast("double")), "f_p": f_tail("f", (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double"))}).drop("sse", "sst", "groups")


def group_influence(df: DataFrame, key: str = "month", group: str = "ggroup") -> DataFrame:
    """Adds n_params (groups and size), mse and cooks to rows with residual and leverage; cooks is NULL where the leverage is 1."""
    w = Window.partitionBy(key)
    h = F.col("leverage")
    own = df.withColumns({"n_params": F.size(F.collect_set(group).over(w)) + 1, "mse": F.avg(F.col("residual") * F.col("residual")).over(w)})
    return own.withColumn("cooks", F.when(h < 1 - 1e-9, ratio(F.col("residual") * F.col("residual"), F.col("n_params") * F.col("mse")) * h / F.pow(1 - h, F.lit(2))))


def month_diagnostics(resid: DataFrame, key: str = "month", group: str = "ggroup", degenerate: float = 0.99) -> DataFrame:
    """One row per regression on group dummies and size: fit, Breusch-Pagan, leverage, Cook's distance, shape of the residuals.

    Names whose leverage exceeds ``degenerate`` are alone in their group: they are counted, and left out of max_cooks_clean
    and n_high_cooks. High leverage is above 2 params / n, a high distance above 4 / n.
    """
    own = group_influence(resid, key, group)
    e, h, n = F.col("residual"), F.col("leverage"), F.count(F.lit(1))
    alone = h > degenerate
    total = F.var_pop("ret") * n
    g = own.withColumn("__n", n.over(Window.partitionBy(key))).groupBy(key).agg(
        n.alias("n_obs"), F.max("n_params").alias("n_params"), F.count_if(alone).alias("n_degenerate"), (1 - ratio(F.var_pop("residual") * n, total)).alias("r2"),
        F.max("leverage").alias("max_leverage"), F.avg("leverage").alias("mean_leverage"), F.count_if(h > 2 * F.col("n_params") / F.col("__n")).alias("n_high_leverage"),
        F.max("cooks").alias("max_cooks"), F.max(F.when(~alone, F.col("cooks"))).alias("max_cooks_clean"), F.count_if((F.col("cooks") > 4 / F.col("__n")) & ~alone).alias("n_high_cooks"),
        adjusted_skew(e).alias("skew"), adjusted_kurtosis(e).alias("kurt"),
    )
    return g.join(breusch_pagan(resid, key, group).select(key, "lm", "lm_p", "f", "f_p"), key)


def hac_mean(s: DataFrame, lags: Sequence[int], key: str = "series_id", x: str = "ret") -> DataFrame:
    """series, lag, n, mean, naive and HAC (Bartlett) t statistics of a mean. One pass over the rows for all lags."""
    w = Window.partitionBy(key)
    e = s.filter(F.col(x).isNotNull()).withColumn("e", F.col(x) - F.avg(x).over(w))
    top = max(lags)
    e = e.withColumns({f"p{j}": F.col("e") * F.lag("e", j).over(w.orderBy("date")) for j in range(top + 1)})
    g = e.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.array(*[F.coalesce(F.sum(f"p{j}"), F.lit(0.0)) for j in range(top + 1)]).alias("gamma"))

    def variance(lag: int) -> Column:
        total = F.col("gamma")[0]
        for j in range(1, lag + 1):
            total = total + 2 * (1 - j / (lag + 1)) * F.col("gamma")[j]
        return total

    each = F.explode(F.array(*[F.struct(F.lit(lag).alias("lag"), F.sqrt(F.greatest(variance(lag), F.lit(0.0))).alias("root")) for lag in lags]))
    g = g.withColumn("v", each).select(key, "n", "mean", "sd", "v.lag", (F.col("v.root") / F.col("n")).alias("hac_se"))
    return g.withColumns({"naive_t": ratio(F.col("mean"), F.col("sd") / F.sqrt("n")), "hac_t": ratio(F.col("mean"), F.col("hac_se"))}).drop("sd")


def ols_hac(y: np.ndarray, x: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, their HAC covariance (Bartlett, no small-sample factor) and residuals."""
    inv = np.linalg.pinv(x.T @ x)
    b = inv @ x.T @ y
    e = y - x @ b
    u = x * e[:, None]
    s = u.T @ u
    for j in range(1, min(lag, len(y) - 1) + 1):
        g = u[j:].T @ u[:-j]
        s = s + (1 - j / (lag + 1)) * (g + g.T)
    return b, inv @ s @ inv, e


def spanning_regression(rows: DataFrame, factors: Sequence[str], lags: Sequence[int], periods: float = 12.0, least: int = 30) -> DataFrame:
    """series_id, lag, term, coef, se, t, r2, adj_r2, ann_alpha: one small regression per series and lag, in parallel."""
    names = ["alpha", *factors]

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna().sort_values("date")
        n, k = len(pdf), len(names)
        if n < least:
            return pd.DataFrame(columns=["series_id", "lag", "term", "coef", "se", "t_stat", "r2", "adj_r2", "ann_alpha", "n"])
        y, x = pdf["ret"].to_numpy(float), np.column_stack([np.ones(n), pdf[list(factors)].to_numpy(float)])
        b, v, e = ols_hac(y, x, key[1])
        se = np.sqrt(np.diag(v))
        r2 = 1 - (e @ e) / ((y - y.mean()) @ (y - y.mean()))
        return pd.DataFrame({"series_id": key[0], "lag": key[1], "term": names, "coef": b, "se": se, "t_stat": b / se, "r2": r2, "adj_r2": 1 - (1 - r2) * (n - 1) / (n - k), "ann_alpha": b[0] * periods, "n": n})

    each = rows.withColumn("lag", F.explode(F.array(*[F.lit(x) for x in lags]))).select("series_id", "lag", "date", "ret", *factors)
    return each.groupBy("series_id", "lag").applyInPandas(fit, "series_id string, lag int, term string, coef double, se double, t_stat double, r2 double, adj_r2 double, ann_alpha double, n long")


def subsample_alpha(rows: DataFrame, cutoffs: Sequence[str], factor: str = "mktrf", key: str = "series_id") -> DataFrame:
    """key, cutoff, side, n, mean, alpha, beta, t of alpha (classical) before and from each cutoff; NULL below five rows."""
    side = F.explode(F.array(*[F.struct(F.to_date(F.lit(c)).alias("cutoff"), F.when(F.col("date") < F.to_date(F.lit(c)), "pre").otherwise("post").alias("side")) for c in cutoffs]))
    g = rows.withColumn("s", side).groupBy(key, "s.cutoff", "s.side").agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("mean"), F.covar_pop("ret", factor).alias("c"), F.var_pop(factor).alias("v"), F.var_pop("ret").alias("vy"), F.avg(factor).alias("mx"))
    g = g.withColumn("beta", ratio(F.col("c"), F.col("v"))).withColumn("alpha", F.col("mean") - F.col("beta") * F.col("mx"))
    s2 = F.greatest(F.col("n") * (F.col("vy") - F.col("beta") * F.col("c")), F.lit(0.0)) / F.when(F.col("n") > 2, F.col("n") - 2)
    g = g.withColumn("se", F.sqrt(s2 * (1 / F.col("n") + ratio(F.col("mx") * F.col("mx"), F.col("n") * F.col("v")))))
    ok = F.col("n") >= 5
    return g.select(key, "cutoff", "side", "n", "mean", *[F.when(ok, x).alias(c) for c, x in (("alpha", F.col("alpha")), ("beta", F.col("beta")), ("t_alpha", ratio(F.col("alpha"), F.col("se"))))])


def block_replicates(s: DataFrame, block: int, replicates: int, seed: int = 1, key: str = "series_id") -> DataFrame:
    """key, replicate, and the rows of ``s`` drawn by moving blocks, cut to the series' length.

    Starts come from an integer generator that any SQL engine repeats; replicates are exploded, and rows join by index.
    """
    w = Window.partitionBy(key).orderBy("date")
    own = s.withColumn("i", F.row_number().over(w) - 1)
    size = own.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= block)
    draws = size.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / block).cast("int"))))
    state = (F.col("replicate").cast("long") * 1103515 + F.col("k").cast("long") * 12345 + seed * 7919 + 12820163) % 16777213
    state = (state * 1140671 + 12820163) % 16777213
    state = (state * 1140671 + 12820163) % 16777213
    draws = draws.withColumn("start", state % (F.col("n") - block + 1))
    draws = draws.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(block - 1)))).filter(F.col("k") * block + F.col("o") < F.col("n"))
    return draws.select(key, "replicate", (F.col("start") + F.col("o")).alias("i")).join(own, [key, "i"])


def bootstrap_sharpe(s: DataFrame, block: int = 6, replicates: int = 200, confidence: float = 0.95, periods: float = 12.0, seed: int = 1) -> DataFrame:
    """series_id, sharpe, low, high: percentile interval of mean over deviation, annualised."""
    each = block_replicates(s, block, replicates, seed).groupBy("series_id", "replicate").agg((ratio(F.avg("ret"), F.stddev_samp("ret")) * math.sqrt(periods)).alias("x"))
    tail = (1 - confidence) / 2
    ends = each.groupBy("series_id").agg(F.percentile("x", F.array(F.lit(tail), F.lit(1 - tail))).alias("q"), F.count("x").alias("n_replicates"))
    point = s.groupBy("series_id").agg((ratio(F.avg("ret"), F.stddev_samp("ret")) * math.sqrt(periods)).alias("sharpe"))
    return point.join(ends, "series_id").select("series_id", "sharpe", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "n_replicates")


JOINT = "series_id string, block int, n long, n_replicates int, sharpe double, sharpe_low double, sharpe_high double, sharpe_p double, alpha double, alpha_low double, alpha_high double, alpha_p double"


def _draw_bounds(n: int, block: int, replicates: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """First rows and ends of the blocks of every replicate, as ``block_replicates`` draws them."""
    k = np.arange((n - 1) // block + 1)
    state = (np.arange(replicates)[:, None] * 1103515 + k[None, :] * 12345 + seed * 7919 + 12820163) % 16777213
    for _ in range(2):
        state = (state * 1140671 + 12820163) % 16777213
    start = state % (n - block + 1)
    return start, start + np.minimum(block, n - k * block)[None, :]


def joint_statistics(y: np.ndarray, x: np.ndarray, blocks: Sequence[int], replicates: int, seed: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(block, Sharpe ratios, alphas) of the replicates of one series: its own rows and the factors' are drawn together.

    The products of all columns are summed up along the series once. A block's moments are a difference of these sums and a
    replicate's the sum over its blocks, so no row is drawn; all replicates are solved at once.
    """
    n, k = x.shape
    middle, level = x.mean(0), y.mean()
    z = np.column_stack([np.ones(n), x - middle, y - level])
    i, j = np.triu_indices(k + 2)
    prefix = np.vstack([np.zeros(len(i)), np.cumsum(z[:, i] * z[:, j], axis=0)])
    out = []
    for block in (b for b in blocks if b <= n):
        start, end = _draw_bounds(n, block, replicates, seed)
        m = np.empty((replicates, k + 2, k + 2))
        m[:, i, j] = m[:, j, i] = (prefix[end] - prefix[start]).sum(axis=1)
        coef = np.einsum("rij,rj->ri", np.linalg.pinv(m[:, :-1, :-1], hermitian=True), m[:, :-1, -1])
        mean = m[:, 0, -1] / n
        sd = np.sqrt(np.maximum(m[:, -1, -1] - n * mean * mean, 0) / (n - 1))
        with np.errstate(divide="ignore", invalid="ignore"):
            out.append((block, (mean + level) / sd, coef[:, 0] + level - coef[:, 1:] @ middle))
    return out


def bootstrap_joint(rows: DataFrame, factors: Sequence[str], blocks: Sequence[int], replicates: int = 100, periods: float = 12.0, confidence: float = 0.95, seed: int = 1) -> DataFrame:
    """JOINT: percentile intervals and two-sided empirical p of each series' Sharpe ratio and factor alpha, by block length.

    Both come from the same draws of moving blocks. Values are annualised; rows with a missing value are left out, and so
    are block lengths beyond the series. A series is one task: it has a row per month.
    """

    def two_sided(v: np.ndarray) -> float:
        return min(1.0, 2 * min((v <= 0).mean(), (v >= 0).mean()))

    def draw(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        own = table.drop_null().sort_by("date")
        out: dict[str, list] = {c.split()[0]: [] for c in JOINT.split(", ")}
        if own.num_rows > len(factors) + 1:
            y, x = own["ret"].to_numpy(), np.column_stack([own[f].to_numpy() for f in factors])
            point, *_ = np.linalg.lstsq(np.column_stack([np.ones(len(y)), x]), y, rcond=None)
            for block, sharpe, alpha in joint_statistics(y, x, blocks, replicates, seed):
                tail = 50 * (1 - confidence)
                ends = [np.percentile(v, [tail, 100 - tail]) * c for v, c in ((sharpe, math.sqrt(periods)), (alpha, periods))]
                row = [key[0].as_py(), block, len(y), replicates, y.mean() / y.std(ddof=1) * math.sqrt(periods), *ends[0], two_sided(sharpe), point[0] * periods, *ends[1], two_sided(alpha)]
                for c, v in zip(out, row, strict=True):
                    out[c].append(v)
        kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
        return pa.table({n: pa.array(out[n], kinds[k]) for n, k in (c.split() for c in JOINT.split(", "))})

    return rows.select("series_id", "date", F.col("ret").cast("double").alias("ret"), *[F.col(f).cast("double").alias(f) for f in factors]).groupBy("series_id").applyInArrow(draw, JOINT)


def expected_max_sharpe(trials: DataFrame, key: str = "family") -> DataFrame:
    """Expected best Sharpe ratio of independent trials without skill; NULL below two trials or without variation."""
    g = trials.groupBy(key).agg(F.stddev_samp("sharpe").alias("sd"), F.count(F.lit(1)).alias("n"))
    g = g.withColumns({"z1": normal_ppf(1 - 1 / F.col("n")), "z2": normal_ppf(1 - 1 / (F.col("n") * math.e))})
    return g.withColumn("expected_max", F.when((F.col("n") >= 2) & (F.col("sd") * F.col("sd") >= 1e-12), F.col("sd") * ((1 - EULER) * F.col("z1") + EULER * F.col("z2")))).drop("z1", "z2")


def deflated_sharpe(sr: Column, benchmark: Column, n: Column, skew: Column, kurt: Column) -> Column:
    """Probability that the Sharpe ratio per period beats the benchmark; ``kurt`` is plain kurtosis (normal: 3)."""
    root = 1 - skew * sr + (kurt - 1) / 4 * sr * sr
    return normal_cdf(F.when(root > 0, (sr - benchmark) * F.sqrt(n - 1) / F.sqrt(root)))


def synthetic_trials(stats: DataFrame, n: int) -> DataFrame:
    """family, i, sharpe: n pseudo-trials with the family's mean and deviation, from normal quantiles on 0.05..0.95."""
    grid = stats.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("z", normal_ppf(0.05 + 0.9 * F.col("i") / (n - 1)))
    w = Window.partitionBy("family")
    return grid.withColumn("sharpe", F.col("mean") + F.col("sd") * (F.col("z") - F.avg("z").over(w)) / F.stddev_samp("z").over(w)).select("family", "i", "sharpe")


#: P-value coefficients t0, t1, eta by number of parameters (rows) and trimming (columns).
HANSEN_TRIMS = (0.01, 0.05, 0.15, 0.25, 0.35)
HANSEN = {
    1: ((-1.79, 1.17, 4.5), (-1.39, 1.07, 3.6), (-0.99, 1.02, 3.0), (-0.73, 0.98, 2.5), (-0.50, 0.96, 2.1)),
    2: ((-3.06, 1.18, 6.1), (-2.38, 1.11, 5.4), (-1.65, 1.06, 4.7), (-1.16, 1.02, 4.1), (-0.78, 0.97, 3.5)),
    3: ((-4.09, 1.21, 7.8), (-3.31, 1.10, 6.5), (-2.05, 1.13, 6.8), (-1.61, 1.03, 5.5), (-1.06, 1.01, 4.9)),
    4: ((-5.33, 1.21, 8.9), (-4.08, 1.14, 8.2), (-2.52, 1.11, 8.0), (-1.91, 1.04, 7.0), (-1.45, 0.97, 5.7)),
    5: ((-6.39, 1.18, 9.4), (-4.84, 1.15, 9.3), (-3.46, 1.07, 8.3), (-2.63, 1.02, 7.5), (-1.82, 1.00, 7.0)),
    6: ((-7.08, 1.26, 11.8), (-5.37, 1.19, 11.2), (-4.05, 1.08, 9.5), (-2.94, 1.05, 9.0), (-1.79, 1.03, 8.6)),
    7: ((-8.49, 1.17, 11.1), (-6.21, 1.21, 12.6), (-4.42, 1.10, 11.0), (-3.23, 1.05, 10.1), (-2.21, 1.01, 9.3)),
    8: ((-9.20, 1.17, 12.2), (-7.24, 1.13, 11.9), (-5.36, 1.08, 11.3), (-3.65, 1.06, 11.4), (-1.69, 1.10, 12.2)),
    9: ((-10.22, 1.14, 12.3), (-8.07, 1.11, 12.4), (-5.43, 1.10, 13.1), (-4.38, 1.01, 11.3), (-2.83, 1.00, 11.1)),
    10: ((-11.01, 1.14, 13.3), (-8.84, 1.11, 13.2), (-6.47, 1.06, 12.8), (-4.97, 1.01, 12.0), (-2.92, 1.05, 13.0)),
}


def hansen_pvalue(f: Column, m: int = 1, trim: float = 0.15, table: Mapping[int, Sequence[tuple[float, float, float]]] = HANSEN) -> Column:
    """Approximate p-value of a sup F statistic; ValueError for what is not tabulated.

    ``table`` holds, by number of parameters, the coefficients for each of HANSEN_TRIMS; a table of one's own goes beyond ten.
    """
    if m not in table or trim not in HANSEN_TRIMS:
        raise ValueError(f"not tabulated: m={m}, trimming={trim}")
    t0, t1, eta = table[m][HANSEN_TRIMS.index(trim)]
    x = t0 + t1 * f
    return F.when(x <= 0, F.lit(1.0)).otherwise(chi2_tail(x, F.lit(eta)))


def sup_f(s: DataFrame, key: str = "series_id", x: str = "ret", trim: float = 0.15) -> DataFrame:
    """Largest Chow F of a mean shift over the trimmed middle, its date, and means and counts before and from it.

    Prefix sums give both sides' squared errors at every candidate, so the rows are read once.
    """
    w = Window.partitionBy(key).orderBy("date")
    past, every = w.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(key)
    e = s.select(key, "date", F.col(x).alias("y"), (F.row_number().over(w) - 1).alias("k"), F.count(F.lit(1)).over(every).alias("n"), F.sum(x).over(past).alias("s1"), F.sum(F.col(x) * F.col(x)).over(past).alias("q1"), F.sum(x).over(every).alias("s"), F.sum(F.col(x) * F.col(x)).over(every).alias("q"))
    e = e.filter((F.col("k") >= F.ceil(F.col("n") * trim)) & (F.col("k") <= F.col("n") - F.ceil(F.col("n") * trim)) & (F.col("k") > 0))
    left = F.col("q1") - F.col("s1") * F.col("s1") / F.col("k")
    s2 = F.col("s") - F.col("s1")
    right = F.col("q") - F.col("q1") - s2 * s2 / (F.col("n") - F.col("k"))
    whole = F.col("q") - F.col("s") * F.col("s") / F.col("n")
    e = e.withColumn("f", ratio(whole - left - right, (left + right) / (F.col("n") - 2)))
    best = F.max_by(F.struct("f", "date", "k", "n", (F.col("s1") / F.col("k")).alias("pre_mean"), (s2 / (F.col("n") - F.col("k"))).alias("post_mean")), F.struct("f", -F.col("k")))
    return e.groupBy(key).agg(best.alias("b")).select(key, F.col("b.f").alias("sup_f"), F.col("b.date").alias("break_date"), "b.pre_mean", "b.post_mean", F.col("b.k").cast("long").alias("n_pre"), (F.col("b.n") - F.col("b.k")).cast("long").alias("n_post"))


def normal_two_sided(z: Column) -> Column:
    return 2 * (1 - normal_cdf(F.abs(z)))


def trial_moments(s: DataFrame) -> DataFrame:
    r = F.col("ret")
    return s.groupBy("series_id").agg(F.count(r).alias("n"), ratio(F.avg(r), F.stddev_samp(r)).alias("sr"), adjusted_skew(r).alias("skew"), (adjusted_kurtosis(r) + 3).alias("kurt"))
