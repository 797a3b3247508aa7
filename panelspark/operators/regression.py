"""Regressions on any design, many keys in one job: moments are sums, systems are solved in batches, rows never meet.

A design is a list of columns (with one of ones for an intercept). Keys with a missing value in a row leave that row out.
A singular design is solved by its pseudo-inverse.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.distributions import chi2_tail, f_tail
from ..schemas import ratio
from .inference import hansen_pvalue


def _pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def _whole(flat: np.ndarray, k: int) -> np.ndarray:
    """Symmetric matrices from their upper triangles, a row each."""
    out = np.empty((len(flat), k, k))
    for c, (i, j) in enumerate(_pairs(k)):
        out[:, i, j] = out[:, j, i] = flat[:, c]
    return out


def _moments(y: str, x: Sequence[str], total) -> tuple[Column, Column]:
    """Arrays of the sums of the design's products and of its products with y."""
    return F.array(*[total(F.col(x[i]) * F.col(x[j])) for i, j in _pairs(len(x))]), F.array(*[total(F.col(c) * F.col(y)) for c in x])


def _complete(rows: DataFrame, y: str, x: Sequence[str]) -> DataFrame:
    return rows.dropna(subset=[y, *x])


@F.pandas_udf(T.StructType([T.StructField("inverse", T.ArrayType(T.DoubleType())), T.StructField("coef", T.ArrayType(T.DoubleType()))]))
def _solved(xx: pd.Series, xy: pd.Series) -> pd.DataFrame:
    b = np.array(xy.tolist(), float)
    inverse = np.linalg.pinv(_whole(np.array(xx.tolist(), float), b.shape[1]), hermitian=True)
    return pd.DataFrame({"inverse": list(inverse.reshape(len(b), -1)), "coef": list(np.einsum("nij,nj->ni", inverse, b))})


def fit(rows: DataFrame, key: Sequence[str], y: str, x: Sequence[str]) -> DataFrame:
    """key, n, inverse (of the design's product matrix, by rows), coef."""
    xx, xy = _moments(y, x, F.sum)
    g = _complete(rows, y, x).groupBy(*key).agg(F.count(F.lit(1)).alias("n"), xx.alias("xx"), xy.alias("xy"))
    return g.withColumn("s", _solved("xx", "xy")).select(*key, "n", "s.*")


def residuals(rows: DataFrame, key: Sequence[str], y: str, x: Sequence[str]) -> DataFrame:
    """Rows with fitted, residual and leverage (the diagonal of the hat matrix), and the n of their key."""
    k = len(x)
    own = _complete(rows, y, x).join(fit(rows, key, y, x), list(key))
    fitted = sum((F.col("coef")[i] * F.col(c) for i, c in enumerate(x)), F.lit(0.0))
    leverage = sum((F.col("inverse")[i * k + j] * F.col(a) * F.col(b) for i, a in enumerate(x) for j, b in enumerate(x)), F.lit(0.0))
    return own.withColumns({"fitted": fitted, "leverage": leverage}).withColumn("residual", F.col(y) - F.col("fitted")).drop("coef", "inverse")


def influence(rows: DataFrame, key: Sequence[str], y: str, x: Sequence[str]) -> DataFrame:
    """``residuals`` with cooks, by the mean of the squared residuals: NULL where the leverage is 1 or all residuals are zero."""
    own = residuals(rows, key, y, x)
    mse = F.avg(F.col("residual") * F.col("residual")).over(Window.partitionBy(*key))
    h = F.col("leverage")
    return own.withColumn("cooks", F.when(h < 1 - 1e-9, ratio(F.col("residual") * F.col("residual") * h, len(x) * mse * (1 - h) * (1 - h))))


def breusch_pagan(rows: DataFrame, key: Sequence[str], y: str, x: Sequence[str]) -> DataFrame:
    """key, n, r2, lm, lm_p, f, f_p: squared residuals on the design itself.

    A key whose design has no column of equal values is an error, as the test compares with an intercept alone.
    """
    k = len(x)
    if k < 2:
        raise ValueError("the design needs an intercept and one column more")
    fixed = functools.reduce(lambda p, q: p | q, [F.min(c) == F.max(c) for c in x])
    sound = _complete(rows, y, x).groupBy(*key).agg(F.when(~fixed, F.raise_error("breusch_pagan: the design has no intercept")).otherwise(F.lit(True)).alias("__sound"))
    squares = residuals(rows, key, y, x).select(*key, *x, (F.col("residual") * F.col("residual")).alias("__q"))
    left = residuals(squares, key, "__q", x).join(sound, list(key)).filter("__sound").groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("residual") * F.col("residual")).alias("sse"), (F.var_pop("__q") * F.count(F.lit(1))).alias("sst"))
    g = left.withColumn("r2", 1 - ratio(F.col("sse"), F.col("sst")))
    free = F.when(F.col("n") > k, F.col("n") - k)
    g = g.withColumns({"lm": F.col("n") * F.col("r2"), "f": ratio(F.col("r2") / (k - 1), (1 - F.col("r2")) / free)})
    return g.select(*key, "n", "r2", "lm", chi2_tail("lm", F.lit(float(k - 1))).alias("lm_p"), "f", f_tail("f", F.lit(float(k - 1)), free.cast("double")).alias("f_p"))


def hac_covariance(rows: DataFrame, key: str, y: str, x: Sequence[str], lags: Sequence[int], order: str = "date") -> DataFrame:
    """key, lag, term_i, term_j, cov: Bartlett covariance matrix of the coefficients, without small-sample factor."""
    k, top = len(x), max(lags)
    e = residuals(rows, [key], y, x)
    u = e.withColumns({f"__u{i}": F.col(c) * F.col("residual") for i, c in enumerate(x)})
    w = Window.partitionBy(key).orderBy(order)
    u = u.withColumns({f"__l{j}_{i}": F.lag(f"__u{i}", j).over(w) for j in range(1, top + 1) for i in range(k)})
    gamma = F.array(*[F.coalesce(F.sum(F.col(f"__u{a}") * F.col(f"__l{j}_{b}" if j else f"__u{b}")), F.lit(0.0)) for j in range(top + 1) for a in range(k) for b in range(k)])
    g = u.groupBy(key).agg(gamma.alias("gamma")).join(fit(rows, [key], y, x), key).withColumn("lag", F.explode(F.array(*map(F.lit, lags))))

    @F.pandas_udf("array<double>")
    def sandwich(gamma: pd.Series, inverse: pd.Series, lag: pd.Series) -> pd.Series:
        own = np.array(gamma.tolist(), float).reshape(-1, top + 1, k, k)
        a = np.array(inverse.tolist(), float).reshape(-1, k, k)
        j = np.arange(1, top + 1)[None, :]
        weight = np.maximum(0, 1 - j / (lag.to_numpy()[:, None] + 1))
        both = own[:, 1:] + own[:, 1:].transpose(0, 1, 3, 2)
        s = own[:, 0] + np.einsum("nj,njab->nab", weight, both)
        return pd.Series(list((a @ s @ a).reshape(len(a), -1)))

    cells = F.explode(F.array(*[F.struct(F.lit(p).alias("term_i"), F.lit(q).alias("term_j"), F.col("v")[i * k + j].alias("cov")) for i, p in enumerate(x) for j, q in enumerate(x)]))
    return g.withColumn("v", sandwich("gamma", "inverse", "lag")).select(key, "lag", cells.alias("c")).select(key, "lag", "c.*")


def sup_f(rows: DataFrame, key: str, y: str, x: Sequence[str], trim: float = 0.15, order: str = "date") -> DataFrame:
    """key, sup_f, n_pre, break_at (first row after the break), p_value: largest Chow F of a break in all coefficients.

    Running sums of the design's moments give both sides' squared errors at every candidate; the systems are solved in
    batches. The p-value is NULL where the number of coefficients or the trimming is not tabulated.
    """
    k = len(x)
    w = Window.partitionBy(key).orderBy(order)
    past, every = w.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(key)
    own = _complete(rows, y, x)
    parts = {}
    for name, over in (("pre", past), ("all", every)):
        xx, xy = _moments(y, x, lambda c, over=over: F.coalesce(F.sum(c).over(over), F.lit(0.0)))
        parts |= {f"{name}_xx": xx, f"{name}_xy": xy, f"{name}_yy": F.coalesce(F.sum(F.col(y) * F.col(y)).over(over), F.lit(0.0))}
    own = own.select(key, F.col(order).alias("at"), (F.row_number().over(w) - 1).alias("t"), F.count(F.lit(1)).over(every).alias("n"), *[c.alias(n) for n, c in parts.items()])
    low = F.greatest(F.ceil(F.col("n") * trim), F.lit(k + 1))
    own = own.filter((F.col("t") >= low) & (F.col("t") <= F.least(F.floor(F.col("n") * (1 - trim)), F.col("n") - k - 1)))

    @F.pandas_udf("double")
    def chow(axx: pd.Series, axy: pd.Series, ayy: pd.Series, pxx: pd.Series, pxy: pd.Series, pyy: pd.Series, n: pd.Series) -> pd.Series:
        def squared(xx: np.ndarray, xy: np.ndarray, yy: np.ndarray) -> np.ndarray:
            return np.maximum(yy - np.einsum("ni,nij,nj->n", xy, np.linalg.pinv(_whole(xx, k), hermitian=True), xy), 0)

        whole = [np.array(v.tolist(), float) for v in (axx, axy, ayy)]
        pre = [np.array(v.tolist(), float) for v in (pxx, pxy, pyy)]
        apart = squared(*pre) + squared(*[a - b for a, b in zip(whole, pre, strict=True)])
        with np.errstate(divide="ignore", invalid="ignore"):
            f = ((squared(*whole) - apart) / k) / (apart / (n.to_numpy() - 2 * k))
        return pd.Series(np.where(apart > 0, np.maximum(f, 0), np.nan)).astype(object).where(apart > 0, None)

    scored = own.withColumn("f", chow("all_xx", "all_xy", "all_yy", "pre_xx", "pre_xy", "pre_yy", "n")).filter("f is not null")
    best = scored.groupBy(key).agg(F.max(F.struct("f", -F.col("t"), "at")).alias("b"))
    got = best.select(key, F.col("b.f").alias("sup_f"), (-F.col("b.col2")).cast("long").alias("n_pre"), F.col("b.at").alias("break_at"))
    try:
        p = hansen_pvalue(F.col("sup_f"), k, trim)
    except ValueError:
        p = F.lit(None).cast("double")
    return got.withColumn("p_value", p)
