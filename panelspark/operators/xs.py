"""Cross-sectional transforms and sorts, for all dates at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.windows import quantile_bucket, winsorized, xs, zscore
from ..schemas import mean_of, require_columns
from .asof import asof_max_age


def standardise(df: DataFrame, x: str = "raw_signal", by: Sequence[str] = ("date",), p: float = 0.01) -> DataFrame:
    """Adds winsorized and z_score."""
    w = xs(*by)
    return require_columns(df, x, *by).withColumn("winsorized", winsorized(F.col(x), p, w)).withColumn("z_score", zscore(F.col("winsorized"), w))


def align_signal(raw: DataFrame, members: DataFrame, p: float = 0.01, max_age: int = 400) -> DataFrame:
    """date, permno, raw_signal, winsorized, z_score: each member's latest event, standardised per date."""
    got = asof_max_age(members.select("date", "permno"), raw, ["permno"], "date", "date_filed", ["raw_signal"], max_age, ties=["raw_signal"])
    return standardise(got.drop("matched_time"), p=p).select("date", "permno", "raw_signal", "winsorized", "z_score")


def _side_by_side(panels: Mapping[str, DataFrame], flipped: Sequence[str]) -> DataFrame:
    """Outer union of aligned panels on (date, permno): a column of z-scores each, ``flipped`` ones negated."""
    names = list(panels)
    rows = None
    for s, p in panels.items():
        z = -F.col("z_score") if s in flipped else F.col("z_score")
        one = p.select("date", "permno", *[(z if s == n else F.lit(None).cast("double")).alias(f"z_{n}") for n in names])
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("date", "permno").agg(*[F.max(f"z_{n}").alias(f"z_{n}") for n in names])


def _available(names: Sequence[str]) -> Column:
    return sum((F.when(F.col(f"z_{n}").isNotNull(), 1).otherwise(0) for n in names), F.lit(0)).cast("long")


def composite(panels: Mapping[str, DataFrame], least: int = 2, flipped: Sequence[str] = ("ivol",)) -> DataFrame:
    """Outer union of aligned panels on (date, permno), mean of the available z-scores (``flipped`` ones negated), again standardised."""
    names = list(panels)
    both = _side_by_side(panels, flipped).withColumn("n_signals", _available(names)).filter(F.col("n_signals") >= least)
    both = both.withColumn("composite_raw", mean_of(*[F.col(f"z_{n}") for n in names]))
    return both.withColumn("composite_z", zscore(F.col("composite_raw"), xs("date")))


def composites(panels: Mapping[str, DataFrame], variants: Mapping[str, Sequence[str]], least: int = 2, flipped: Sequence[str] = ("ivol",)) -> DataFrame:
    """variant, date, permno, n_signals, composite_raw, composite_z: ``composite`` of several choices of panels, each panel read once."""
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), _available(use).alias("n_signals"), mean_of(*[F.col(f"z_{n}") for n in use]).alias("composite_raw")) for v, use in variants.items()]))
    both = _side_by_side(panels, flipped).select("date", "permno", each.alias("v")).select("v.variant", "date", "permno", "v.n_signals", "v.composite_raw").filter(F.col("n_signals") >= least)
    return both.withColumn("composite_z", zscore(F.col("composite_raw"), xs("variant", "date")))


def qcut(df: DataFrame, x: str = "z_score", n: int = 5, by: Sequence[str] = ("date",), name: str = "quintile", least: int | None = None) -> DataFrame:
    return require_columns(df, x, *by).withColumn(name, quantile_bucket(F.col(x), n, xs(*by), least))


def split_at(df: DataFrame, x: str, quantiles: Sequence[float], labels: Sequence[str], by: Sequence[str] = ("date",), name: str = "size") -> DataFrame:
    """Labels by strict ``<`` against the quantiles of each cross-section."""
    w = xs(*by)
    label: Column = F.lit(labels[-1])
    for q, text in reversed(list(zip(quantiles, labels[:-1], strict=True))):
        label = F.when(F.col(x) < F.percentile(F.col(x), F.lit(q)).over(w), text).otherwise(label)
    return df.withColumn(name, F.when(F.col(x).isNotNull(), label))


def breakpoints(df: DataFrame, x: str = "marketcap", by: str = "month", least: int = 10, of: Column | None = None) -> DataFrame:
    """p20, p40, p60, p80, median and count of a reference part of each cross-section with at least ``least`` names."""
    rows = df.filter((F.col(x) > 0) & (of if of is not None else F.lit(True)))
    qs = F.percentile(x, F.array(*[F.lit(q) for q in (0.2, 0.4, 0.6, 0.8, 0.5)]))
    got = rows.groupBy(by).agg(qs.alias("q"), F.count(F.lit(1)).alias("n_names")).filter(F.col("n_names") >= least)
    return got.select(by, *[F.col("q")[i].alias(c) for i, c in enumerate(("p20", "p40", "p60", "p80", "median"))], "n_names")


def breakpoint_bucket(df: DataFrame, points: DataFrame, x: str = "marketcap", by: str = "month", scale: float = 1.0, name: str = "size_bucket") -> DataFrame:
    """1..5 by ``<=`` against outside breakpoints; rows without breakpoints are dropped."""
    label: Column = F.lit(5)
    for k, c in reversed(list(enumerate(("p20", "p40", "p60", "p80"), 1))):
        label = F.when(F.col(x) <= F.col(c) * scale, k).otherwise(label)
    return df.join(points.select(by, "p20", "p40", "p60", "p80"), by).withColumn(name, label).drop("p20", "p40", "p60", "p80")


def exclude_top_n(df: DataFrame, n: int, x: str = "marketcap", by: str = "date") -> DataFrame:
    """Rows with is_top flagged: the n largest of each cross-section."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(x), "permno"))
    return df.withColumn("is_top", rank <= n)


def neutral_weights(
    df: DataFrame, alpha: str = "alpha", beta: str = "beta", sector: str = "sector", by: Sequence[str] = ("date",), gross: float = 1.5, cap: float = 0.015, strength: float = 1.0, most: int = 50_000,
) -> DataFrame:
    """Adds weight: the portfolio nearest to a multiple of alpha that meets all constraints of its cross-section.

    Constraints: weights add up to zero in each sector (and so in dollars), have no beta, are at most ``cap`` in size, and
    their sizes add up to ``gross`` at most. The target is alpha, neutral to sectors and beta, scaled to ``strength`` times
    ``gross``, or times what the caps of all names add up to where that is less; with equal variances and no covariances this is the mean-variance optimum. Dykstra's alternating
    projections (box, gross ball, neutral subspace) run until a cross-section no longer moves and all its constraints hold
    to 1e-10; one that does not get there in ``most`` rounds is an error. A cross-section is one group in one task: a
    universe of names on a date. Names without alpha, beta or sector have weight 0.
    """
    require_columns(df, alpha, beta, sector, *by)
    schema = T.StructType([*df.schema.fields, T.StructField("weight", T.DoubleType())])

    def solve(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        a, b = (rows[c].cast(pa.float64()).to_numpy(zero_copy_only=False) for c in (alpha, beta))
        group = pc.fill_null(rows[sector].combine_chunks().dictionary_encode().indices, -1).to_numpy()
        own = np.isfinite(a) & np.isfinite(b) & (group >= 0)
        weight = np.zeros(rows.num_rows)
        if own.any():
            weight[own] = nearest_neutral(a[own], b[own], group[own], gross, cap, strength, most)
        return rows.append_column("weight", pa.array(weight))

    return df.groupBy(*by).applyInArrow(solve, schema)


def nearest_neutral(alpha: np.ndarray, beta: np.ndarray, group: np.ndarray, gross: float, cap: float, strength: float, most: int) -> np.ndarray:
    """Weights of one cross-section; ``group`` numbers the sectors."""
    members = np.maximum(np.bincount(group), 1)

    def within(x: np.ndarray) -> np.ndarray:
        return x - (np.bincount(group, x) / members)[group]

    b = within(beta)
    square = b @ b

    def neutral(x: np.ndarray) -> np.ndarray:
        x = within(x)
        return x - (x @ b / square) * b if square > 1e-18 else x

    target = neutral(alpha)
    size = np.abs(target).sum()
    if size <= 1e-15:
        return np.zeros(len(alpha))
    x = target * (strength * min(gross, cap * len(alpha)) / size)
    off_box, off_ball, count = np.zeros_like(x), np.zeros_like(x), np.arange(1, len(x) + 1)
    for _ in range(most):
        before = x
        y = np.clip(x + off_box, -cap, cap)
        off_box = x + off_box - y
        v = y + off_ball
        level = ((np.cumsum(np.sort(np.abs(v))[::-1]) - gross) / count).max()
        z = np.sign(v) * np.maximum(np.abs(v) - max(level, 0.0), 0.0)
        off_ball = v - z
        x = neutral(z)
        if np.abs(x - before).max() < 1e-13 and np.abs(x).max() <= cap + 1e-10 and np.abs(x).sum() <= gross + 1e-10:
            return x
    raise RuntimeError(f"no weights after {most} rounds")
