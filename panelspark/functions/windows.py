"""Windows and column expressions that several operators use."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import ratio


def xs(*keys: str):
    """All rows of a cross-section."""
    return Window.partitionBy(*keys)


def trailing(n: int, key: str | Sequence[str] = "permno", by: str = "date"):
    """The last n rows, this one included."""
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(by).rowsBetween(1 - n, 0)


def trailing_sums(df: DataFrame, sums: Mapping[str, Column], n: int, key: str = "permno", by: str = "date") -> DataFrame:
    """Adds the sums of expressions over each key's last ``n`` rows (or those there are).

    Each frame is added up on its own, in one sort by key and ``by`` of rows that hold no partial sums yet: nothing is
    subtracted, so no digits are lost. A NULL counts as zero; of rows that tie in ``by``, any order is taken.
    """
    w = trailing(n, key, by)
    return df.withColumns({c: F.coalesce(F.sum(e).over(w), F.lit(0.0)) for c, e in sums.items()})


def so_far(key: str | Sequence[str], by: str = "date"):
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)


def winsorized(x: Column, p: float, w) -> Column:
    """``x`` clipped to its linear p and 1 - p quantiles in the window; p = 0 leaves it."""
    if not 0 <= p < 0.5:
        raise ValueError("p must be in [0, 0.5)")
    if p == 0:
        return x
    low, high = F.percentile(x, F.lit(p)).over(w), F.percentile(x, F.lit(1 - p)).over(w)
    return F.when(x.isNotNull(), F.greatest(F.least(x, high), low))


def zscore(x: Column, w, least: float = 1e-12) -> Column:
    """(x - mean) / sample deviation in the window; NULL where the deviation is NULL or below ``least``."""
    sd = F.stddev_samp(x).over(w)
    return F.when(sd >= least, (x - F.avg(x).over(w)) / sd)


def quantile_bucket(x: Column, n: int, w, least: int | None = None) -> Column:
    """Label 1..n by right-closed linear quantile edges of the window, equal edges counting once.

    NULL where the window holds fewer than ``least`` (default n) values or a single distinct edge.
    """
    edges = F.array_distinct(F.percentile(x, F.array(*[F.lit(i / n) for i in range(n + 1)])).over(w))
    label = F.greatest(F.lit(1), F.size(F.filter(edges, lambda e: e < x)))
    return F.when(x.isNotNull() & (F.count(x).over(w) >= (least or n)) & (F.size(edges) >= 2), label)


def average_rank(x: Column, *keys: Column | str) -> Column:
    """Rank within the keys in which equal values share the mean of their ranks."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, x)) - 1) / 2


def adjusted_skew(x: Column) -> Column:
    """Bias-adjusted skewness; NULL below three values."""
    n = F.count(x)
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def adjusted_kurtosis(x: Column) -> Column:
    """Bias-adjusted excess kurtosis; NULL below four values."""
    n = F.count(x)
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def compounded(r: Column) -> Column:
    return F.product(1 + r) - 1


def tied_last(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The last row of each key in the given order."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")
