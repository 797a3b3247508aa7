"""Column checks and the null rule of the library.

Missing values are NULL everywhere: NaN becomes NULL at the boundary, and every division is ``try_divide``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """``df`` itself; ValueError if it lacks a column. Looks at the schema only, runs no job."""
    lacking = [n for n in names if n not in df.columns]
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}; there are: {', '.join(df.columns)}")
    return df


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN to NULL in every float or double column."""
    own = {f.name: F.nanvl(f.name, F.lit(None)) for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns({n: F.when(F.isnan(n), None).otherwise(F.col(n)) for n in own}) if own else df


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero or either is NULL."""
    return F.try_divide(a, b)


def mean_of(*columns: Column) -> Column:
    """Mean of the columns that are not NULL; NULL if none is."""
    total, n = F.lit(0.0), F.lit(0)
    for c in columns:
        total, n = total + F.coalesce(c, F.lit(0.0)), n + F.when(c.isNotNull(), 1).otherwise(0)
    return F.try_divide(total, n)


def r6(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """The named double columns (all if none is named) rounded, for comparison across engines; no negative zero."""
    own = names or [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({n: F.round(F.col(n), digits) + F.lit(0.0) for n in own})
