"""As-of joins: one shuffle on the key, one sort, no join.

Left and right rows are put together and ordered by key, time and side; the last right row so far is what a left row
gets. Rows of one key are sorted in one task, as a window needs; keys are securities, so there are many.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import require_columns


def asof_by_key(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, payload: Sequence[str], forward: bool = False, ties: Sequence[str] = ()) -> DataFrame:
    """All columns of ``left``, with ``matched_time`` and the payload of the latest right row at or before its time.

    ``forward`` takes the first right row strictly after it instead. A right row counts even if its payload is NULL. Of
    right rows with equal times the one with the greatest ``ties`` is taken. Left rows without a match keep NULLs.
    """
    require_columns(left, *keys, left_time)
    require_columns(right, *keys, right_time, *payload, *ties)
    sign = -1 if forward else 1
    own = F.struct(*[F.col(c) for c in left.columns]).alias("__left")
    found = F.struct(F.col(right_time).alias("matched_time"), *[F.col(c) for c in payload]).alias("__right")
    tie = F.struct(*[F.col(c) for c in ties]) if ties else F.struct(F.lit(0).alias("x"))
    r = right.select(*keys, (sign * F.unix_date(F.col(right_time).cast("date"))).alias("__t"), F.lit(0).alias("__side"), found, tie.alias("__tie"))
    at = sign * F.unix_date(F.col(left_time).cast("date")) - (1 if forward else 0)
    at = at.alias("__t")
    el = left.select(*keys, at, F.lit(1).alias("__side"), own)
    w = Window.partitionBy(*keys).orderBy("__t", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    both = r.unionByName(el, allowMissingColumns=True)
    hit = both.withColumn("__hit", F.last("__right", ignorenulls=True).over(w)).filter("__side = 1")
    return hit.select("__left.*", "__hit.matched_time", *[F.col(f"__hit.{c}").alias(c) for c in payload])


def last_before(rows: DataFrame, dates: DataFrame, extend: Callable[[DataFrame], DataFrame] | None = None, key: str = "permno", time: str = "date", calendar: DataFrame | None = None) -> DataFrame:
    """The rows that an as-of join on ``dates`` can find: each key's last one up to a date and after the date before.

    ``dates`` is a calendar, a few rows a month. ``extend`` adds columns to all rows before the others are dropped.
    ``calendar`` has all times of the rows as ``date``, where they are known.
    """
    days = (rows.select(F.col(time).alias("__day")) if calendar is None else calendar.select(F.col("date").alias("__day"))).distinct()
    ends = days.join(F.broadcast(dates.select(F.col("date").alias("__end")).distinct()), F.col("__end") >= F.col("__day")).groupBy(F.col("__day").alias(time)).agg(F.min("__end").alias("__end"))
    own = rows.join(F.broadcast(ends), time, "left").withColumn("__next", F.lead("__end").over(Window.partitionBy(key).orderBy(time)))
    own = extend(own) if extend else own
    return own.filter(F.col("__end").isNotNull() & ~F.col("__end").eqNullSafe(F.col("__next"))).drop("__end", "__next")


def asof_global(left: DataFrame, right: DataFrame, left_time: str, right_time: str) -> DataFrame:
    """``left`` with ``matched_time``: the latest right time at or before its own. ``right`` is a calendar: a few rows a month."""
    times = right.select(F.col(right_time).alias("__r")).distinct()
    dates = left.select(F.col(left_time).alias("__d")).distinct()
    best = dates.join(F.broadcast(times), F.col("__r") <= F.col("__d"), "left").groupBy("__d").agg(F.max("__r").alias("matched_time"))
    return left.join(best, left[left_time] == best["__d"]).drop("__d")


def asof_max_age(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, payload: Sequence[str], max_age: int, ties: Sequence[str] = ()) -> DataFrame:
    """As ``asof_by_key``; a match older than ``max_age`` days counts as none."""
    got = asof_by_key(left, right, keys, left_time, right_time, payload, ties=ties)
    fresh = F.datediff(F.col(left_time), F.col("matched_time")) <= max_age
    return got.withColumns({c: F.when(fresh, F.col(c)) for c in ["matched_time", *payload]})
