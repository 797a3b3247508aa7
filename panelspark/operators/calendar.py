"""Rebalance calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rebalance_dates(span: DataFrame, business: bool = True) -> DataFrame:
    """start, end (one row) -> date: the last business day (Monday to Friday) of each month, or its last day."""
    months = span.select(F.explode(F.sequence(F.trunc("start", "MM"), F.trunc("end", "MM"), F.expr("interval 1 month"))).alias("m"))
    last = F.last_day("m")
    back = F.greatest(F.lit(0), F.weekday(last) - 4)
    return months.select((F.date_sub(last, back) if business else last).alias("date"))


def month_end_trading_days(days: DataFrame, date: str = "date") -> DataFrame:
    """The last date of each month that occurs."""
    return days.groupBy(F.trunc(date, "MM").alias("month")).agg(F.max(date).alias("date"))
