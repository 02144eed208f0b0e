"""Calendars of expected periods."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import MARKET_HOLIDAYS

CALENDARS = ("daily", "trading")


def expected_periods(spark: SparkSession, calendar: str, start: date, end: date) -> DataFrame:
    """(period): every day from start to end, or only trading days: weekdays that aren't market holidays."""
    if calendar not in CALENDARS:
        raise ValueError(f"unknown calendar {calendar!r}; expected one of {', '.join(CALENDARS)}")
    if start > end:
        return spark.createDataFrame([], "period date")
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end), F.expr("interval 1 day"))).alias("period"))
    if calendar == "trading":
        closed = [d for d in MARKET_HOLIDAYS if start <= d <= end]
        days = days.filter(F.weekday("period") < 5)
        days = days.filter(~F.col("period").isin(closed)) if closed else days
    return days


def trading_days(start: date, end: date, holidays: Iterable[date] = MARKET_HOLIDAYS) -> list[date]:
    """The same for short driver-side ranges."""
    closed = set(holidays)
    return [d for d in (start + timedelta(n) for n in range((end - start).days + 1)) if d.weekday() < 5 and d not in closed]
