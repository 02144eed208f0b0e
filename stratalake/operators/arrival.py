"""Arrival checks: how late, which periods are missing, which are thin."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, functions as F

from ..functions.calendar import expected_periods
from .monitors import MonitorResult

LOOKBACK_DAYS = 30


def period_counts(df: DataFrame, column: str) -> DataFrame:
    """(period, n); rows without a date are in no period."""
    return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("date").alias("period")).agg(F.count(F.lit(1)).alias("n"))


def missing(expected: DataFrame, observed: DataFrame) -> DataFrame:
    return expected.join(observed, "period", "left_anti")


def check_arrival(df: DataFrame | None, table: str, column: str, calendar: str, max_lag_days: int, min_rows: int | None, as_of: date) -> list[MonitorResult]:
    """Lag, gap and, where a floor is declared, partial periods."""
    result = lambda what, col, metric, status, detail: MonitorResult(f"{table}_{what}", table, col, what if what != "arrival" else "arrival_missing", metric, None, status, detail, as_of)
    if df is None:
        return [result("arrival", None, None, "breach", "table does not exist")]
    ends = df.agg(F.min(F.col(column).cast("date")).alias("a"), F.max(F.col(column).cast("date")).alias("b")).first()
    if ends["b"] is None:
        return [result("arrival", column, 0.0, "breach", "no data at all")]
    oldest, newest = ends["a"], ends["b"]
    lag = (as_of - newest).days
    out = [result("arrival_lag", column, float(lag), "breach" if lag > max_lag_days else "ok", f"newest {newest} is {lag}d behind {as_of} (limit {max_lag_days}d)")]
    start, end = max(newest - timedelta(LOOKBACK_DAYS), oldest), max(as_of, newest)
    # the filter on the range reaches the scan, so only the window is counted
    counts = period_counts(df.filter((F.col(column) >= F.lit(start)) & (F.col(column) < F.lit(end + timedelta(1)))), column)
    seen = expected_periods(df.sparkSession, calendar, start, end).join(counts, "period", "left")
    floor = F.lit(min_rows).cast("long")
    s = seen.agg(F.count_if(F.col("n").isNull()).alias("gaps"), F.slice(F.sort_array(F.collect_list(F.when(F.col("n").isNull(), F.col("period")))), 1, 5).alias("first"), F.count_if(F.col("n") < floor).alias("thin")).first()
    out.append(result("arrival_gap", column, float(s["gaps"]), "breach" if s["gaps"] else "ok", f"{s['gaps']} missing period(s): {', '.join(map(str, s['first']))}" if s["gaps"] else "no gaps in the expected calendar"))
    if min_rows is not None:
        out.append(result("arrival_partial", column, float(s["thin"]), "warn" if s["thin"] else "ok", f"{s['thin']} period(s) below {min_rows} rows" if s["thin"] else "all periods complete"))
    return out
