"""Alerts with stable keys, throttled against the last runs of the alert log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import short_key

RECENT_RUNS = 3


def from_results(results: DataFrame) -> DataFrame:
    """Alerts of warnings and breaches, in the columns of the alert log."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    return results.filter(F.col("status").isin("warn", "breach")).select(
        "run_at", short_key(F.col("table_name"), F.col("monitor"), F.col("column_name"), F.col("status")).alias("alert_key"), F.col("status").alias("severity"),
        F.format_string("[%s] %s on %s", "status", "monitor", "table_name").alias("title"),
        F.concat(F.coalesce("detail", F.lit("")), F.lit("\n\nmetric="), text("metric"), F.lit(" baseline="), text("baseline_median"), F.lit(" kind="), text("kind"), F.lit(" column="), text("column_name")).alias("body"),
        F.lit("monitors").alias("source"),
    )


def recent_keys(log: DataFrame, runs: int = RECENT_RUNS) -> DataFrame:
    """Keys of the last distinct runs of the log: a top-k of dates (``runs`` rows), then a semi-join."""
    last = log.select("run_at").distinct().orderBy(F.col("run_at").desc()).limit(runs)
    return log.join(last, "run_at", "left_semi").select("alert_key").distinct()


def route(alerts: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to deliver and log, throttled).  An alert that a batch repeats is delivered once."""
    known = recent_keys(log)
    fresh = alerts.join(known, "alert_key", "left_anti").dropDuplicates(["alert_key"]).withColumn("delivered", F.lit(True))
    return fresh, alerts.join(known, "alert_key", "left_semi")
