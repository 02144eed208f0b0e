"""Latest record for each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in ``order``.  Catalyst turns the filter into a group limit before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def split(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """(rows where the condition is true, all others): null counts as not true, so no row is lost."""
    sure = F.coalesce(condition, F.lit(False))
    return df.filter(sure), df.filter(~sure)
