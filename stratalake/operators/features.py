"""Window features over observed rows; every frame is trailing and ends with the current row unless it says otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from ..functions.scalars import ratio


def trailing(w: WindowSpec, rows: int) -> WindowSpec:
    """The current row and those before it, ``rows`` in all."""
    return w.rowsBetween(-(rows - 1), 0)


def z_score(c: Column, w: WindowSpec) -> Column:
    return ratio(c - F.avg(c).over(w), F.stddev_samp(c).over(w))


def _forward(w: WindowSpec, steps: int, price: str) -> Column:
    return (ratio(F.lead(price, steps).over(w), F.col(price)) - 1).alias(f"fwd_ret_{steps}d")


def price_features(prices: DataFrame, key: str = "ticker", day: str = "trade_date", close: str = "close", volume: str = "volume", ahead: int = 0, price: str = "adj_close") -> DataFrame:
    """Returns, their five lags, realised volatility, RSI (simple mean) and volume z-score.

    Each step reads the last one's columns over one (key, day) window, so a single exchange and sort serve all.  With
    ``ahead``, the forward return of ``price`` over so many rows comes from the same window; it is a target, not a feature.
    """
    w = Window.partitionBy(key).orderBy(day)
    w14, w21 = trailing(w, 14), trailing(w, 21)
    r = F.col("ret_1d")
    target = [_forward(w, ahead, price)] if ahead else []
    base = prices.select(key, day, close, volume, (ratio(F.col(close), F.lag(close).over(w)) - 1).alias("ret_1d"), *target)
    moves = base.withColumns({"_gain": F.greatest(r, F.lit(0.0)), "_loss": F.greatest(-r, F.lit(0.0))})
    return moves.select(
        key, day, close, "ret_1d", *(F.lag("ret_1d", k).over(w).alias(f"ret_lag_{k}") for k in range(1, 6)),
        (F.stddev_samp("ret_1d").over(w21) * F.sqrt(F.lit(252.0))).alias("realized_vol_21d"),
        (100 - ratio(F.lit(100.0), 1 + ratio(F.avg("_gain").over(w14), F.avg("_loss").over(w14)))).alias("rsi_14"),
        z_score(F.col(volume), w21).alias("volume_z_21d"), *([f"fwd_ret_{ahead}d"] if ahead else []),
    )


def spend_features(spend: DataFrame, key: str = "ticker", day: str = "spend_date") -> DataFrame:
    """Momentum, z-scores, ticket and account growth, and the surprise against the mean of the last four equal weekdays."""
    w = Window.partitionBy(key).orderBy(day)
    w7, w28 = trailing(w, 7), trailing(w, 28)
    weekday = Window.partitionBy(key, F.dayofweek(day)).orderBy(day).rowsBetween(-4, -1)
    full_week = F.when(F.count(F.lit(1)).over(w7) == 7, F.avg("unique_accounts").over(w7))
    first = spend.withColumns({
        "_ma7": F.avg("gross_spend").over(w7), "_ma28": F.avg("gross_spend").over(w28), "_sd28": F.stddev_samp("gross_spend").over(w28),
        "_txn_z": z_score(F.col("txn_count"), w28), "_t7": F.avg("avg_ticket").over(w7), "_t28": F.avg("avg_ticket").over(w28), "_acct7": full_week,
    })
    second = first.withColumn("_acct7_before", F.lag("_acct7", 7).over(w)).withColumn("_weekday", F.avg("gross_spend").over(weekday))
    return second.select(
        key, day, (ratio(F.col("_ma7"), F.col("_ma28")) - 1).alias("spend_mom_7d"), ratio(F.col("gross_spend") - F.col("_ma28"), F.col("_sd28")).alias("spend_z_28d"),
        F.col("_txn_z").alias("txn_count_z_28d"), (ratio(F.col("_t7"), F.col("_t28")) - 1).alias("avg_ticket_delta_7d"),
        (ratio(F.col("_acct7"), F.col("_acct7_before")) - 1).alias("unique_acct_growth_7d"), ratio(F.col("gross_spend") - F.col("_weekday"), F.col("_sd28")).alias("spend_surprise"),
    )


def forward_return(prices: DataFrame, steps: int = 5, key: str = "ticker", day: str = "trade_date", price: str = "adj_close") -> DataFrame:
    """The target, and the only column that looks ahead: null for the last ``steps`` rows of each key."""
    w = Window.partitionBy(key).orderBy(day)
    return prices.select(key, day, _forward(w, steps, price))


def training_set(features: DataFrame, prices: DataFrame | None, spend: DataFrame) -> DataFrame:
    """Features with their target; days without spend keep null spend features.  ``prices``: None if the features have it."""
    s = spend_features(spend).withColumnRenamed("spend_date", "trade_date")
    rows = features.drop("close", "ret_1d")
    rows = rows if prices is None else rows.join(forward_return(prices), ["ticker", "trade_date"])
    return rows.join(s, ["ticker", "trade_date"], "left")


def daily_spend(transactions: DataFrame, merchants: DataFrame) -> DataFrame:
    """Expenses by ticker and day.  The join keeps rows whose merchant the map knows.

    The map is a dimension of a few rows for each company; Spark broadcasts it below its own size limit and falls back to
    a shuffle beyond it, so there is no hint.
    """
    spent = F.abs("signed_amount")
    return (
        transactions.filter(F.col("category_type") == "EXPENSE").join(merchants.select("merchant_normalized", "ticker"), "merchant_normalized")
        .groupBy("ticker", F.col("txn_date").alias("spend_date"))
        .agg(F.sum(spent).alias("gross_spend"), F.count(F.lit(1)).alias("txn_count"), F.count_distinct("account_id").alias("unique_accounts"), F.avg(spent).alias("avg_ticket"), F.median(spent).alias("median_ticket"))
    )
