"""Generators, Bronze, Silver, Gold; an independent pandas recomputation of every feature."""

from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratalake import config
from stratalake.functions.scalars import iso_date, normalize_merchant, short_key
from stratalake.operators.contracts import ContractViolation
from stratalake.plans import bronze, gold, silver
from stratalake.schema import FEATURES
from stratalake.sources import generators
from stratalake.sources.landing import read_json
from stratalake.sources.store import Lakehouse
from stratalake.streaming.ingest import stream_to_bronze

TXN = "bronze.yodlee_transactions_raw"


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    lake = Lakehouse(spark, str(tmp_path_factory.mktemp("wh")))
    bronze.ingest_all(lake, 30_000)
    silver.build_all(lake)
    gold.build_all(lake)
    return lake


def test_merchant_golden_values(spark):
    raw = ["STARBUCKS STORE #1234", "Starbucks", "CHIPOTLE 0455", "Domino's Pizza", "TARGET T-1088", "lululemon athletica", "#12", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in raw], "m string").select(normalize_merchant(F.col("m"))).collect()]
    assert got == ["STARBUCKS STORE", "STARBUCKS", "CHIPOTLE", "DOMINOS PIZZA", "TARGET T", "LULULEMON ATHLETICA", None, None]


def test_iso_dates_only(spark):
    raw = ["2024-01-05", "2024", "2024-1-5", " 2024-01-05 ", "2024-01-05T10:00:00", "2024-13-01", "x", None]
    df = spark.createDataFrame([(x,) for x in raw], "transactionDate string")
    assert [r[0] for r in df.select(iso_date(F.col("transactionDate"))).collect()] == [date(2024, 1, 5)] + [None] * 7
    assert bronze.date_health(df) == (date(2024, 1, 5), 6)


def test_short_key_is_the_plain_hash(spark):
    import hashlib

    got = spark.sql("select 'a' as x, cast(null as string) as y, 'b' as z").select(short_key(F.col("x"), F.col("y"), F.col("z"))).first()[0]
    assert got == hashlib.sha256(b"a||b").hexdigest()[:16]


def test_generators_are_deterministic_and_well_formed(spark):
    a, b = generators.transactions(spark, 2000).toPandas(), generators.transactions(spark, 2000).repartition(7).toPandas().sort_values("id", ignore_index=True)
    assert a.sort_values("id", ignore_index=True).astype(str).equals(b.astype(str))
    assert a["id"].is_unique and len(a) == 2000 and set(a.baseType) == {"CREDIT", "DEBIT"} and min(x["amount"] for x in a.amount) > 0
    noise = a.merchant.map(lambda m: m["source"] in config.NOISE_MERCHANTS).mean()
    assert noise == pytest.approx(config.NOISE_FRACTION, abs=1e-9)


def test_planted_signal_is_at_the_right_lag(spark):
    panel, px = generators.demand_panel(), generators.prices(spark).toPandas()
    for c in config.COMPANIES:
        shock = panel[panel.ticker == c.ticker]["shock"].to_numpy()
        close = px[px.ticker == c.ticker].sort_values("date")["close"].to_numpy()
        ret = np.diff(np.log(close))
        at = lambda k: np.corrcoef(shock[1 : len(shock) - k] if k else shock[1:], ret[k:])[0, 1]
        assert at(c.lag_days) > 0.15 and abs(at(c.lag_days + 4)) < 0.12
    assert ((px.high >= px[["open", "close"]].max(axis=1)) & (px.low <= px[["open", "close"]].min(axis=1))).all() and len(px) == 3756


def test_payload_hash_ignores_column_order(spark):
    raw = spark.sql("select 1 as id, 'x' as b, cast(null as string) as c")
    a, b = bronze.stamp(raw, "f").first(), bronze.stamp(raw.select("c", "b", "id"), "f").first()
    assert a._payload_hash == b._payload_hash and a._raw_payload == '{"b":"x","c":null,"id":1}'


def test_silver_reconciles_and_signs(lake):
    clean = lake.scan("silver.transactions")
    assert clean.count() + lake.scan("silver.transactions_quarantine").count() == lake.scan(TXN).select("id").distinct().count()
    assert clean.filter("base_type = 'DEBIT' and signed_amount >= 0").count() == 0
    assert lake.scan("silver.merchant_ticker_map").count() == 17 and lake.scan("silver.stock_prices").count() == 3756


def test_late_corrections_win_and_foreign_currency_is_set_aside(spark, lake):
    base = lake.scan(TXN).limit(1)
    make = lambda updated, amount, currency: base.withColumn("lastUpdated", F.lit(updated)).withColumn("amount", F.struct(F.lit(amount).alias("amount"), F.lit(currency).cast("string").alias("currency"))).withColumn("baseType", F.lit("DEBIT"))
    clean, rest = silver.transactions(make("2020-01-01T00:00:00+00:00", 111.11, "USD").unionByName(make("2030-01-01T00:00:00+00:00", 222.22, "USD")))
    assert [r.signed_amount for r in clean.collect()] == [-222.22] and rest.count() == 0
    for currency in ("EUR", None):
        clean, rest = silver.transactions(make("2020-01-01T00:00:00+00:00", 1.0, currency))
        assert clean.count() == 0 and [(r.quarantine_reason, r.currency) for r in rest.collect()] == [("non_usd_currency", currency)]


def test_every_feature_against_a_recomputation(lake):
    """Each value from history up to its day only, in plain pandas."""
    spend, px = lake.scan("gold.daily_merchant_spend").toPandas(), lake.scan("silver.stock_prices").toPandas()
    got = lake.scan("gold.forecast_training_set").toPandas().sort_values(["ticker", "trade_date"], ignore_index=True)
    assert len(got) == 3756 and got["fwd_ret_5d"].isna().sum() == 30
    rng = np.random.default_rng(0)
    for i in rng.choice(len(got), 250, replace=False):
        row = got.loc[i]
        p = px[(px.ticker == row.ticker) & (px.trade_date <= row.trade_date)].sort_values("trade_date")
        s = spend[(spend.ticker == row.ticker) & (spend.spend_date <= row.trade_date)].sort_values("spend_date")
        r = p.close.pct_change()
        want = {f"ret_lag_{k}": r.iloc[-1 - k] if len(r) > k else np.nan for k in range(1, 6)}
        want["realized_vol_21d"] = r.tail(21).std() * np.sqrt(252)
        gain, loss = r.clip(lower=0).fillna(0).tail(14).mean(), (-r).clip(lower=0).fillna(0).tail(14).mean()
        want["rsi_14"] = 100 - 100 / (1 + gain / loss) if loss else np.nan
        v = p.volume.astype(float).tail(21)
        want["volume_z_21d"] = (v.iloc[-1] - v.mean()) / v.std() if len(v) > 1 and v.std() else np.nan
        spendless = s.empty or s.spend_date.iloc[-1] != row.trade_date
        if spendless:
            want |= dict.fromkeys(FEATURES[:6], np.nan)
        else:
            g, n, t, a = (s[c].astype(float) for c in ("gross_spend", "txn_count", "avg_ticket", "unique_accounts"))
            z = lambda x: (x.iloc[-1] - x.tail(28).mean()) / x.tail(28).std() if len(x) > 1 and x.tail(28).std() else np.nan
            same = g[[d.weekday() == row.trade_date.weekday() for d in s.spend_date]].iloc[:-1].tail(4)
            a7 = a.rolling(7).mean()
            want |= {
                "spend_mom_7d": g.tail(7).mean() / g.tail(28).mean() - 1, "spend_z_28d": z(g), "txn_count_z_28d": z(n), "avg_ticket_delta_7d": t.tail(7).mean() / t.tail(28).mean() - 1,
                "unique_acct_growth_7d": a7.iloc[-1] / a7.iloc[-8] - 1 if len(a7) > 7 else np.nan, "spend_surprise": (g.iloc[-1] - same.mean()) / g.tail(28).std() if len(same) and len(g) > 1 else np.nan,
            }
        for c in FEATURES:
            assert pd.isna(row[c]) == pd.isna(want[c]), (c, row.ticker, row.trade_date)
            assert pd.isna(row[c]) or row[c] == pytest.approx(want[c], rel=1e-6, abs=1e-9), c


def test_gates_fail_closed(spark, lake):
    before = lake.snapshots("silver.transactions"), lake.snapshots("gold.forecast_training_set")
    bad = lake.scan(TXN).limit(1).withColumn("id", F.lit(1).cast("long")).withColumn("amount", F.struct(F.lit(-5.0).alias("amount"), F.lit("USD").alias("currency"))).withColumn("baseType", F.lit("DEBIT"))
    lake.append(TXN, bad)
    with pytest.raises(ContractViolation, match="conditional_sign"):
        silver.build_all(lake)
    assert (lake.snapshots("silver.transactions"), lake.snapshots("gold.forecast_training_set")) == before


def test_streaming_ingest_appends_each_batch_once(spark, tmp_path):
    lake = Lakehouse(spark, str(tmp_path / "wh"))
    lake.create_all()
    landing, check = str(tmp_path / "in"), str(tmp_path / "cp")
    generators.accounts(spark, n=50).coalesce(2).write.json(landing)
    assert read_json(spark, landing, "accounts").count() == 50
    from stratalake.sources.landing import stream_json

    for _ in range(2):  # the second run finds nothing new
        stream_to_bronze(lake, stream_json(spark, landing, "accounts"), "bronze.yodlee_accounts_raw", check).awaitTermination()
    assert lake.scan("bronze.yodlee_accounts_raw").count() == 50 and len(lake.snapshots("bronze.yodlee_accounts_raw")) == 1
    generators.accounts(spark, n=10).coalesce(1).write.mode("append").json(landing)
    stream_to_bronze(lake, stream_json(spark, landing, "accounts"), "bronze.yodlee_accounts_raw", check).awaitTermination()
    assert lake.scan("bronze.yodlee_accounts_raw").count() == 60
