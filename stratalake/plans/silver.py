"""Conformed tables: latest records, signed amounts, normalised merchants; foreign currency is set aside, not lost."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import config
from ..functions.scalars import normalize_merchant, signed_amount
from ..operators.contracts import assert_valid, load_contract
from ..operators.latest import latest, split
from ..schema import BRONZE_ACCOUNTS, BRONZE_PRICES, BRONZE_TRANSACTIONS, SILVER_ACCOUNTS, SILVER_MAP, SILVER_PRICES, SILVER_QUARANTINE, SILVER_TRANSACTIONS
from ..sources.store import Lakehouse
from .bronze import newest_date

QUARANTINED_AT = datetime(2026, 7, 1, tzinfo=timezone.utc)
REASON = "non_usd_currency"


def conformed(raw: DataFrame) -> DataFrame:
    """The latest record of each id.  lastUpdated is compared as text, as delivered; exact ties go by payload hash."""
    order = [F.col("lastUpdated").desc_nulls_last(), F.col("_ingested_at").desc_nulls_last(), F.col("_payload_hash").desc_nulls_last()]
    return latest(raw, ["id"], order).select(
        "id", F.col("accountId").alias("account_id"), F.col("transactionDate").cast("date").alias("txn_date"), F.col("postDate").cast("date").alias("post_date"),
        signed_amount(F.col("amount.amount"), F.col("baseType")).alias("signed_amount"), F.col("amount.currency").alias("currency"), F.col("baseType").alias("base_type"), F.col("subType").alias("sub_type"),
        "category", F.col("categoryType").alias("category_type"), F.col("merchant.source").alias("merchant_raw"), normalize_merchant(F.col("merchant.source")).alias("merchant_normalized"),
        F.col("lastUpdated").cast("timestamp").alias("last_updated"), "_ingested_at",
    )


def transactions(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean, quarantined): together every id once; a null currency is quarantined."""
    clean, rest = split(conformed(raw), F.col("currency").eqNullSafe("USD"))
    return clean, rest.withColumns({"quarantine_reason": F.lit(REASON), "quarantined_at": F.lit(QUARANTINED_AT).cast("timestamp")})


def accounts(raw: DataFrame) -> DataFrame:
    order = [F.col("lastUpdated").desc_nulls_last(), F.col("_payload_hash").desc_nulls_last()]
    return latest(raw, ["id"], order).select(
        "id", F.col("providerName").alias("provider_name"), F.col("accountType").alias("account_type"), F.col("accountStatus").alias("account_status"), F.col("balance.amount").alias("balance_amount"),
        F.col("balance.currency").alias("currency"), F.col("lastUpdated").cast("timestamp").alias("last_updated"),
    )


def prices(raw: DataFrame) -> DataFrame:
    order = [F.col("_ingested_at").desc_nulls_last(), F.col("_payload_hash").desc_nulls_last()]
    return latest(raw, ["ticker", "date"], order).select("ticker", F.col("date").cast("date").alias("trade_date"), "open", "high", "low", "close", "adj_close", "volume")


def merchant_map(spark: SparkSession) -> DataFrame:
    rows = [(m, c.ticker, c.name) for c in config.COMPANIES for m in c.merchants]
    df = spark.createDataFrame(rows, "raw string, ticker string, company_name string")
    return df.select(normalize_merchant(F.col("raw")).alias("merchant_normalized"), "ticker", "company_name", F.lit("exact").alias("match_type")).dropDuplicates(["merchant_normalized", "ticker"])


def build_all(lake: Lakehouse) -> dict[str, int]:
    """All Silver tables; the gate on clean transactions raises before anything is written."""
    as_of = config.resolve_as_of(newest_date(lake))
    whole = conformed(lake.scan(BRONZE_TRANSACTIONS.name)).persist()
    try:
        clean, rest = split(whole, F.col("currency").eqNullSafe("USD"))
        rest = rest.withColumns({"quarantine_reason": F.lit(REASON), "quarantined_at": F.lit(QUARANTINED_AT).cast("timestamp")})
        assert_valid(clean, load_contract("silver_transactions.yaml"), as_of)
        out = {SILVER_TRANSACTIONS.name: lake.overwrite(SILVER_TRANSACTIONS.name, clean).total, SILVER_QUARANTINE.name: lake.overwrite(SILVER_QUARANTINE.name, rest).total}
    finally:
        whole.unpersist()
    for table, df in (
        (SILVER_ACCOUNTS, accounts(lake.scan(BRONZE_ACCOUNTS.name))), (SILVER_MAP, merchant_map(lake.spark)), (SILVER_PRICES, prices(lake.scan(BRONZE_PRICES.name))),
    ):
        out[table.name] = lake.overwrite(table.name, df).total
    return out
