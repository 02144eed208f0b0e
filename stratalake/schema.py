"""The sixteen tables: Spark schemas with field ids, partition columns, layers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

FIELD_ID = "parquet.field.id"
NAMESPACES = ("bronze", "silver", "gold", "ops")


@dataclass(frozen=True)
class Partition:
    """A derived partition column: ``day``, ``month`` or ``identity`` of a source column."""

    source: str
    transform: str

    @property
    def name(self) -> str:
        return {"day": f"{self.source}_day", "month": f"{self.source}_month", "identity": f"{self.source}_part"}[self.transform]


@dataclass(frozen=True)
class TableDef:
    name: str
    schema: T.StructType
    partition: Partition | None = None

    @property
    def required(self) -> list[str]:
        return [f.name for f in self.schema if not f.nullable]


def with_ids(schema: T.StructType, start: int = 1) -> tuple[T.StructType, int]:
    """Number the fields: all of a level first, then those nested in it.  Returns the schema and the next free id."""
    ids = {f.name: start + i for i, f in enumerate(schema)}
    after, fields = start + len(schema.fields), []
    for f in schema:
        kind = f.dataType
        if isinstance(kind, T.StructType):
            kind, after = with_ids(kind, after)
        fields.append(T.StructField(f.name, kind, f.nullable, {**f.metadata, FIELD_ID: ids[f.name]}))
    return T.StructType(fields), after


def field_ids(schema: T.StructType) -> dict[str, int]:
    return {f.name: f.metadata[FIELD_ID] for f in schema}


_PLAIN = {"bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampType()}


def parse(text: str) -> T.StructType:
    """Columns as ``name type, ...`` with nested ``struct<name: type, ...>``; needs no Spark session."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(text + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(text[start:i].strip())
            start = i + 1
    fields = []
    for part in parts:
        name, kind = part.replace(": ", " ", 1).split(" ", 1) if ":" in part.split("<")[0] else part.split(" ", 1)
        kind = kind.strip()
        fields.append(T.StructField(name, parse(kind[7:-1]) if kind.startswith("struct<") else _PLAIN[kind]))
    return T.StructType(fields)


def _define(name: str, ddl: str, required: str, partition: Partition | None = None) -> TableDef:
    need = set(required.split())
    plain = parse(ddl)
    fields = [T.StructField(f.name, f.dataType, f.name not in need) for f in plain]
    return TableDef(name, with_ids(T.StructType(fields))[0], partition)


_MONEY = "struct<amount: double, currency: string>"
_LINEAGE = "_ingested_at timestamp, _source_file string, _payload_hash string, _raw_payload string"
_SILVER_TXN = (
    "id bigint, account_id bigint, txn_date date, post_date date, signed_amount double, currency string, base_type string, sub_type string, category string, "
    "category_type string, merchant_raw string, merchant_normalized string, last_updated timestamp, _ingested_at timestamp"
)
RAW_TRANSACTION = (
    f"id bigint, accountId bigint, date string, transactionDate string, postDate string, amount {_MONEY}, runningBalance {_MONEY}, "
    "merchant struct<id: string, source: string, categoryLabel: string, address: struct<city: string, state: string, country: string>>, status string, baseType string, subType string, "
    "category string, categoryType string, categoryId bigint, detailCategoryId bigint, detailCategory string, highLevelCategoryId bigint, categorySource string, sourceType string, "
    "checkNumber string, isManual boolean, container string, createdDate string, lastUpdated string"
)
RAW_ACCOUNT = (
    "id bigint, providerName string, providerId string, accountType string, accountStatus string, userClassification string, isAsset boolean, isManual boolean, aggregationSource string, "
    f"balance {_MONEY}, currentBalance {_MONEY}, availableBalance {_MONEY}, createdDate string, lastUpdated string"
)
RAW_PRICE = "ticker string, date string, open double, high double, low double, close double, adj_close double, volume bigint"

BRONZE_TRANSACTIONS = _define("bronze.yodlee_transactions_raw", f"{RAW_TRANSACTION}, {_LINEAGE}", "id _ingested_at", Partition("_ingested_at", "day"))
BRONZE_ACCOUNTS = _define("bronze.yodlee_accounts_raw", f"{RAW_ACCOUNT}, {_LINEAGE}", "id _ingested_at", Partition("_ingested_at", "day"))
BRONZE_PRICES = _define("bronze.stock_prices_raw", f"{RAW_PRICE}, {_LINEAGE}", "ticker _ingested_at", Partition("_ingested_at", "day"))
SILVER_TRANSACTIONS = _define("silver.transactions", _SILVER_TXN, "id txn_date signed_amount", Partition("txn_date", "month"))
SILVER_QUARANTINE = _define("silver.transactions_quarantine", f"{_SILVER_TXN}, quarantine_reason string, quarantined_at timestamp", "id quarantine_reason quarantined_at")
SILVER_ACCOUNTS = _define("silver.accounts", "id bigint, provider_name string, account_type string, account_status string, balance_amount double, currency string, last_updated timestamp", "id")
SILVER_MAP = _define("silver.merchant_ticker_map", "merchant_normalized string, ticker string, company_name string, match_type string", "merchant_normalized ticker")
SILVER_PRICES = _define("silver.stock_prices", "ticker string, trade_date date, open double, high double, low double, close double, adj_close double, volume bigint", "ticker trade_date", Partition("trade_date", "month"))
GOLD_SPEND = _define("gold.daily_merchant_spend", "ticker string, spend_date date, gross_spend double, txn_count bigint, unique_accounts bigint, avg_ticket double, median_ticket double", "ticker spend_date", Partition("ticker", "identity"))
_RETURNS = "ret_lag_1 double, ret_lag_2 double, ret_lag_3 double, ret_lag_4 double, ret_lag_5 double, realized_vol_21d double, rsi_14 double, volume_z_21d double"
GOLD_FEATURES = _define("gold.stock_features", f"ticker string, trade_date date, close double, ret_1d double, {_RETURNS}", "ticker trade_date", Partition("ticker", "identity"))
GOLD_TRAINING = _define(
    "gold.forecast_training_set",
    f"ticker string, trade_date date, spend_mom_7d double, spend_z_28d double, txn_count_z_28d double, avg_ticket_delta_7d double, unique_acct_growth_7d double, spend_surprise double, {_RETURNS}, fwd_ret_5d double",
    "ticker trade_date", Partition("ticker", "identity"),
)
GOLD_PREDICTIONS = _define("gold.forecast_predictions", "ticker string, trade_date date, fold bigint, y_true double, y_pred_model double, y_pred_persistence double, y_pred_arima double, model_version string", "ticker trade_date", Partition("ticker", "identity"))
OPS_MONITORS = _define("ops.monitor_results", "run_at date, monitor string, table_name string, column_name string, kind string, metric double, baseline_median double, status string, detail string", "run_at monitor table_name status", Partition("run_at", "month"))
OPS_ALERTS = _define("ops.alert_log", "run_at date, alert_key string, severity string, title string, body string, source string, delivered boolean", "run_at alert_key severity", Partition("run_at", "month"))
OPS_FINDINGS = _define("ops.finding_log", "run_at date, finding_key string, table_name string, kind string, severity string, column_name string, detail string, reasoning string, evidence string, actioned boolean", "run_at finding_key table_name kind severity", Partition("run_at", "month"))
OPS_RUNS = _define("ops.agent_runs", "run_at date, findings_count bigint, actioned_count bigint, dry_run boolean", "run_at findings_count actioned_count", Partition("run_at", "month"))

ALL_TABLES = (
    BRONZE_TRANSACTIONS, BRONZE_ACCOUNTS, BRONZE_PRICES, SILVER_TRANSACTIONS, SILVER_QUARANTINE, SILVER_ACCOUNTS, SILVER_MAP, SILVER_PRICES,
    GOLD_SPEND, GOLD_FEATURES, GOLD_TRAINING, GOLD_PREDICTIONS, OPS_MONITORS, OPS_ALERTS, OPS_FINDINGS, OPS_RUNS,
)
BY_NAME = {t.name: t for t in ALL_TABLES}
SPEND_FEATURES = ("spend_mom_7d", "spend_z_28d", "txn_count_z_28d", "avg_ticket_delta_7d", "unique_acct_growth_7d", "spend_surprise")
PRICE_FEATURES = ("ret_lag_1", "ret_lag_2", "ret_lag_3", "ret_lag_4", "ret_lag_5", "realized_vol_21d", "rsi_14", "volume_z_21d")
FEATURES = SPEND_FEATURES + PRICE_FEATURES
