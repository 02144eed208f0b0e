"""Raw records with lineage, appended as they are."""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import iso_date, payload_hash, payload_json
from ..schema import BRONZE_ACCOUNTS, BRONZE_PRICES, BRONZE_TRANSACTIONS
from ..sources import generators
from ..sources.store import Lakehouse

INGESTED_AT = datetime(2026, 7, 1, tzinfo=timezone.utc)  # pinned, so that reruns make equal rows
LINEAGE = ("_ingested_at", "_source_file", "_payload_hash", "_raw_payload")


def stamp(raw: DataFrame, source: str | None = None, at: datetime = INGESTED_AT) -> DataFrame:
    """Add lineage.  The payload is the record without lineage columns; its hash doesn't depend on column order."""
    body = [c for c in raw.columns if c not in LINEAGE]
    origin = F.lit(source) if source is not None else F.col("_source_file") if "_source_file" in raw.columns else F.lit(None).cast("string")
    return raw.select(*body, F.lit(at).cast("timestamp").alias("_ingested_at"), origin.alias("_source_file"), payload_hash(body).alias("_payload_hash"), payload_json(body).alias("_raw_payload"))


def land(lake: Lakehouse, table: str, stamped: DataFrame, batch: tuple[str, int] | None = None) -> int:
    """Append under the live schema: columns that the table gained later are null.  Returns the rows added.

    ``batch``: stream and number of a micro-batch; one that was appended before adds nothing.
    """
    live = lake.live_schema(table)
    have = set(stamped.columns)
    rows = stamped.select([F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in live])
    done = lake.append_batch(table, rows, *batch) if batch else lake.append(table, rows)
    return done.added if done else 0


def renamed_source(lake: Lakehouse, table: str, stamped: DataFrame) -> DataFrame:
    """Records under the names of the first schema, brought to the names of the live one by field id."""
    first, live = lake.schema_history(table)[0]["field_ids"], lake.schema_history(table)[-1]["field_ids"]
    now = {i: n for n, i in live.items()}
    return stamped.withColumnsRenamed({n: now[i] for n, i in first.items() if i in now and now[i] != n})


def ingest_all(lake: Lakehouse, n: int | None = None) -> dict[str, int]:
    """Generate and append all three feeds.  Running it again appends again: Bronze keeps every delivery."""
    spark = lake.spark
    feeds = {
        BRONZE_TRANSACTIONS.name: (generators.transactions(spark, n), "transactions"), BRONZE_ACCOUNTS.name: (generators.accounts(spark), "accounts"), BRONZE_PRICES.name: (generators.prices(spark), "prices"),
    }
    out = {}
    for table, (raw, source) in feeds.items():
        if not lake.table_exists(table):
            lake.create_all()
        out[table] = land(lake, table, renamed_source(lake, table, stamp(raw, f"generated/{source}.json")))
    return out


def date_health(df: DataFrame, column: str = "transactionDate") -> tuple[date | None, int]:
    """(newest date that parses, values that don't): one aggregation over one column."""
    d = iso_date(F.col(column))
    r = df.agg(F.max(d).alias("newest"), F.count_if(F.col(column).isNotNull() & d.isNull()).alias("bad")).first()
    return r["newest"], r["bad"]


def newest_date(lake: Lakehouse) -> date | None:
    name = BRONZE_TRANSACTIONS.name
    return date_health(lake.scan(name))[0] if lake.table_exists(name) else None
