"""python -m stratalake.cli COMMAND: the pipeline and the operations runs, one command each."""

from __future__ import annotations

import argparse
import os
import sys
from datetime import date
from pathlib import Path

from . import config, schema
from .session import get_spark
from .sources import store

COMMANDS = ("all", "bronze", "silver", "gold", "forecast", "agent", "monitor", "arrival", "report", "timetravel", "drift-demo", "schema-history", "cross-version", "maintenance")


def run(command: str, lake: store.Lakehouse, as_of: date | None = None, out: str | None = None, retain: int = 5, execute: bool = False) -> int:
    """Run one command; the exit code is 1 if a check breached."""
    from .plans import bronze, forecast, gold, operations, report, silver

    bronze_txn = schema.BRONZE_TRANSACTIONS.name
    lake.create_all()
    if command == "all":
        return max(run(c, lake, as_of, out) for c in ("bronze", "silver", "gold", "forecast"))
    if command == "bronze":
        print(bronze.ingest_all(lake))
    elif command == "silver":
        print(silver.build_all(lake))
    elif command == "gold":
        print(gold.build_all(lake))
    elif command == "forecast":
        training = lake.scan(schema.GOLD_TRAINING.name)
        lake.overwrite(schema.GOLD_PREDICTIONS.name, forecast.predict(training))
        text = forecast.report(lake.spark, lake.scan(schema.GOLD_PREDICTIONS.name), training)
        Path(out).write_text(text) if out else print(text)
    elif command in ("agent", "monitor", "arrival", "report"):
        as_of = as_of or config.resolve_as_of(bronze.newest_date(lake))
        if command == "report":
            text = report.render(report.load_day(lake, as_of))
            Path(out).write_text(text) if out else print(text)
            return 0
        if command == "agent":
            for f, severity, _ in operations.run_agent(lake, as_of, not execute, out):
                print(f"[{severity}] {f.table}: {f.detail}")
            return 0
        results = operations.run_monitors(lake, as_of) if command == "monitor" else operations.check_arrivals(lake, as_of)
        if command == "monitor":
            operations.record(lake, results)
            print("delivered, throttled:", operations.route_alerts(lake, results))
        for r in results:
            print(f"[{r.status}] {r.monitor}: {r.detail}")
        return int(any(r.status == "breach" for r in results))
    elif command == "timetravel":
        while len(lake.snapshots(bronze_txn)) < 2:
            bronze.ingest_all(lake, 500)
        print(store.time_travel(lake, bronze_txn))
    elif command == "drift-demo":
        print(list(store.evolve(lake)), store.inject_collapse(lake))
    elif command == "schema-history":
        for h in lake.schema_history(bronze_txn):
            print(h["schema_id"], h["columns"])
    elif command == "cross-version":
        lake.cross_version(bronze_txn).groupBy("_snapshot_id", "_schema_id").count().orderBy("_snapshot_id").show()
    elif command == "maintenance":
        print("expired:", lake.expire_snapshots(retain))
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("--warehouse", default=os.environ.get("WAREHOUSE_PATH", "warehouse"))
    p.add_argument("--as-of", type=date.fromisoformat)
    p.add_argument("--out")
    p.add_argument("--retain", type=int, default=5)
    p.add_argument("--execute", action="store_true", help="write incident files; without it the agent only records")
    a = p.parse_args(argv)
    return run(a.command, store.Lakehouse(get_spark(), os.path.abspath(a.warehouse)), a.as_of, a.out, a.retain, a.execute)


if __name__ == "__main__":
    sys.exit(main())
