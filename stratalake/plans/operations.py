"""One operations run: monitors, arrivals, drift; findings are classified and written down, alerts routed, incidents filed."""

from __future__ import annotations

import json
import statistics
from dataclasses import astuple
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame, functions as F

from .. import config
from ..feed_config import Feed, load_feeds
from ..operators import alerts, arrival, drift, monitors
from ..operators.contracts import load_contract
from ..operators.monitors import MonitorResult
from ..schema import OPS_ALERTS, OPS_FINDINGS, OPS_MONITORS, OPS_RUNS
from ..sources.store import Lakehouse
from .bronze import newest_date

RESULT_COLUMNS = ("monitor", "table_name", "column_name", "kind", "metric", "baseline_median", "status", "detail", "run_at")


def as_frame(lake: Lakehouse, results: list[MonitorResult]) -> DataFrame:
    schema = lake.live_schema(OPS_MONITORS.name)
    rows = [dict(zip(RESULT_COLUMNS, astuple(r))) for r in results]
    return lake.spark.createDataFrame([tuple(r[f.name] for f in schema) for r in rows], schema)


def _written(lake: Lakehouse, table: str) -> bool:
    """A table that was only defined has nothing to check yet."""
    return lake.table_exists(table) and bool(lake.snapshots(table))


def run_monitors(lake: Lakehouse, as_of: date, feeds: tuple[Feed, ...] | None = None) -> list[MonitorResult]:
    """Every declared monitor and every column type; a monitor that fails is a breach, a missing table is skipped."""
    feeds = load_feeds() if feeds is None else feeds
    log = lake.scan(OPS_MONITORS.name) if lake.table_exists(OPS_MONITORS.name) else None
    out = []
    for feed in feeds:
        for m in feed.monitors:
            if not all(_written(lake, t) for t in (m.table, *dict(m.tables).values())):
                continue
            history = monitors.baselines(log, m.name) if log is not None else []
            mid = statistics.median(history) if history else None
            try:
                if m.source == "snapshot_added":
                    metric = monitors.snapshot_added(lake.snapshot_details(m.table))
                else:
                    value = lake.sql(m.query, {"t": m.table, **dict(m.tables)}).select(F.col("metric").cast("double")).first()
                    metric = 0.0 if value is None or value[0] is None else value[0]
                status, detail = monitors.judge(metric, history, m.kind, dict(m.params))
            except Exception as e:  # one broken monitor mustn't hide the others
                metric, status, detail = None, "breach", f"monitor failed: {str(e).splitlines()[0][:300]}"
            out.append(MonitorResult(m.name, m.table, m.column, m.kind, metric, mid, status, detail, as_of))
        for layer in feed.layers:
            if layer.typed and _written(lake, layer.table):
                out += monitors.check_types(lake.live_schema(layer.table), load_contract(layer.contract), as_of)
    return out


def check_arrivals(lake: Lakehouse, as_of: date, feeds: tuple[Feed, ...] | None = None, skip_missing: bool = False) -> list[MonitorResult]:
    out = []
    for feed in load_feeds() if feeds is None else feeds:
        for a in feed.arrivals:
            there = lake.table_exists(a.table)
            if not skip_missing or _written(lake, a.table):
                out += arrival.check_arrival(lake.scan(a.table) if there else None, a.table, a.column, a.calendar, a.max_lag_days, a.min_rows, as_of)
    return out


def record(lake: Lakehouse, results: list[MonitorResult]) -> None:
    lake.append(OPS_MONITORS.name, as_frame(lake, results))


def route_alerts(lake: Lakehouse, results: list[MonitorResult]) -> tuple[int, int]:
    """(delivered, throttled); delivered alerts are logged."""
    fresh, known = alerts.route(alerts.from_results(as_frame(lake, results)), lake.scan(OPS_ALERTS.name))
    throttled = known.count()
    if fresh.limit(1).count() == 0:
        return 0, throttled
    return lake.append(OPS_ALERTS.name, fresh).added, throttled


def sense(lake: Lakehouse, as_of: date, feeds: tuple[Feed, ...]) -> list[drift.Finding]:
    out = []
    for feed in feeds:
        for layer in feed.layers:
            if layer.agent_watch and lake.table_exists(layer.table):
                contract = load_contract(layer.contract)
                counts = lake.snapshot_row_counts(layer.table)
                seen = drift.observe(lake.scan(layer.table), lake.live_schema(layer.table), layer.table, counts, lake.schema_history(layer.table), layer.freshness_column, [w["column"] for w in contract.enum_watch])
                out += drift.detect(seen, contract, as_of, counts[:-1] or counts)
    return out


def persist_findings(lake: Lakehouse, judged: list[tuple[drift.Finding, str, str]], as_of: date, dry_run: bool = True) -> None:
    """The findings, and one row for the run even if there are none."""
    rows = [
        {"run_at": as_of, "finding_key": f.key, "table_name": f.table, "kind": f.kind, "severity": s, "column_name": f.evidence.get("column"), "detail": f.detail, "reasoning": why, "evidence": json.dumps(f.evidence, sort_keys=True, default=str), "actioned": s in drift.ACTIONABLE and not dry_run}
        for f, s, why in judged
    ]
    schema = lake.live_schema(OPS_FINDINGS.name)
    if rows:
        lake.append(OPS_FINDINGS.name, lake.spark.createDataFrame([tuple(r[f.name] for f in schema) for r in rows], schema))
    act = sum(s in drift.ACTIONABLE for _, s, _ in judged)
    lake.append(OPS_RUNS.name, lake.spark.createDataFrame([(as_of, len(judged), act, dry_run)], lake.live_schema(OPS_RUNS.name)))


def write_incident(folder: str | Path, f: drift.Finding, severity: str, reasoning: str, as_of: date) -> Path:
    """A Markdown file for the incident, named by its key; written again for a repeat of the same day."""
    import hashlib

    path = Path(folder) / f"{as_of}-{hashlib.sha256(f.key.encode()).hexdigest()[:8]}.md"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(f"# [{severity}] {f.kind} on {f.table}\n\n{f.detail}\n\n{reasoning}\n\n```json\n{json.dumps(f.evidence, indent=1, sort_keys=True, default=str)}\n```\n")
    return path


def run_agent(lake: Lakehouse, as_of: date | None = None, dry_run: bool = True, incidents: str | Path | None = None, feeds: tuple[Feed, ...] | None = None) -> list[tuple[drift.Finding, str, str]]:
    """Sense, monitor, classify, write down, act."""
    lake.create_all()
    feeds = load_feeds() if feeds is None else feeds
    as_of = as_of or config.resolve_as_of(newest_date(lake))
    findings = sense(lake, as_of, feeds)
    for r in run_monitors(lake, as_of, feeds) + check_arrivals(lake, as_of, feeds, skip_missing=True):
        if r.status == "breach":
            findings.append(drift.Finding("monitor_breach", r.table, f"[{r.monitor}] {r.detail}", {"monitor": r.monitor, "kind": r.kind, "column": r.column, "metric": r.metric, "baseline": r.baseline}))
    judged = [(f, *drift.classify(f)) for f in findings]
    persist_findings(lake, judged, as_of, dry_run)
    if incidents and not dry_run:
        for f, s, why in judged:
            if s in drift.ACTIONABLE:
                write_incident(incidents, f, s, why, as_of)
    return judged
