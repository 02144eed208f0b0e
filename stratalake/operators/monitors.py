"""Monitors: a metric, its history, and a verdict."""

from __future__ import annotations

import math
import statistics
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, functions as F, types as T

KINDS = ("row_count", "cardinality", "null_rate", "distribution_shift", "duplicate_rate")
HISTORY = 14
MAD_SCALE = 1.4826  # makes the median absolute deviation comparable to a standard deviation


@dataclass(frozen=True)
class MonitorResult:
    monitor: str
    table: str
    column: str | None
    kind: str
    metric: float | None
    baseline: float | None
    status: str
    detail: str
    run_at: date


def judge(metric: float, history: Sequence[float], kind: str, params: dict | None = None) -> tuple[str, str]:
    """(ok, warn or breach; why).  Order: unknown kind, absolute limit, no history, the kind's own rule."""
    p = dict(params or {})
    if kind not in KINDS:
        raise ValueError(f"unknown monitor kind {kind!r}; expected one of {', '.join(KINDS)}")
    limit = p.get("max_absolute")
    if limit is not None and metric > limit:
        return "breach", f"{metric:g} is over the fixed limit of {limit:g}"
    if not history:
        return "ok", "nothing to compare with yet"
    mid = statistics.median(history)
    if kind in ("row_count", "cardinality"):
        if mid <= 0:
            return "ok", "the usual value is zero"
        share = metric / mid
        status = "breach" if share < p.get("breach_ratio", 0.5) else "warn" if share < p.get("warn_ratio", 0.8) else "ok"
        return status, f"{metric:g}, {share:.0%} of the usual {mid:g}"
    if kind == "duplicate_rate":
        return ("ok" if metric == 0 else "breach"), f"{metric:g} row(s) repeat a key"
    away = [abs(x - mid) for x in history]
    spread = statistics.median(away) or statistics.mean(away)
    if spread == 0:
        same = math.isclose(metric, mid, rel_tol=1e-9, abs_tol=1e-9)
        return ("ok" if same else "breach"), f"{metric:g}, {'as' if same else 'but'} always {mid:g} before"
    z = abs(metric - mid) / (MAD_SCALE * spread)
    status = "breach" if z > p.get("breach_z", 4.0) else "warn" if z > p.get("warn_z", 3.0) else "ok"
    return status, f"{metric:g}, {z:.1f} robust deviations from the usual {mid:g}"


def snapshot_added(details: Iterable[dict]) -> float:
    """Rows of the last batch that wasn't a rebuild; 0 if there is none."""
    batches = [d["added_records"] for d in details if not d["is_full_rebuild"]]
    return float(batches[-1]) if batches else 0.0


def baselines(results: DataFrame, monitor: str, before: date | None = None) -> list[float]:
    """The last metrics of a monitor, oldest first; a top-k, so only HISTORY rows reach the driver."""
    own = results.filter((F.col("monitor") == monitor) & F.col("metric").isNotNull())
    own = own.filter(F.col("run_at") < F.lit(before)) if before else own
    return [r["metric"] for r in own.orderBy(F.col("run_at").desc()).limit(HISTORY).select("metric").collect()][::-1]


# The names of contract types and the Spark types that are them.
TYPE_NAMES = {"long": "bigint", "int": "int", "string": "string", "double": "double", "float": "float", "boolean": "boolean", "date": "date", "timestamptz": "timestamp", "struct": "struct"}


def type_matches(declared: str, observed: str) -> bool:
    return observed.startswith(TYPE_NAMES.get(declared, declared)) or observed.startswith(declared)


def check_types(schema: T.StructType, contract, run_at: date) -> list[MonitorResult]:
    """One result for each field of a contract, from metadata alone."""
    out = []
    for f in contract.fields:
        seen = schema[f.name].dataType.simpleString() if f.name in schema.names else None
        ok = seen is not None and type_matches(f.type, seen)
        detail = f"declared {f.type}, observed {seen or 'no such column'}"
        out.append(MonitorResult(f"{contract.table}_{f.name}_type", contract.table, f.name, "column_type", None, None, "ok" if ok else "breach", detail, run_at))
    return out
