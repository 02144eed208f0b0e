"""Data contracts: expectations on a table, all evaluated in one aggregation, and a gate that fails closed."""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import date
from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame, functions as F

FOLDER = Path(__file__).resolve().parent.parent / "contracts"


class ContractViolation(RuntimeError):
    """Lists everything that failed."""


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    nullable: bool = True


@dataclass(frozen=True)
class Contract:
    table: str
    version: int
    owner: str
    fields: tuple[Field, ...]
    expectations: tuple[dict, ...] = ()
    enum_watch: tuple[dict, ...] = ()


@dataclass(frozen=True)
class Result:
    expectation: str
    column: str | None
    passed: bool
    detail: str


@dataclass(frozen=True)
class Report:
    table: str
    results: tuple[Result, ...]

    @property
    def passed(self) -> bool:
        return all(r.passed for r in self.results)

    @property
    def failures(self) -> list[Result]:
        return [r for r in self.results if not r.passed]


def load_contract(path: str | Path) -> Contract:
    path = Path(path)
    d = yaml.safe_load((path if path.exists() else FOLDER / path).read_text())
    return Contract(d["table"], d["version"], d["owner"], tuple(Field(**f) for f in d["schema"]), tuple(d.get("expectations") or ()), tuple(d.get("enum_watch") or ()))


def _metrics(i: int, e: dict) -> dict[str, Column]:
    """The aggregates that expectation ``i`` needs; an unknown kind raises."""
    kind, c = e["type"], F.col(f"`{e['column']}`") if "column" in e else None
    if kind == "row_count":
        return {}
    if kind == "not_null":
        return {f"m{i}": F.count_if(c.isNull())}
    if kind == "unique":
        return {f"m{i}": F.count(c) - F.count_distinct(c)}
    if kind == "accepted_values":
        # the part outside the list is small if the check passes and bounded if it doesn't
        return {f"m{i}": F.count_if(c.isNotNull() & ~c.isin(list(e["values"]))), f"m{i}_some": F.min(F.when(~c.isin(list(e["values"])), c.cast("string")))}
    if kind == "range":
        x = c.cast("double")
        real = F.when(~F.isnan(x), x)
        return {f"m{i}_lo": F.min(real), f"m{i}_hi": F.max(real), f"m{i}_nan": F.count_if(F.isnan(x))}
    if kind == "conditional_sign":
        wrong = c > 0 if e["sign"] == "negative" else c < 0
        return {f"m{i}": F.count_if((F.col(f"`{e['when_column']}`") == e["when_value"]) & wrong)}
    if kind == "freshness":
        return {f"m{i}": F.max(F.try_to_date(F.substring(c.cast("string"), 1, 10), "yyyy-MM-dd"))}
    raise ValueError(f"unknown expectation {kind!r}")


def validate(df: DataFrame, contract: Contract, as_of: date) -> Report:
    """Check a frame; missing columns fail, unknown kinds raise."""
    results = [Result("schema_present", f.name, f.name in df.columns, "present" if f.name in df.columns else "declared but absent") for f in contract.fields]
    implied = [{"type": "not_null", "column": f.name} for f in contract.fields if not f.nullable and f.name in df.columns]
    checks = implied + list(contract.expectations)
    exprs: dict[str, Column] = {"n": F.count(F.lit(1))}
    absent = lambda e: [c for c in (e.get("column"), e.get("when_column")) if c and c not in df.columns]
    for i, e in enumerate(checks):
        if not absent(e):
            exprs |= _metrics(i, e)
        elif e["type"] not in ("not_null", "unique", "accepted_values", "range", "conditional_sign", "freshness"):
            raise ValueError(f"unknown expectation {e['type']!r}")
    m = df.agg(*(c.alias(k) for k, c in exprs.items())).first().asDict()
    for i, e in enumerate(checks):
        kind, column = e["type"], e.get("column")
        if absent(e):
            results.append(Result(kind, column, False, f"column {absent(e)[0]} is missing"))
            continue
        if kind == "row_count":
            ok, detail = m["n"] >= e.get("min", 0), f"{m['n']} rows, at least {e.get('min', 0)} expected"
        elif kind == "range":
            lo, hi = e.get("min", -math.inf), e.get("max", math.inf)
            low, high = m[f"m{i}_lo"], m[f"m{i}_hi"]
            ok = low is not None and low >= lo and high <= hi and not m[f"m{i}_nan"]
            detail = "no values" if low is None else f"[{low}, {high}] against [{lo}, {hi}], {m[f'm{i}_nan']} NaN"
        elif kind == "freshness":
            newest = m[f"m{i}"]
            lag = (as_of - newest).days if newest else None
            ok, detail = lag is not None and lag <= e["max_lag_days"], f"newest {newest}, limit {e['max_lag_days']} days before {as_of}"
        else:
            ok, detail = m[f"m{i}"] == 0, f"{m[f'm{i}']} row(s) violate it" + (f", e.g. {m[f'm{i}_some']!r}" if m.get(f"m{i}_some") else "")
        results.append(Result(kind, column, bool(ok), detail))
    return Report(contract.table, tuple(results))


def assert_valid(df: DataFrame, contract: Contract, as_of: date) -> Report:
    """Raise, before anything is written, with all failures at once."""
    report = validate(df, contract, as_of)
    if not report.passed:
        raise ContractViolation(f"{contract.table}: " + "; ".join(f"{r.expectation}({r.column}): {r.detail}" for r in report.failures))
    return report
