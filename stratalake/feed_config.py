"""Feed definitions from YAML, validated when they are loaded."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

import yaml

from .config import COMPANIES
from .functions.calendar import CALENDARS
from .operators.contracts import FOLDER as CONTRACTS
from .operators.monitors import KINDS
from .schema import BY_NAME

FOLDER = Path(__file__).resolve().parent / "feeds"
MODES, TYPES, SEVERITIES, FLOORS = ("batch", "stream"), ("fact", "dimension"), ("breaking", "additive"), {"companies": len(COMPANIES)}


class FeedError(ValueError):
    """A feed file says something that can't hold."""


@dataclass(frozen=True)
class Layer:
    name: str
    table: str
    contract: str | None = None
    freshness_column: str | None = None
    agent_watch: bool = False
    typed: bool = False


@dataclass(frozen=True)
class Arrival:
    table: str
    column: str
    calendar: str
    max_lag_days: int
    min_rows: int | None = None


@dataclass(frozen=True)
class Monitor:
    name: str
    table: str
    kind: str
    severity: str
    column: str | None = None
    query: str | None = None
    source: str = "sql"
    tables: tuple[tuple[str, str], ...] = ()
    params: tuple[tuple[str, float], ...] = ()


@dataclass(frozen=True)
class Feed:
    name: str
    domain: str
    feed_type: str
    owner: str
    mode: str
    layers: tuple[Layer, ...]
    monitors: tuple[Monitor, ...]
    arrivals: tuple[Arrival, ...]


def _one_of(where: str, what: str, value, allowed) -> None:
    if value not in allowed:
        raise FeedError(f"{where}: {what} {value!r} is not one of {', '.join(sorted(map(str, allowed)))}")


def parse_feed(d: dict, where: str = "feed", contracts: Path = CONTRACTS) -> Feed:
    for key in ("name", "domain", "feed_type", "owner", "ingest", "layers"):
        if not d.get(key):
            raise FeedError(f"{where}: {key} is missing")
    where = d["name"]
    _one_of(where, "feed_type", d["feed_type"], TYPES)
    _one_of(where, "ingest mode", d["ingest"].get("mode"), MODES)
    layers = {}
    for name, x in d["layers"].items():
        _one_of(where, "layer", name, ("bronze", "silver", "gold"))
        _one_of(where, "table", x.get("table"), BY_NAME)
        if x.get("contract") and not (contracts / x["contract"]).exists():
            raise FeedError(f"{where}: contract {x['contract']} does not exist")
        if x.get("typed") and not x.get("contract"):
            raise FeedError(f"{where}: typed layer {name} needs a contract")
        if x.get("agent_watch") and not (x.get("contract") and x.get("freshness_column")):
            raise FeedError(f"{where}: watched layer {name} needs a contract and a freshness_column")
        layers[name] = Layer(name, **x)
    monitors = []
    for m in d.get("monitors") or []:
        at = f"{where}, monitor {m.get('name')}"
        if not str(m.get("name") or "").replace("_", "").isalnum():
            raise FeedError(f"{at}: a name of letters, digits and underscores is needed")
        _one_of(at, "layer", m.get("layer"), layers)
        _one_of(at, "kind", m.get("kind"), KINDS)
        _one_of(at, "severity", m.get("severity"), SEVERITIES)
        _one_of(at, "source", m.get("source", "sql"), ("sql", "snapshot_added"))
        if m.get("source", "sql") == "sql" and not m.get("query"):
            raise FeedError(f"{at}: query is missing")
        for t in (m.get("tables") or {}).values():
            _one_of(at, "table", t, BY_NAME)
        monitors.append(Monitor(m["name"], layers[m["layer"]].table, m["kind"], m["severity"], m.get("column"), m.get("query"), m.get("source", "sql"), tuple((m.get("tables") or {}).items()), tuple((m.get("params") or {}).items())))
    arrivals = []
    for a in d.get("arrival") or []:
        _one_of(where, "arrival layer", a.get("layer"), layers)
        _one_of(where, "calendar", a.get("calendar"), CALENDARS)
        floor = a.get("min_rows_per_period")
        if isinstance(floor, str):
            _one_of(where, "floor", floor, FLOORS)
            floor = FLOORS[floor]
        if not isinstance(a.get("max_lag_periods"), int):
            raise FeedError(f"{where}: max_lag_periods must be a whole number")
        arrivals.append(Arrival(layers[a["layer"]].table, a["column"], a["calendar"], a["max_lag_periods"], floor))
    return Feed(d["name"], d["domain"], d["feed_type"], d["owner"], d["ingest"]["mode"], tuple(layers.values()), tuple(monitors), tuple(arrivals))


def load_feeds(folder: Path = FOLDER, contracts: Path = CONTRACTS) -> tuple[Feed, ...]:
    feeds = [parse_feed(yaml.safe_load(p.read_text()) or {}, p.name, contracts) for p in sorted(Path(folder).glob("*.yaml"))]
    if not feeds:
        raise FeedError(f"no feeds in {folder}")
    for what, names in (
        ("feed", [f.name for f in feeds]), ("monitor", [m.name for f in feeds for m in f.monitors]),
        ("typed table", [x.table for f in feeds for x in f.layers if x.typed]), ("watched table", [x.table for f in feeds for x in f.layers if x.agent_watch]),
    ):
        twice = {n for n in names if names.count(n) > 1}
        if twice:
            raise FeedError(f"{what} declared more than once: {', '.join(sorted(twice))}")
    return tuple(feeds)
