from datetime import date, timedelta

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from stratalake import config
from stratalake.feed_config import FeedError, load_feeds, parse_feed
from stratalake.functions.calendar import expected_periods, trading_days
from stratalake.operators import alerts, arrival, contracts, drift, monitors
from stratalake.plans import bronze, operations, report
from stratalake.sources.store import Lakehouse, evolve, inject_collapse

AS_OF = date(2026, 6, 30)


def test_verdicts():
    j = lambda m, h, kind="row_count", **p: monitors.judge(m, h, kind, p)[0]
    around = [1000, 990, 1010, 1005, 995]
    assert j(10, around) == "breach" and j(995, around) == "ok" and j(700, around) == "warn" and j(10, []) == "ok" and j(1e9, around) == "ok"
    history = [100] * 10 + [101, 99]
    assert j(500, history, "distribution_shift") == "breach" and j(100.5, history, "distribution_shift") == "ok" and j(5, [5] * 5, "null_rate") == "ok"
    assert j(171.4137026799999, [171.41370268000063] * 3, "distribution_shift") == "ok"
    assert j(1, [], "duplicate_rate") == "ok" and j(1, [], "duplicate_rate", max_absolute=0) == "breach" and j(1, [0], "duplicate_rate") == "breach"
    with pytest.raises(ValueError, match="typo"):
        j(1, [], "typo")


@settings(max_examples=100, deadline=None)
@given(st.floats(0, 1e6), st.lists(st.floats(0, 1e6), max_size=14), st.sampled_from(monitors.KINDS))
def test_verdicts_never_raise(metric, history, kind):
    assert monitors.judge(metric, history, kind)[0] in ("ok", "warn", "breach")


def test_collapse_is_seen_by_batch_not_by_total():
    details = [{"added_records": n, "is_full_rebuild": False} for n in [1000] * 5 + [1]]
    assert monitors.snapshot_added(details) == 1 and monitors.judge(1, [1000] * 5, "row_count")[0] == "breach"
    assert monitors.snapshot_added([{"added_records": 9, "is_full_rebuild": True}]) == 0


def test_calendar(spark):
    for closed in ("2026-06-06", "2026-05-25", "2026-07-03"):
        assert date.fromisoformat(closed) not in trading_days(date(2026, 5, 1), date(2026, 7, 31))
    got = sorted(r.period for r in expected_periods(spark, "trading", date(2026, 5, 1), date(2026, 7, 31)).collect())
    assert got == trading_days(date(2026, 5, 1), date(2026, 7, 31)) and len(trading_days(config.START_DATE, config.END_DATE)) == 626
    with pytest.raises(ValueError):
        expected_periods(spark, "lunar", AS_OF, AS_OF)


def test_arrival(spark):
    days = trading_days(date(2026, 5, 1), date(2026, 5, 29))
    df = spark.createDataFrame([(d,) for d in days for _ in range(2)] + [(None,)], "d date")
    status = lambda as_of, floor=None, x=df: {r.kind: (r.status, r.metric) for r in arrival.check_arrival(x, "t", "d", "trading", 3, floor, as_of)}
    assert status(date(2026, 5, 29)) == {"arrival_lag": ("ok", 0.0), "arrival_gap": ("ok", 0.0)}
    late = status(date(2026, 6, 30), 3)
    assert late["arrival_lag"][0] == "breach" and late["arrival_gap"] == ("breach", 21.0) and late["arrival_partial"] == ("warn", float(len(days)))
    assert status(AS_OF, x=df.filter("d is null")) == {"arrival_missing": ("breach", 0.0)}
    assert arrival.check_arrival(None, "t", "d", "daily", 1, None, AS_OF)[0].detail == "table does not exist"


def _contract(*expectations):
    return contracts.Contract("t", 1, "me", (contracts.Field("id", "long", False),), expectations)


def test_contracts(spark):
    good = [(1, -5.0, "2026-06-28", "DEBIT"), (2, 10.0, "2026-06-29", "CREDIT"), (3, -2.5, "2026-06-30", "DEBIT")]
    make = lambda rows: spark.createDataFrame(rows, "id bigint, amount double, d string, kind string")
    checks = (
        {"type": "unique", "column": "id"}, {"type": "accepted_values", "column": "kind", "values": ["DEBIT", "CREDIT"]}, {"type": "range", "column": "amount", "min": -100, "max": 100},
        {"type": "conditional_sign", "column": "amount", "when_column": "kind", "when_value": "DEBIT", "sign": "negative"}, {"type": "freshness", "column": "d", "max_lag_days": 3}, {"type": "row_count", "min": 1},
    )
    failed = lambda rows, *more: {r.expectation for r in contracts.validate(make(rows), _contract(*checks, *more), AS_OF).failures}
    assert failed(good) == set()
    assert failed(good + [good[0]]) == {"unique"}
    assert failed([(i, abs(a), d, k) for i, a, d, k in good]) == {"conditional_sign"}
    assert failed([(i, None, d, k) for i, a, d, k in good]) == {"range"}
    assert failed([(i, float("nan"), d, k) for i, a, d, k in good[1:2]]) == {"range"}
    assert failed([(i, a, d, "REFUND") for i, a, d, k in good]) == {"accepted_values"}
    assert failed([(i, a, "2020-01-01", k) for i, a, d, k in good]) == {"freshness"}
    assert failed([]) == {"range", "freshness", "row_count"}
    assert failed([(None, 1.0, "2026-06-30", None)]) == {"not_null"}
    assert failed(good, {"type": "not_null", "column": "ghost"}) == {"not_null"}
    with pytest.raises(ValueError, match="odd"):
        failed(good, {"type": "odd", "column": "id"})
    with pytest.raises(contracts.ContractViolation, match="unique.*row_count"):
        contracts.assert_valid(make(good + [good[0]]), _contract(checks[0], {"type": "row_count", "min": 99}), AS_OF)


def test_alerts_are_throttled_by_recent_runs(spark):
    cols = "monitor string, table_name string, column_name string, kind string, metric double, baseline_median double, status string, detail string, run_at date"
    at = lambda monitor, d, status="breach": (monitor, "t", None, "row_count", 1.0, 2.0, status, "why", d)
    make = lambda *rows: alerts.from_results(spark.createDataFrame(list(rows), cols))
    log = make(at("a", date(2026, 1, 1)), at("c", date(2025, 1, 1)), at("x", date(2026, 1, 2)), at("y", date(2026, 1, 3)))
    fresh, known = alerts.route(make(at("a", AS_OF), at("b", AS_OF), at("b", AS_OF), at("c", AS_OF), at("d", AS_OF, "ok")), log)
    assert sorted(r.title for r in fresh.collect()) == ["[breach] b on t", "[breach] c on t"] and known.count() == 1
    assert len({r.alert_key for r in make(at("a", AS_OF), at("a", date(2020, 1, 1))).collect()}) == 1


def test_feeds_load_and_bad_ones_are_rejected():
    feeds = load_feeds()
    assert len(feeds) == 3 and sum(len(f.monitors) for f in feeds) == 10 and [a.min_rows for f in feeds for a in f.arrivals] == [6, 6, None]
    good = {"name": "f", "domain": "d", "feed_type": "fact", "owner": "o", "ingest": {"mode": "batch"}, "layers": {"silver": {"table": "silver.accounts"}}}
    assert parse_feed(good).name == "f"
    monitor = {"name": "m", "layer": "silver", "kind": "row_count", "severity": "breaking", "query": "q"}
    for change, word in [
        ({"name": None}, "name"), ({"feed_type": "x"}, "feed_type"), ({"ingest": {"mode": "x"}}, "mode"), ({"layers": {"silver": {"table": "x.y"}}}, "table"), ({"layers": {"copper": {"table": "silver.accounts"}}}, "layer"),
        ({"layers": {"silver": {"table": "silver.accounts", "typed": True}}}, "contract"), ({"layers": {"silver": {"table": "silver.accounts", "contract": "no.yaml"}}}, "no.yaml"),
        ({"monitors": [monitor | {"kind": "x"}]}, "kind"), ({"monitors": [monitor | {"layer": "gold"}]}, "layer"), ({"monitors": [monitor | {"query": ""}]}, "query"), ({"monitors": [monitor | {"name": "a'; drop"}]}, "name"),
        ({"monitors": [monitor | {"tables": {"q": "x.y"}}]}, "table"), ({"arrival": [{"layer": "silver", "column": "c", "calendar": "x", "max_lag_periods": 1}]}, "calendar"),
        ({"arrival": [{"layer": "silver", "column": "c", "calendar": "daily", "max_lag_periods": 1, "min_rows_per_period": "many"}]}, "floor"),
    ]:
        with pytest.raises(FeedError, match=word):
            parse_feed(good | change)


def test_no_feeds_and_repeated_names_are_errors(tmp_path):
    import yaml

    with pytest.raises(FeedError, match="no feeds"):
        load_feeds(tmp_path)
    feed = {"name": "f", "domain": "d", "feed_type": "fact", "owner": "o", "ingest": {"mode": "stream"}, "layers": {"silver": {"table": "silver.accounts"}}}
    for i in range(2):
        (tmp_path / f"{i}.yaml").write_text(yaml.safe_dump(feed))
    with pytest.raises(FeedError, match="more than once"):
        load_feeds(tmp_path)


def test_rename_map_is_by_id_not_position():
    history = [{"field_ids": {"a": 1, "b": 2, "c": 3}}, {"field_ids": {"a": 1, "c_new": 3}}]
    assert drift.rename_map(history) == {"c": ("c_new", 3)}


def test_severities():
    f = lambda kind, **e: drift.classify(drift.Finding(kind, "t", "", e))[0]
    assert f("schema_drift", change="added") == "additive" and f("schema_drift", change="dropped") == "breaking"
    assert f("schema_drift", change="renamed", type_compatible=True) == "renaming" and f("schema_drift", change="renamed", type_compatible=False) == "breaking"
    assert f("schema_drift", change="type_changed", declared_type="int", observed_type="bigint") == "widening"
    assert f("schema_drift", change="type_changed", declared_type="long", observed_type="string") == "breaking"
    assert [f("enum_drift", error=e) for e in ("column_absent", "no_values", "not_comparable", "cardinality_exceeded", None)] == ["breaking", "breaking", "benign", "benign", "enum_drift"]
    assert {f(k) for k in ("monitor_breach", "volume_anomaly", "staleness", "data_corruption")} == {"breaking"} and f("other") == "benign"


def test_enum_watch(spark):
    df = spark.sql("select if(id % 2 = 0, 'a', 'b') as few, string(id) as many, cast(null as string) as none, struct(id) as nested from range(500)")
    watch = tuple({"column": c, "known_values": ["a"]} for c in ("few", "many", "none", "nested", "ghost"))
    seen = drift.observe(df, df.schema, "t", [1], [], None, [w["column"] for w in watch])
    found = {f.evidence["column"]: f.evidence for f in drift.detect(seen, contracts.Contract("t", 1, "", tuple(contracts.Field(c, df.schema[c].dataType.simpleString()) for c in df.columns), (), watch), AS_OF, [])}
    assert found["few"]["new_values"] == ["b"] and {c: found[c]["error"] for c in ("many", "none", "nested", "ghost")} == {"many": "cardinality_exceeded", "none": "no_values", "nested": "not_comparable", "ghost": "column_absent"}


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    lake = Lakehouse(spark, str(tmp_path_factory.mktemp("wh")))
    bronze.ingest_all(lake, 2000)
    return lake


def test_three_days(lake, tmp_path):
    """Clean, then drift, then the same drift again."""
    assert operations.run_agent(lake, AS_OF) == []
    assert report.verdict(report.load_day(lake, AS_OF)) == "CLEAN"
    list(evolve(lake))
    inject_collapse(lake)
    second = operations.run_agent(lake, AS_OF + timedelta(1), dry_run=False, incidents=tmp_path)
    assert sorted(s for _, s, _ in second) == ["additive", "additive", "breaking", "renaming"] and len(list(tmp_path.glob("*.md"))) == 2
    day = report.load_day(lake, AS_OF + timedelta(1))
    assert report.verdict(day) == "ATTENTION REQUIRED" and "4 new, 0 cleared, 0 still open" in report.render(day)
    operations.run_agent(lake, AS_OF + timedelta(2))
    day = report.load_day(lake, AS_OF + timedelta(2))
    text = report.render(day)
    assert "0 new, 0 cleared, 4 still open" in text and "open 1d" in text
    assert text == report.render(report.load_day(lake, AS_OF + timedelta(2)))
    assert report.verdict(report.load_day(lake, AS_OF + timedelta(9))) == "NO RUN"
    changes = report.diff(*(lake.scan("ops.finding_log").filter(F.col("run_at") == F.lit(AS_OF + timedelta(k))) for k in (2, 0)))
    assert {r.change for r in changes.collect()} == {"new"}


def test_monitor_history_and_errors(lake):
    feed = parse_feed({
        "name": "f", "domain": "d", "feed_type": "fact", "owner": "o", "ingest": {"mode": "batch"}, "layers": {"bronze": {"table": "bronze.yodlee_accounts_raw"}},
        "monitors": [{"name": "rows", "layer": "bronze", "kind": "row_count", "severity": "breaking", "query": "SELECT count(*) AS metric FROM t"}, {"name": "broken", "layer": "bronze", "kind": "row_count", "severity": "breaking", "query": "SELECT nothing FROM t"}],
    })
    for k in range(16):
        operations.record(lake, [monitors.MonitorResult("rows", "t", None, "row_count", 1000.0 * (k + 1), None, "ok", "", date(2026, 1, 1) + timedelta(k))])
    assert monitors.baselines(lake.scan("ops.monitor_results"), "rows") == [1000.0 * k for k in range(3, 17)]
    found = {r.monitor: r for r in operations.run_monitors(lake, AS_OF, (feed,))}
    assert found["rows"].status == "breach" and found["rows"].baseline == 9500.0 and found["broken"].detail.startswith("monitor failed")
    assert operations.route_alerts(lake, list(found.values())) == (2, 0) and operations.route_alerts(lake, list(found.values())) == (0, 2)


def test_report_numbers():
    assert [report.number(x) for x in (None, 250000.0, 0.0001, 171.4137)] == ["—", "250,000", "1.00e-04", "171.4"]
    assert [report.change(a, b) for a, b in ((1, None), (5, 5), (171.4137026799999, 171.41370268000063), (6, 4))] == ["—", "0", "0", "+2"]
