"""The calendar and arrival queries over whole tables with days that are missing or thin."""

from datetime import datetime, timedelta

from stratalake.queries import QUERIES, SQL

DAY = datetime(2024, 1, 1)


def test_gaps_are_those_of_all_orders(spark, tmp_path):
    """Customers 1 to 9, none of them a multiple of 97; days 3 and 6 have no orders."""
    rows = [(i, 1 + i % 9, DAY + timedelta(d, hours=i % 24)) for i, d in enumerate([0, 1, 1, 2, 4, 5, 7])]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    got = QUERIES["j5_f9_calendar_gaps"](spark, str(tmp_path)).collect()
    assert sorted(r.period for r in got) == ["2024-01-04", "2024-01-07"]


def test_arrivals_are_those_of_all_events(spark, tmp_path):
    """Eight days, no user a multiple of 7: day 2 is missing and day 5 thin; the newest day is ten days old."""
    rows = [(1 + k % 6, DAY + timedelta(d)) for d, n in enumerate([5, 6, 0, 5, 9, 4, 5, 5]) for k in range(n)]
    spark.createDataFrame(rows, "user_id long, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.kind: (r.metric, r.status) for r in QUERIES["r1_r5_arrival"](spark, str(tmp_path)).collect()}
    assert got == {"arrival_lag": (10.0, "breach"), "arrival_gap": (11.0, "breach"), "arrival_partial": (1.0, "warn")}


def test_their_sql_takes_no_subset():
    assert not any("%" in SQL[name] for name in ("j5_f9_calendar_gaps", "r1_r5_arrival"))
