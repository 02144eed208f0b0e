"""One query for each operator of the blueprint, over the star-schema test tables, with DuckDB SQL for the same result.

Stand-ins: line items are transactions (returned ones are debits), part brands are tickers, customers are accounts, events
are corrections that arrive late.  Dates leave as text, computed doubles rounded: both engines add in their own order.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .functions.calendar import expected_periods
from .functions.scalars import duplicates, iso_date, is_close, normalize_merchant, null_rate, ratio, short_key, signed_amount
from .operators import alerts, arrival, contracts, drift, features, monitors
from .operators.latest import latest, split
from .plans import forecast, report

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, dates as text."""
    out = {n: r(n, digits) for n, t in df.dtypes if t == "double"} | {n: F.col(n).cast("string") for n, t in df.dtypes if t in ("date", "timestamp")}
    return df.withColumns(out)


# -- stand-ins ---------------------------------------------------------------------------------------------------------


def txns(spark: SparkSession, sf: str, only: str = "true") -> DataFrame:
    """Line items as conformed transactions: only the columns that marts read leave the scans.

    ``only``: a filter in terms of the line items, for marts of one category; it reaches the scan.
    """
    item = read(spark, sf, "lineitem").filter(only)
    order = read(spark, sf, "orders").select("o_orderkey", "o_custkey")
    direction = F.when(F.col("l_returnflag") == "R", "DEBIT").otherwise("CREDIT")
    return item.join(order, item.l_orderkey == order.o_orderkey).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("o_custkey").alias("account_id"), F.to_date("l_shipdate").alias("txn_date"),
        signed_amount(F.col("l_extendedprice"), direction).alias("signed_amount"), direction.alias("base_type"), F.when(F.col("l_linestatus") == "F", "EXPENSE").otherwise("INCOME").alias("category_type"),
        F.col("l_partkey").cast("string").alias("merchant_normalized"),
    )


def spend(spark: SparkSession, sf: str) -> DataFrame:
    """The daily spend mart; line items of status F are the expenses."""
    return features.daily_spend(txns(spark, sf, "l_linestatus = 'F'"), brands(spark, sf))


def brands(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("merchant_normalized"), F.col("p_brand").alias("ticker"))


def bars(spark: SparkSession, sf: str) -> DataFrame:
    """Daily price bars of brands: average unit price as close, summed quantity as volume."""
    item, part = read(spark, sf, "lineitem"), read(spark, sf, "part").select("p_partkey", "p_brand")
    joined = item.join(part, item.l_partkey == part.p_partkey)
    close = F.avg(F.col("l_extendedprice") / F.nullif(F.col("l_quantity"), F.lit(0.0)))
    return joined.groupBy(F.col("p_brand").alias("ticker"), F.to_date("l_shipdate").alias("trade_date")).agg(close.alias("close"), close.alias("adj_close"), F.sum("l_quantity").alias("volume"))


TXN = """txn AS (SELECT l_orderkey * 10 + l_linenumber AS id, o_custkey AS account_id, l_shipdate::DATE AS txn_date,
  CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END AS signed_amount, CASE WHEN l_returnflag = 'R' THEN 'DEBIT' ELSE 'CREDIT' END AS base_type,
  CASE WHEN l_linestatus = 'F' THEN 'EXPENSE' ELSE 'INCOME' END AS category_type, l_partkey::VARCHAR AS merchant_normalized
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey), map AS (SELECT p_partkey::VARCHAR AS merchant_normalized, p_brand AS ticker FROM part)"""
SPEND = f"""{TXN}, spend AS (SELECT ticker, txn_date AS spend_date, sum(abs(signed_amount)) AS gross_spend, count(*) AS txn_count, count(DISTINCT account_id) AS unique_accounts,
  avg(abs(signed_amount)) AS avg_ticket, median(abs(signed_amount)) AS median_ticket FROM txn JOIN map USING (merchant_normalized) WHERE category_type = 'EXPENSE' GROUP BY 1, 2)"""
BARS = """bars AS (SELECT p_brand AS ticker, l_shipdate::DATE AS trade_date, avg(l_extendedprice / nullif(l_quantity, 0)) AS close, avg(l_extendedprice / nullif(l_quantity, 0)) AS adj_close,
  sum(l_quantity) AS volume FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
_W = "PARTITION BY ticker ORDER BY trade_date"
PRICE = f"""{BARS}, base AS (SELECT *, close / nullif(lag(close) OVER ({_W}), 0) - 1 AS ret_1d FROM bars), moves AS (SELECT *, greatest(ret_1d, 0) AS gain, greatest(-ret_1d, 0) AS loss FROM base),
 px AS (SELECT ticker, trade_date, close, ret_1d, lag(ret_1d, 1) OVER ({_W}) AS ret_lag_1, lag(ret_1d, 2) OVER ({_W}) AS ret_lag_2, lag(ret_1d, 3) OVER ({_W}) AS ret_lag_3, lag(ret_1d, 4) OVER ({_W}) AS ret_lag_4,
  lag(ret_1d, 5) OVER ({_W}) AS ret_lag_5, stddev_samp(ret_1d) OVER ({_W} ROWS 20 PRECEDING) * sqrt(252) AS realized_vol_21d,
  100 - 100 / nullif(1 + avg(gain) OVER ({_W} ROWS 13 PRECEDING) / nullif(avg(loss) OVER ({_W} ROWS 13 PRECEDING), 0), 0) AS rsi_14,
  (volume - avg(volume) OVER ({_W} ROWS 20 PRECEDING)) / nullif(stddev_samp(volume) OVER ({_W} ROWS 20 PRECEDING), 0) AS volume_z_21d FROM moves)"""
_S = "PARTITION BY ticker ORDER BY spend_date"
SPENDF = f"""sw AS (SELECT *, avg(gross_spend) OVER ({_S} ROWS 6 PRECEDING) AS m7, avg(gross_spend) OVER ({_S} ROWS 27 PRECEDING) AS m28, stddev_samp(gross_spend) OVER ({_S} ROWS 27 PRECEDING) AS s28,
  avg(txn_count) OVER ({_S} ROWS 27 PRECEDING) AS tm28, stddev_samp(txn_count) OVER ({_S} ROWS 27 PRECEDING) AS ts28, avg(avg_ticket) OVER ({_S} ROWS 6 PRECEDING) AS k7, avg(avg_ticket) OVER ({_S} ROWS 27 PRECEDING) AS k28,
  CASE WHEN count(*) OVER ({_S} ROWS 6 PRECEDING) = 7 THEN avg(unique_accounts) OVER ({_S} ROWS 6 PRECEDING) END AS a7,
  avg(gross_spend) OVER (PARTITION BY ticker, dayofweek(spend_date) ORDER BY spend_date ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS naive FROM spend),
 sl AS (SELECT *, lag(a7, 7) OVER ({_S}) AS a7p FROM sw),
 sf AS (SELECT ticker, spend_date, m7 / nullif(m28, 0) - 1 AS spend_mom_7d, (gross_spend - m28) / nullif(s28, 0) AS spend_z_28d, (txn_count - tm28) / nullif(ts28, 0) AS txn_count_z_28d, k7 / nullif(k28, 0) - 1 AS avg_ticket_delta_7d,
  a7 / nullif(a7p, 0) - 1 AS unique_acct_growth_7d, (gross_spend - naive) / nullif(s28, 0) AS spend_surprise FROM sl)"""
SPEND_COLS = ("spend_mom_7d", "spend_z_28d", "txn_count_z_28d", "avg_ticket_delta_7d", "unique_acct_growth_7d", "spend_surprise")
PRICE_COLS = ("ret_lag_1", "ret_lag_2", "ret_lag_3", "ret_lag_4", "ret_lag_5", "realized_vol_21d", "rsi_14", "volume_z_21d")
rsql = lambda cols, p="", n=6: ", ".join(f"round({p}{c}, {n}) AS {c}" for c in cols)


# -- marts (K8, K9, K10) with their joins, aggregates and windows ------------------------------------------------------


@query(f"WITH {SPEND} SELECT ticker, spend_date::VARCHAR AS spend_date, round(gross_spend, 4) AS gross_spend, txn_count, unique_accounts, round(avg_ticket, 4) AS avg_ticket, round(median_ticket, 4) AS median_ticket FROM spend")
def k8_daily_merchant_spend(spark: SparkSession, sf: str) -> DataFrame:
    """A1-A6, J1, P3."""
    return rounded(spend(spark, sf), 4)


@query(f"WITH {PRICE} SELECT ticker, trade_date::VARCHAR AS trade_date, round(close, 9) AS close, {rsql(('ret_1d', *PRICE_COLS))} FROM px")
def k9_stock_features(spark: SparkSession, sf: str) -> DataFrame:
    """W4-W8, P8, P9."""
    out = features.price_features(bars(spark, sf))
    return out.select("ticker", F.col("trade_date").cast("string").alias("trade_date"), r("close", 9).alias("close"), *(r(c).alias(c) for c in ("ret_1d", *PRICE_COLS)))


@query(
    f"WITH {PRICE}, {SPEND}, {SPENDF}, target AS (SELECT ticker, trade_date, lead(adj_close, 5) OVER ({_W}) / nullif(adj_close, 0) - 1 AS fwd_ret_5d FROM bars) "
    f"SELECT p.ticker, p.trade_date::VARCHAR AS trade_date, {rsql(SPEND_COLS, 's.')}, {rsql(PRICE_COLS, 'p.')}, round(t.fwd_ret_5d, 6) AS fwd_ret_5d FROM px p JOIN target t ON p.ticker = t.ticker AND p.trade_date = t.trade_date LEFT JOIN sf s ON s.ticker = p.ticker AND s.spend_date = p.trade_date"
)
def k10_training_set(spark: SparkSession, sf: str) -> DataFrame:
    """W9-W14, P7, J2, J3."""
    return rounded(features.training_set(features.price_features(bars(spark, sf), ahead=5), None, spend(spark, sf)))


@query(f"WITH {SPEND}, {SPENDF} SELECT ticker, spend_date::VARCHAR AS spend_date, {rsql(SPEND_COLS)} FROM sf")
def w9_w13_spend_windows(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(features.spend_features(spend(spark, sf)))


@query(f"WITH {BARS} SELECT ticker, trade_date::VARCHAR AS trade_date, round(lead(adj_close, 5) OVER ({_W}) / nullif(adj_close, 0) - 1, 6) AS fwd_ret_5d FROM bars")
def w14_forward_return(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(features.forward_return(bars(spark, sf)))


# -- projections, filters, conditions ---------------------------------------------------------------------------------


@query("SELECT c_custkey, upper(c_name) AS name, {'amount': c_acctbal, 'currency': 'USD'}.amount AS balance, c_acctbal * 2 AS twice FROM customer WHERE c_mktsegment = 'BUILDING'")
def p1_p3_struct_projection(spark: SparkSession, sf: str) -> DataFrame:
    money = read(spark, sf, "customer").withColumn("balance", F.struct(F.col("c_acctbal").alias("amount"), F.lit("USD").alias("currency")))
    return money.filter(F.col("c_mktsegment") == "BUILDING").select("c_custkey", F.upper("c_name").alias("name"), F.col("balance.amount").alias("balance"), (F.col("balance.amount") * 2).alias("twice"))


@query("SELECT count(*) FILTER (nullif(o_orderstatus, 'P') IS NULL) AS missing, count(*) FILTER (nullif(o_orderstatus, 'P') IS NOT NULL) AS present FROM orders")
def p4_null_predicates(spark: SparkSession, sf: str) -> DataFrame:
    s = F.nullif(F.col("o_orderstatus"), F.lit("P"))
    return read(spark, sf, "orders").agg(F.count_if(s.isNull()).alias("missing"), F.count_if(s.isNotNull()).alias("present"))


@query("SELECT user_id, event_type, event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC NULLS LAST, event_id DESC) AS rn FROM events) WHERE rn = 1")
def p5_w1_latest_record(spark: SparkSession, sf: str) -> DataFrame:
    """Late corrections win, exact ties go by a unique column."""
    rows = latest(read(spark, sf, "events"), ["user_id", "event_type"], [F.col("ts").desc_nulls_last(), F.col("event_id").desc()])
    return rows.select("user_id", "event_type", "event_id", r("value").alias("value"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END AS signed_amount, CASE WHEN l_quantity > 25 THEN l_discount END AS big_discount, round(l_extendedprice / nullif(l_tax, 0), 4) AS per_tax, greatest(nullif(l_discount, 0.05), 0) AS floor0 FROM lineitem")
def p6_p9_conditional_expressions(spark: SparkSession, sf: str) -> DataFrame:
    direction = F.when(F.col("l_returnflag") == "R", "DEBIT")
    return read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", signed_amount(F.col("l_extendedprice"), direction).alias("signed_amount"), F.when(F.col("l_quantity") > 25, F.col("l_discount")).alias("big_discount"),
        r(ratio(F.col("l_extendedprice"), F.col("l_tax")), 4).alias("per_tax"), F.greatest(F.nullif(F.col("l_discount"), F.lit(0.05)), F.lit(0.0)).alias("floor0"),
    )


@query("SELECT route, reason, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM (SELECT CASE WHEN s IS NOT DISTINCT FROM 'F' THEN 'clean' ELSE 'quarantine' END AS route, CASE WHEN s IS DISTINCT FROM 'F' THEN 'not_final' END AS reason, o_totalprice FROM (SELECT nullif(o_orderstatus, 'P') AS s, o_totalprice FROM orders)) GROUP BY 1, 2")
def p10_p11_quarantine_split(spark: SparkSession, sf: str) -> DataFrame:
    """Null isn't lost: it is quarantined."""
    clean, rest = split(read(spark, sf, "orders").withColumn("s", F.nullif(F.col("o_orderstatus"), F.lit("P"))), F.col("s").eqNullSafe("F"))
    both = clean.withColumns({"route": F.lit("clean"), "reason": F.lit(None).cast("string")}).unionByName(rest.withColumns({"route": F.lit("quarantine"), "reason": F.lit("not_final")}))
    return both.groupBy("route", "reason").agg(F.count(F.lit(1)).alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS reason WHERE false")
def p12_empty_typed(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([], "id bigint, reason string")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def p13_j4_in_subquery(spark: SparkSession, sf: str) -> DataFrame:
    some = read(spark, sf, "customer").filter(F.col("c_mktsegment") == "MACHINERY").select(F.col("c_custkey").alias("o_custkey"))
    return read(spark, sf, "orders").join(some, "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("""SELECT event_id, substr(sha256(coalesce(user_id::VARCHAR, '') || '|' || coalesce(event_type, '')), 1, 16) AS row_key, 'events.parquet' AS source_file,
  sha256('{"event_id":' || coalesce(event_id::VARCHAR, 'null') || ',"event_type":' || coalesce('"' || event_type || '"', 'null') || ',"user_id":' || coalesce(user_id::VARCHAR, 'null') || '}') AS payload_hash FROM events""")
def p14_f10_f11_lineage_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Records are stamped with the table they come from and the hash of their own columns."""
    from .plans.bronze import stamp

    table = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+\.parquet)(/|$)", 1)
    stamped = stamp(read(spark, sf, "events").select("user_id", "event_type", "event_id", table.alias("_source_file")))
    return stamped.select("event_id", short_key(F.col("user_id"), F.col("event_type")).alias("row_key"), F.col("_source_file").alias("source_file"), F.col("_payload_hash").alias("payload_hash"))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 7")
def p15_point_filter(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "nation").filter(F.col("n_nationkey") == 7).select("n_nationkey", "n_name")


# -- joins -------------------------------------------------------------------------------------------------------------


@query("WITH a AS (SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_quantity > 40), b AS (SELECT s_suppkey, s_nationkey FROM supplier) SELECT n_name, count(*) AS n FROM a JOIN b ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def j1_inner_dimension(spark: SparkSession, sf: str) -> DataFrame:
    a = read(spark, sf, "lineitem").filter("l_quantity > 40").select("l_suppkey")
    s, n = read(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), read(spark, sf, "nation").select("n_nationkey", "n_name")
    return a.join(s, a.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


@query("WITH a AS (SELECT o_custkey AS k, o_orderdate::DATE AS d, count(*) AS n FROM orders GROUP BY 1, 2), b AS (SELECT o_custkey AS k, l_shipdate::DATE AS e, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2) SELECT a.k, d::VARCHAR AS d, n, q FROM a LEFT JOIN b ON a.k = b.k AND a.d = b.e")
def j2_j3_two_key_joins(spark: SparkSession, sf: str) -> DataFrame:
    o, item = read(spark, sf, "orders"), read(spark, sf, "lineitem")
    a = o.groupBy(F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    b = item.join(o, item.l_orderkey == o.o_orderkey).groupBy(F.col("o_custkey").alias("k"), F.to_date("l_shipdate").alias("d")).agg(F.sum("l_quantity").alias("q"))
    return a.join(b, ["k", "d"], "left").select("k", F.col("d").cast("string").alias("d"), "n", "q")


_CAL = """ends AS (SELECT min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS b FROM orders), days AS (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS period FROM ends),
  n AS (SELECT o_orderdate::DATE AS period, count(*) AS n FROM orders GROUP BY 1)"""


@query(f"WITH {_CAL} SELECT period::VARCHAR AS period FROM days ANTI JOIN n USING (period)")
def j5_f9_calendar_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """All orders; days that are missing are tested on a small table."""
    o = read(spark, sf, "orders")
    ends = o.agg(F.min(F.to_date("o_orderdate")).alias("a"), F.max(F.to_date("o_orderdate")).alias("b")).first()
    counts = arrival.period_counts(o, "o_orderdate")
    return arrival.missing(expected_periods(spark, "daily", ends["a"], ends["b"]), counts).select(F.col("period").cast("string").alias("period"))


@query("SELECT coalesce(a.k, b.k) AS finding_key, CASE WHEN b.k IS NULL THEN 'new' WHEN a.k IS NULL THEN 'cleared' ELSE 'still_open' END AS change FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE year(o_orderdate) = 1997) a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE year(o_orderdate) = 1996) b ON a.k = b.k")
def j6_u4_run_diff(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("finding_key"), F.year("o_orderdate").alias("y"))
    return report.diff(o.filter("y = 1997"), o.filter("y = 1996"))


@query("SELECT round((SELECT count(*) FROM orders WHERE o_orderstatus = 'P')::DOUBLE / nullif((SELECT count(*) FROM orders), 0), 8) AS metric")
def j7_scalar_subqueries(spark: SparkSession, sf: str) -> DataFrame:
    text = "SELECT round(CAST((SELECT count(*) FROM {q}) AS DOUBLE) / nullif((SELECT count(*) FROM {t}), 0), 8) AS metric"
    o = read(spark, sf, "orders")
    return spark.sql(text, t=o, q=o.filter("o_orderstatus = 'P'"))


# -- aggregates --------------------------------------------------------------------------------------------------------


@query("SELECT l_returnflag, l_linestatus, round(sum(abs(l_extendedprice)), 2) AS gross, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, round(avg(l_discount), 6) AS discount, round(median(l_quantity), 4) AS mid, min(l_shipdate)::DATE::VARCHAR AS first, max(l_shipdate)::DATE::VARCHAR AS last FROM lineitem GROUP BY ALL")
def a1_a7_group_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        r(F.sum(F.abs("l_extendedprice")), 2).alias("gross"), F.count(F.lit(1)).alias("n"), F.count_distinct("l_suppkey").alias("suppliers"), r(F.avg("l_discount")).alias("discount"), r(F.median("l_quantity"), 4).alias("mid"),
        F.min(F.to_date("l_shipdate")).cast("string").alias("first"), F.max(F.to_date("l_shipdate")).cast("string").alias("last"),
    )


@query("SELECT DISTINCT lang FROM documents")
def a8_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("lang").distinct()


@query("SELECT round(avg((nullif(o_orderstatus, 'P') IS NULL)::INT::DOUBLE), 8) AS null_rate, count(*) - count(DISTINCT nullif(o_custkey, 1)) AS duplicates, count(nullif(o_custkey, 1)) - count(DISTINCT nullif(o_custkey, 1)) AS contract_duplicates, (SELECT count(*) FROM (SELECT DISTINCT o_custkey, nullif(o_orderstatus, 'P') FROM orders)) AS pairs FROM orders")
def a9_a12_rates_and_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    k, s = F.nullif(F.col("o_custkey"), F.lit(1).cast("bigint")), F.nullif(F.col("o_orderstatus"), F.lit("P"))
    return read(spark, sf, "orders").agg(
        r(null_rate(s), 8).alias("null_rate"), duplicates(k).alias("duplicates"), (F.count(k) - F.count_distinct(k)).alias("contract_duplicates"), F.count_distinct(F.struct("o_custkey", s)).alias("pairs"),
    )


@query("WITH m AS (SELECT event_type, median(value) AS mid FROM events GROUP BY 1) SELECT event_type, round(any_value(mid), 6) AS mid, round(median(abs(value - mid)), 6) AS mad, round(avg(abs(value - mid)), 6) AS mean_dev FROM events JOIN m USING (event_type) GROUP BY 1")
def a13_median_deviation(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events")
    away = F.abs(F.col("value") - F.col("mid"))
    return e.join(e.groupBy("event_type").agg(F.median("value").alias("mid")), "event_type").groupBy("event_type").agg(r(F.first("mid")).alias("mid"), r(F.median(away)).alias("mad"), r(F.avg(away)).alias("mean_dev"))


@query("SELECT user_id AS finding_key, min(ts)::DATE::VARCHAR AS first_seen, arg_max(event_type, event_id) AS last_kind FROM events GROUP BY 1")
def a14_a15_first_seen_last_write(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").groupBy(F.col("user_id").alias("finding_key")).agg(F.min(F.to_date("ts")).cast("string").alias("first_seen"), F.max_by("event_type", "event_id").alias("last_kind"))


@query("SELECT run_at::VARCHAR AS run_at, user_id, event_id, event_type FROM (SELECT *, ts::DATE AS run_at, row_number() OVER (PARTITION BY ts::DATE, user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1")
def a15_last_of_run(spark: SparkSession, sf: str) -> DataFrame:
    """Days are runs, users are findings: what was written last in each run."""
    e = read(spark, sf, "events").select(F.to_date("ts").alias("run_at"), "user_id", "event_id", "event_type")
    return report.last_of_run(e, "user_id", "event_id").withColumn("run_at", F.col("run_at").cast("string"))


@query("SELECT c AS \"column\", v AS value FROM (SELECT c, v, row_number() OVER (PARTITION BY c ORDER BY v) AS rn FROM (SELECT DISTINCT 'lang' AS c, lang AS v FROM documents UNION SELECT DISTINCT 'source', source FROM documents) WHERE v IS NOT NULL) WHERE rn <= 201")
def a16_d7_enum_values(spark: SparkSession, sf: str) -> DataFrame:
    return drift.enum_values(read(spark, sf, "documents"), ["lang", "source"])


_PRED = "p AS (SELECT p_brand AS ticker, l_shipdate::DATE AS trade_date, avg(l_discount) - 0.05 AS y_true, avg(l_tax) - 0.04 AS y_pred FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    item, part = read(spark, sf, "lineitem"), read(spark, sf, "part").select("p_partkey", "p_brand")
    joined = item.join(part, item.l_partkey == part.p_partkey).groupBy(F.col("p_brand").alias("ticker"), F.to_date("l_shipdate").alias("trade_date"))
    return joined.agg((F.avg("l_discount") - 0.05).alias("y_true"), (F.avg("l_tax") - 0.04).alias("y_pred"))


@query(
    f"WITH {_PRED}, q AS (SELECT ticker, round(y_true, 10) AS y_true, round(y_pred, 10) AS y_pred FROM p), k AS (SELECT *, rank() OVER (PARTITION BY ticker ORDER BY y_pred) + (count(*) OVER (PARTITION BY ticker, y_pred) - 1) / 2.0::DOUBLE AS rp, rank() OVER (PARTITION BY ticker ORDER BY y_true) + (count(*) OVER (PARTITION BY ticker, y_true) - 1) / 2.0::DOUBLE AS ry FROM q) "
    "SELECT ticker, round(sqrt(avg((y_true - y_pred) ** 2)), 6) AS rmse, round(avg(abs(y_true - y_pred)), 6) AS mae, round(avg((sign(y_true) = sign(y_pred))::INT::DOUBLE), 6) AS directional_accuracy, round(corr(rp, ry), 6) AS ic, count(*) AS n FROM k GROUP BY 1"
)
def a17_a19_x7_forecast_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Values are rounded first: Spearman's ranks must see the same ties in both engines."""
    p = _predictions(spark, sf).withColumns({"y_true": F.round("y_true", 10), "y_pred": F.round("y_pred", 10)})
    return rounded(forecast.metrics(p, "y_pred", "ticker"))


@query(
    f"WITH {_PRED}, k AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY y_pred DESC, ticker) AS up, row_number() OVER (PARTITION BY trade_date ORDER BY y_pred, ticker DESC) AS down, count(*) OVER (PARTITION BY trade_date) AS m FROM (SELECT ticker, trade_date, round(y_true, 10) AS y_true, round(y_pred, 10) AS y_pred FROM p)), "
    "s AS (SELECT trade_date, (avg(y_true) FILTER (up <= 2) - avg(y_true) FILTER (down <= 2)) / 2 AS spread FROM k WHERE m >= 4 GROUP BY 1) SELECT count(*) AS days, round(CASE WHEN count(*) >= 20 AND stddev_samp(spread) > 0 THEN avg(spread) / stddev_samp(spread) * sqrt(252 / 5.0) END, 6) AS sharpe FROM s"
)
def a18_w15_x8_long_short_sharpe(spark: SparkSession, sf: str) -> DataFrame:
    p = _predictions(spark, sf).withColumns({"y_true": F.round("y_true", 10), "y_pred": F.round("y_pred", 10)})
    return rounded(forecast.sharpe(p, "y_pred"))


@query("SELECT round(avg((nullif(l_returnflag, 'N') IS NULL AND nullif(l_linestatus, 'O') IS NULL)::INT::DOUBLE), 8) AS share FROM lineitem")
def a20_all_null_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "lineitem").select(F.nullif(F.col("l_returnflag"), F.lit("N")).alias("a"), F.nullif(F.col("l_linestatus"), F.lit("O")).alias("b"))
    return spark.createDataFrame([(round(forecast.sparse_share(rows, ("a", "b")), 8),)], "share double")


# -- sorts, limits, sets, scalars -------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 14")
def o1_o2_o4_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(14).select("o_orderkey", "o_totalprice")


@query("SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderdate::DATE IN (SELECT DISTINCT o_orderdate::DATE AS d FROM orders ORDER BY d DESC LIMIT 3)")
def o3_l2_last_runs(spark: SparkSession, sf: str) -> DataFrame:
    log = read(spark, sf, "orders").select(F.to_date("o_orderdate").alias("run_at"), F.col("o_orderpriority").alias("alert_key"))
    return alerts.recent_keys(log).withColumnRenamed("alert_key", "o_orderpriority")


@query("WITH g AS (SELECT o_custkey AS k, o_orderdate::DATE AS d FROM orders GROUP BY 1, 2) SELECT k, list_slice(list(d ORDER BY d), 1, 5)[1]::VARCHAR AS first, len(list_slice(list(d ORDER BY d), 1, 5)) AS shown FROM g GROUP BY 1")
def o6_first_five(spark: SparkSession, sf: str) -> DataFrame:
    g = read(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("d")).distinct()
    five = F.slice(F.sort_array(F.collect_list("d")), 1, 5)
    return g.groupBy("k").agg(five.alias("x")).select("k", F.get("x", F.lit(0)).cast("string").alias("first"), F.size("x").cast("bigint").alias("shown"))


@query("SELECT c_nationkey AS k, 'customer' AS src FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier")
def u1_union_all(spark: SparkSession, sf: str) -> DataFrame:
    c, s = read(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), read(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.withColumn("src", F.lit("customer")).unionByName(s.withColumn("src", F.lit("supplier")))


@query("SELECT DISTINCT event_type AS value FROM events WHERE event_type NOT IN ('click', 'view') AND event_type IS NOT NULL")
def u2_u3_new_values(spark: SparkSession, sf: str) -> DataFrame:
    known = spark.createDataFrame([("click",), ("view",)], "value string")
    return read(spark, sf, "events").select(F.col("event_type").alias("value")).filter("value is not null").distinct().join(known, "value", "left_anti")


@query("SELECT p_brand, p_type, min(p_partkey) AS p_partkey FROM part GROUP BY 1, 2")
def u5_dedupe_first(spark: SparkSession, sf: str) -> DataFrame:
    return latest(read(spark, sf, "part"), ["p_brand", "p_type"], [F.col("p_partkey").asc()]).select("p_brand", "p_type", "p_partkey")


@query(
    r"""SELECT p_partkey, nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(p_name || ' #' || p_partkey || '''s'), '[''’]', '', 'g'), '#\s*\d+|-\s*\d+|\b\d{3,}\b', ' ', 'g'), '[^A-Z0-9 ]', ' ', 'g'), ' +', ' ', 'g')), '') AS merchant FROM part"""
)
def f1_normalize_merchant(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.col("p_name"), F.lit(" #"), F.col("p_partkey").cast("string"), F.lit("'s"))
    return read(spark, sf, "part").select("p_partkey", normalize_merchant(raw).alias("merchant"))


@query(
    "SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y-%m-%d') AS DATE)::VARCHAR AS d, CASE WHEN regexp_full_match(t, '\\d{4}-\\d{2}-\\d{2}') THEN try_cast(t AS DATE) END::VARCHAR AS safe, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS days, abs(o_totalprice - 1000) AS away FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y') WHEN o_orderkey % 3 = 1 THEN '2024-13-45' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS t FROM orders)"
)
def f2_f5_f7_f8_dates(spark: SparkSession, sf: str) -> DataFrame:
    d = F.date_format("o_orderdate", "yyyy-MM-dd")
    k = F.col("o_orderkey") % 3
    t = F.when(k == 0, F.date_format("o_orderdate", "yyyy")).when(k == 1, "2024-13-45").otherwise(d)
    return read(spark, sf, "orders").select(
        "o_orderkey", d.cast("date").cast("string").alias("d"), iso_date(t).cast("string").alias("safe"), F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("bigint").alias("days"),
        F.abs(F.col("o_totalprice") - 1000).alias("away"),
    )


@query("SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events")
def f13_json(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("SELECT event_id, abs(value - 50) <= greatest(1e-9 * greatest(abs(value), 50), 1e-9) AS close, sign(value - 50)::DOUBLE AS side, least(greatest(value, 10), 90) AS clipped FROM events")
def f15_f16_numeric(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    return read(spark, sf, "events").select("event_id", is_close(v, F.lit(50.0)).alias("close"), F.signum(v - 50).alias("side"), F.least(F.greatest(v, F.lit(10.0)), F.lit(90.0)).alias("clipped"))


# -- contracts, monitors, arrivals, alerts, drift ---------------------------------------------------------------------

_CONTRACT = contracts.Contract(
    "orders", 1, "data-platform", tuple(contracts.Field(n, t, n != "o_orderkey") for n, t in (("o_orderkey", "long"), ("o_custkey", "long"), ("o_ghost", "string"))),
    (
        {"type": "not_null", "column": "o_custkey"}, {"type": "unique", "column": "o_orderkey"}, {"type": "unique", "column": "o_custkey"}, {"type": "accepted_values", "column": "o_orderstatus", "values": ["F", "O"]},
        {"type": "range", "column": "o_totalprice", "min": 0, "max": 10}, {"type": "row_count", "min": 10}, {"type": "freshness", "column": "o_orderdate", "max_lag_days": 1},
        {"type": "conditional_sign", "column": "o_totalprice", "when_column": "o_orderstatus", "when_value": "F", "sign": "negative"},
    ),
)


@query(
    """WITH m AS (SELECT count(*) AS n, count(DISTINCT o_orderkey) AS dk, count(DISTINCT o_custkey) AS dc, count(o_custkey) AS nc, bool_and(o_orderstatus IN ('F', 'O')) AS st, min(o_totalprice) AS lo, max(o_totalprice) AS hi, max(o_orderdate)::DATE AS newest, count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 0) AS wrong FROM orders)
    SELECT unnest(['schema_present', 'schema_present', 'schema_present', 'not_null', 'not_null', 'unique', 'unique', 'accepted_values', 'range', 'row_count', 'freshness', 'conditional_sign']) AS expectation,
      unnest(['o_orderkey', 'o_custkey', 'o_ghost', 'o_orderkey', 'o_custkey', 'o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', NULL, 'o_orderdate', 'o_totalprice']) AS column_name,
      unnest([true, true, false, true, n = nc, n = dk, nc = dc, st, lo >= 0 AND hi <= 10, n >= 10, date_diff('day', newest, DATE '2030-01-01') <= 1, wrong = 0]) AS passed FROM m"""
)
def c1_c12_contract(spark: SparkSession, sf: str) -> DataFrame:
    """All expectations from one aggregation."""
    found = contracts.validate(read(spark, sf, "orders"), _CONTRACT, date(2030, 1, 1))
    return spark.createDataFrame([(x.expectation, x.column, x.passed) for x in found.results], "expectation string, column_name string, passed boolean")


@query(
    """WITH d AS (SELECT ts::DATE AS run_at, count(*)::DOUBLE AS metric FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY run_at DESC) AS k FROM d), b AS (SELECT median(metric) AS mid FROM r WHERE k BETWEEN 2 AND 15)
    SELECT metric, mid AS baseline, CASE WHEN mid <= 0 THEN 'ok' WHEN metric / mid < 0.5 THEN 'breach' WHEN metric / mid < 0.8 THEN 'warn' ELSE 'ok' END AS status FROM r, b WHERE k = 1"""
)
def m1_m8_volume_monitor(spark: SparkSession, sf: str) -> DataFrame:
    """The last day's rows against the median of the 14 days before."""
    import statistics

    d = read(spark, sf, "events").groupBy(F.to_date("ts").alias("run_at")).agg(F.count(F.lit(1)).cast("double").alias("metric")).withColumn("monitor", F.lit("events"))
    newest = d.orderBy(F.col("run_at").desc()).limit(1).first()
    history = monitors.baselines(d, "events", newest["run_at"])
    status, _ = monitors.judge(newest["metric"], history, "row_count")
    return spark.createDataFrame([(newest["metric"], float(statistics.median(history)), status)], "metric double, baseline double, status string")


_ARRIVAL = """WITH e AS (SELECT ts::DATE AS d, count(*) AS n FROM events GROUP BY 1), w AS (SELECT greatest(max(d) - 30, min(d)) AS a, max(d) + 10 AS b, max(d) AS newest FROM e),
      p AS (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS d FROM w), s AS (SELECT p.d, n FROM p LEFT JOIN e USING (d))
    SELECT 'arrival_lag' AS kind, 10.0::DOUBLE AS metric, 'breach' AS status UNION ALL SELECT 'arrival_gap', count(*) FILTER (n IS NULL)::DOUBLE, CASE WHEN count(*) FILTER (n IS NULL) > 0 THEN 'breach' ELSE 'ok' END FROM s
    UNION ALL SELECT 'arrival_partial', count(*) FILTER (n < 5)::DOUBLE, CASE WHEN count(*) FILTER (n < 5) > 0 THEN 'warn' ELSE 'ok' END FROM s"""


@query(_ARRIVAL)
def r1_r5_arrival(spark: SparkSession, sf: str) -> DataFrame:
    """All events; days that are missing or thin are tested on a small table."""
    from datetime import timedelta

    e = read(spark, sf, "events").select(F.to_date("ts").alias("d"))
    as_of = e.agg(F.max("d")).first()[0] + timedelta(10)
    found = arrival.check_arrival(e, "events", "d", "daily", 3, 5, as_of)
    return spark.createDataFrame([(x.kind, x.metric, x.status) for x in found], "kind string, metric double, status string")


_RESULTS = "SELECT DISTINCT o_orderdate::DATE AS run_at, 'm' || o_orderpriority[1] AS monitor, 'orders' AS table_name, NULL AS column_name, CASE WHEN o_totalprice > 200000 THEN 'breach' WHEN o_totalprice > 150000 THEN 'warn' ELSE 'ok' END AS status FROM orders"


@query(
    f"WITH r AS ({_RESULTS}), a AS (SELECT run_at, substr(sha256(table_name || '|' || monitor || '|' || coalesce(column_name, '') || '|' || status), 1, 16) AS alert_key, status AS severity FROM r WHERE status IN ('warn', 'breach')), "
    "log AS (SELECT * FROM a WHERE run_at < DATE '1996-01-01'), runs AS (SELECT DISTINCT run_at FROM log ORDER BY run_at DESC LIMIT 3), known AS (SELECT DISTINCT alert_key FROM log WHERE run_at IN (SELECT run_at FROM runs)) "
    "SELECT alert_key, any_value(severity) AS severity, bool_or(alert_key NOT IN (SELECT alert_key FROM known)) AS delivered FROM a WHERE run_at >= DATE '1996-01-01' GROUP BY 1"
)
def l1_l3_alert_routing(spark: SparkSession, sf: str) -> DataFrame:
    price = F.col("o_totalprice")
    results = read(spark, sf, "orders").select(
        F.to_date("o_orderdate").alias("run_at"), F.concat(F.lit("m"), F.substring("o_orderpriority", 1, 1)).alias("monitor"), F.lit("orders").alias("table_name"), F.lit(None).cast("string").alias("column_name"),
        F.when(price > 200000, "breach").when(price > 150000, "warn").otherwise("ok").alias("status"), F.lit("").alias("detail"), F.lit(0.0).alias("metric"), F.lit(0.0).alias("baseline_median"), F.lit("row_count").alias("kind"),
    ).distinct()
    found = alerts.from_results(results)
    cut = F.lit("1996-01-01").cast("date")
    fresh, known = alerts.route(found.filter(F.col("run_at") >= cut), found.filter(F.col("run_at") < cut))
    return fresh.select("alert_key", "severity", "delivered").unionByName(known.select("alert_key", "severity").distinct().withColumn("delivered", F.lit(False)))


@query("SELECT 'enum_drift' AS kind, 'lang' AS column_name, count(DISTINCT lang) AS new_values FROM documents WHERE lang NOT IN ('en', 'de')")
def d2_d9_enum_drift(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    c = contracts.Contract("documents", 1, "data-platform", tuple(contracts.Field(f.name, f.dataType.simpleString()) for f in docs.schema), (), ({"column": "lang", "known_values": ["en", "de"]},))
    seen = drift.observe(docs, docs.schema, "documents", [1], [], None, ["lang"])
    found = drift.detect(seen, c, date(2030, 1, 1), [])
    return spark.createDataFrame([(f.kind, f.evidence["column"], len(f.evidence["new_values"])) for f in found], "kind string, column_name string, new_values bigint")


@query(
    "WITH n AS (SELECT ticker, count(*) AS n FROM (SELECT p_brand AS ticker, l_shipdate::DATE AS d FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) GROUP BY 1), f AS (SELECT ticker, n, unnest(range(5)) AS fold, (n - 257) // 5 AS size FROM n WHERE (n - 257) // 5 >= 20) "
    "SELECT ticker, fold, 252 + fold * size AS train_end, 257 + fold * size AS test_start, CASE WHEN fold = 4 THEN n ELSE 257 + (fold + 1) * size END AS test_end FROM f"
)
def x1_walk_forward_folds(spark: SparkSession, sf: str) -> DataFrame:
    n = bars(spark, sf).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))
    found = []
    for ticker, rows in n.collect():  # one number for each brand
        try:
            found += [(ticker, f.index, f.train_end, f.test_start, f.test_end) for f in forecast.folds(rows)]
        except ValueError:  # too short a series
            continue
    return spark.createDataFrame(found, "ticker string, fold bigint, train_end bigint, test_start bigint, test_end bigint")


# -- the store, the pipeline, streams: rows only ----------------------------------------------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one where that is unset, as in tests."""
    import tempfile
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}" if shared else tempfile.mkdtemp(prefix=f"{name}-")


def _lake(spark: SparkSession):
    from .session import prepare
    from .sources.store import Lakehouse

    return Lakehouse(prepare(spark), _folder(spark, "warehouse"))


def _order_table(spark: SparkSession, sf: str):
    """A lakehouse with the orders in two appends, a renamed and a widened column between them."""
    from pyspark.sql import types as T

    from .schema import Partition, TableDef, with_ids

    lake = _lake(spark)
    schema = T.StructType.fromDDL("o_orderkey bigint, o_status string, o_year int, o_date date")
    lake.create_table(TableDef("bronze.orders", with_ids(schema)[0], Partition("o_date", "month")))
    o = read(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("o_status"), F.year("o_orderdate").alias("o_year"), F.trunc("o_orderdate", "year").alias("o_date"))
    lake.append("bronze.orders", o.filter("o_orderkey % 2 = 0"))
    lake.rename_column("bronze.orders", "o_status", "o_state")
    lake.widen_column("bronze.orders", "o_year")
    lake.add_column("bronze.orders", "o_note", "string")
    lake.append("bronze.orders", o.filter("o_orderkey % 2 = 1").withColumnRenamed("o_status", "o_state").withColumn("o_note", F.lit("new")))
    return lake


@query("SELECT o_orderkey, o_orderstatus AS o_state, year(o_orderdate) AS o_year, CASE WHEN o_orderkey % 2 = 1 THEN 'new' END AS o_note FROM orders")
def s1_s21_evolved_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Old files read under new names and types."""
    return _order_table(spark, sf).scan("bronze.orders").drop("o_date")


@query("SELECT o_orderkey, o_orderstatus AS o_status FROM orders WHERE o_orderkey % 2 = 0")
def s2_time_travel(spark: SparkSession, sf: str) -> DataFrame:
    lake = _order_table(spark, sf)
    return lake.scan("bronze.orders", lake.snapshots("bronze.orders")[0]).select("o_orderkey", "o_status")


@query("SELECT 1::BIGINT AS _snapshot_id, o_orderstatus AS o_state, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL UNION ALL SELECT 2, o_orderstatus, count(*) FROM orders GROUP BY ALL")
def s23_cross_version(spark: SparkSession, sf: str) -> DataFrame:
    return _order_table(spark, sf).cross_version("bronze.orders").groupBy("_snapshot_id", "o_state").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'append' AS operation, count(*) FILTER (o_orderkey % 2 = 0) AS added, count(*) FILTER (o_orderkey % 2 = 0) AS total FROM orders UNION ALL SELECT 'append', count(*) FILTER (o_orderkey % 2 = 1), count(*) FROM orders UNION ALL SELECT 'overwrite', count(*), count(*) FROM orders UNION ALL SELECT 'replace', count(*), count(*) FROM orders")
def s10_s16_snapshot_log(spark: SparkSession, sf: str) -> DataFrame:
    """An upsert and a compaction keep the rows."""
    lake = _order_table(spark, sf)
    lake.merge_upsert("bronze.orders", lake.scan("bronze.orders").filter("o_orderkey < 100").withColumn("o_note", F.lit("merged")), "o_orderkey")
    lake.compact("bronze.orders")
    rows = [(d["operation"], d["added_records"], d["total_records"]) for d in lake.snapshot_details("bronze.orders")]
    return spark.createDataFrame(rows, "operation string, added bigint, total bigint")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 1")
def s18_incremental(spark: SparkSession, sf: str) -> DataFrame:
    lake = _order_table(spark, sf)
    return lake.incremental("bronze.orders", *lake.snapshots("bronze.orders")[:2]).select("o_orderkey")


@query()
def k1_k11_medallion(spark: SparkSession, sf: str) -> DataFrame:
    """Bronze to Gold on generated feeds: S26-S28, K1-K7, K11; returns the training set."""
    from .plans import bronze, gold, silver

    lake = _lake(spark)
    bronze.ingest_all(lake, 20_000)
    silver.build_all(lake)
    gold.build_all(lake)
    return lake.scan("gold.forecast_training_set")


@query()
def d11_q1_agent_report(spark: SparkSession, sf: str) -> DataFrame:
    """An operations run after drift, and its report's verdict: D1-D12, M9-M12, Q1-Q5."""
    from .plans import bronze, operations
    from .sources.store import evolve, inject_collapse

    lake = _lake(spark)
    bronze.ingest_all(lake, 2000)
    list(evolve(lake))
    inject_collapse(lake)
    judged = operations.run_agent(lake, date(2026, 6, 30))
    day = report.load_day(lake, date(2026, 6, 30))
    rows = [(f.table, f.kind, f.evidence.get("column"), s, report.verdict(day)) for f, s, _ in judged]
    return spark.createDataFrame(rows, "table_name string, kind string, column_name string, severity string, verdict string")


@query()
def x2_x6_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Walk-forward predictions of the brands with a long enough series."""
    return forecast.predict(features.training_set(features.price_features(bars(spark, sf), ahead=5), None, spend(spark, sf)))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts)::VARCHAR AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def streaming_windowed_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Structured Streaming over the events: tumbling windows with a watermark, run to the end of what is there.

    Each micro-batch writes the windows that it changed into a folder of its own, again if it is repeated; the last one counts.
    """
    from .streaming.ingest import windowed_counts

    folder = _folder(spark, "windows")
    stream = spark.readStream.schema(read(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*")
    counts = windowed_counts(stream, "ts", "1 day", "1 day", "event_type")

    def keep(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/counts/batch={batch_id}")

    q = counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    written = spark.read.schema(counts.schema.add("batch", "long")).parquet(f"{folder}/counts")
    last = written.groupBy("window_start", "event_type").agg(F.max_by("n", "batch").alias("n"))
    return last.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n")
