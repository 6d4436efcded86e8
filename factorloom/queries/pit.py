"""Point-in-time queries: orders stand for filings (customer, priority, order date, known 45 days later, price)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import pit
from .base import rounded, sql_round

_ROWS = """WITH r AS (SELECT o_custkey AS key, o_orderpriority AS tag, CAST(o_orderdate AS DATE) AS period, CAST(o_orderdate + INTERVAL 45 DAY AS DATE) AS filed, o_totalprice AS value FROM orders)"""
_DAY = "DATE '1998-06-30'"
_DATES = "c AS (SELECT CAST(unnest(generate_series(DATE '1996-03-31', DATE '2001-03-31', INTERVAL 1 YEAR)) AS DATE) AS dt)"


def rows(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("tag"), F.to_date("o_orderdate").alias("period"), F.date_add(F.to_date("o_orderdate"), 45).alias("filed"), F.col("o_totalprice").alias("value"))


def _day():
    return F.lit("1998-06-30").cast("date")


@query(
    "pit_asof_date",
    f"{_ROWS} SELECT key, tag, {sql_round('value', 2)} AS value, period, filed FROM (SELECT *, row_number() OVER (PARTITION BY key, tag ORDER BY period DESC, filed DESC, value DESC) AS k FROM r WHERE filed <= {_DAY}) WHERE k = 1",
)
def pit_asof_date(spark, sf_dir):
    return pit.as_of(rows(spark, sf_dir), _day()).withColumn("value", rounded(F.col("value"), 2))


@query(
    "pit_latest_filed",
    f"{_ROWS} SELECT key, tag, {sql_round('value', 2)} AS value, period, filed FROM (SELECT *, row_number() OVER (PARTITION BY key, tag ORDER BY filed DESC, period DESC, value DESC) AS k FROM r WHERE filed <= {_DAY}) WHERE k = 1",
)
def pit_latest_filed(spark, sf_dir):
    return pit.latest_filed(rows(spark, sf_dir), _day()).withColumn("value", rounded(F.col("value"), 2))


@query(
    "pit_panel_ffill",
    f"""{_ROWS}, {_DATES}, one AS (SELECT key, tag, filed, arg_max(value, {{'p': period, 'v': value}}) AS value FROM r GROUP BY 1, 2, 3), g AS (SELECT DISTINCT key, tag FROM one)
SELECT g.key, g.tag, c.dt, {sql_round('o.value', 2)} AS value FROM (SELECT * FROM g, c) AS gc(key, tag, dt) JOIN g USING (key, tag) JOIN c USING (dt) ASOF JOIN one o ON o.key = gc.key AND o.tag = gc.tag AND o.filed <= gc.dt""",
)
def pit_panel_ffill(spark, sf_dir):
    dates = spark.sql("SELECT explode(sequence(DATE '1996-03-31', DATE '2001-03-31', INTERVAL 1 YEAR)) AS dt")
    return pit.panel(rows(spark, sf_dir), dates).select("key", "tag", "dt", rounded(F.col("value"), 2).alias("value"))


@query("pit_restatements", f"{_ROWS}, k AS (SELECT *, count(*) OVER (PARTITION BY key, tag, period) AS filings FROM r) SELECT key, tag, period, filed, {sql_round('value', 2)} AS value, filings FROM k WHERE filings > 1")
def pit_restatements(spark, sf_dir):
    return pit.restatements(rows(spark, sf_dir)).withColumn("value", rounded(F.col("value"), 2))


@query("reporting_lag", f"{_ROWS} SELECT key, tag, period, CAST(filed - period AS INTEGER) AS lag_days FROM r")
def reporting_lag(spark, sf_dir):
    return pit.reporting_lag(rows(spark, sf_dir)).select("key", "tag", "period", "lag_days")


@query(
    "qa_report",
    f"""{_ROWS}, q AS (SELECT tag, quantile_cont(value, 0.25::DOUBLE) AS a, quantile_cont(value, 0.5::DOUBLE) AS m, quantile_cont(value, 0.75::DOUBLE) AS z FROM r GROUP BY tag),
k AS (SELECT r.*, CAST(filed - period AS INTEGER) AS lag, CAST(count(*) OVER (PARTITION BY key, r.tag, period) > 1 AS INTEGER) AS restated, abs(value - m) > 20 * (z - a + 1e-9) AS far FROM r JOIN q ON q.tag = r.tag)
SELECT tag, count(*) AS n_rows, count(DISTINCT key) AS n_keys, CAST(quantile_cont(CAST(lag AS DOUBLE), 0.5::DOUBLE) AS DOUBLE) AS lag_median, CAST(quantile_cont(CAST(lag AS DOUBLE), 0.9::DOUBLE) AS DOUBLE) AS lag_p90, max(lag) AS lag_max,
  count_if(lag < 0) AS negative_lags, CAST(sum(restated) AS BIGINT) AS restated, count_if(far) AS outliers FROM k GROUP BY tag""",
)
def qa_report(spark, sf_dir):
    return pit.quality_report(rows(spark, sf_dir))


@query("delisting_first", f"{_ROWS} SELECT key, min(filed) AS delisted FROM r GROUP BY key")
def delisting_first(spark, sf_dir):
    return pit.delisting_calendar(rows(spark, sf_dir))


@query(
    "pit_coverage",
    f"{_ROWS}, one AS (SELECT DISTINCT key, tag FROM r WHERE filed <= {_DAY}) SELECT tag, {sql_round('count(*) / (SELECT count(DISTINCT key) FROM r)', 6)} AS coverage FROM one GROUP BY tag",
)
def pit_coverage(spark, sf_dir):
    r = rows(spark, sf_dir)
    known = pit.as_of(r, _day()).withColumn("dt", _day())
    return pit.coverage(known, r.select("key").distinct().count()).select("tag", rounded(F.col("coverage"), 6).alias("coverage"))


@query(
    "policy_asof",
    f"""WITH p AS (SELECT o_orderpriority AS series, CAST(year(o_orderdate) AS INTEGER) AS period, sum(o_totalprice) AS value, CAST(max(o_orderdate) + INTERVAL 90 DAY AS DATE) AS released FROM orders GROUP BY 1, 2)
SELECT series, period, {sql_round('value', 2)} AS value FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY period DESC, released DESC) AS k FROM p WHERE released <= {_DAY}) WHERE k = 1""",
)
def policy_asof(spark, sf_dir):
    from ..operators.derivatives import policy_as_of

    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    p = o.groupBy(F.col("o_orderpriority").alias("series"), F.year("o_orderdate").alias("period")).agg(F.sum("o_totalprice").alias("value"), F.date_add(F.to_date(F.max("o_orderdate")), 90).alias("released"))
    return policy_as_of(p, _day()).withColumn("value", rounded(F.col("value"), 2))


@query(
    "survivorship_diff",
    "SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS symbol FROM lineitem WHERE l_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-10-01')",
)
def survivorship_diff(spark, sf_dir):
    from ..operators.derivatives import vanished

    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").cast("string").alias("symbol"), "l_shipdate")
    return vanished(t, t.where(F.col("l_shipdate") >= F.lit("2001-10-01").cast("timestamp_ntz")))
