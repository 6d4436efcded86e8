"""Bars, dense panels, membership, calendars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..sources import ingest, panels
from .base import BARS, dense, dense_sql, rounded, sql_round

_FIELDS = {"open": 4, "high": 4, "low": 4, "close": 4, "vwap": 4, "volume": 2, "amount": 2}


def _register(name: str) -> None:
    columns = ", ".join(f"{sql_round(c, k)} AS {c}" for c, k in _FIELDS.items())

    @query(f"panel_{name}", f"WITH {BARS[name]} SELECT instrument, dt, {columns} FROM bars")
    def bars(spark, sf_dir):
        return getattr(panels, name)(spark, sf_dir).select("instrument", "dt", *[rounded(F.col(c), k).alias(c) for c, k in _FIELDS.items()])


for _name in BARS:
    _register(_name)


@query("panel_dense", f"{dense_sql('supp_week')} SELECT instrument, dt, pos, {sql_round('close', 4)} AS close FROM d")
def panel_dense(spark, sf_dir):
    return dense(spark, sf_dir, "supp_week").select("instrument", "dt", F.col("pos").cast("long").alias("pos"), rounded(F.col("close"), 4).alias("close"))


@query(
    "universe_names",
    f"WITH {BARS['supp_week']}, m AS (SELECT instrument, min(dt) AS a, max(dt) AS z FROM bars GROUP BY 1) SELECT DISTINCT instrument FROM m WHERE a <= DATE '1996-03-01' AND z >= DATE '1996-01-01'",
)
def universe_names(spark, sf_dir):
    members = panels.members(panels.supp_week(spark, sf_dir))
    return panels.universe(members, F.lit("1996-01-01").cast("date"), F.lit("1996-03-01").cast("date"))


@query(
    "adv_panel",
    f"{dense_sql('supp_week')} SELECT instrument, dt, {sql_round('CASE WHEN count(close*volume) OVER w = 20 THEN avg(close*volume) OVER w END', 2)} AS adv FROM d WINDOW w AS (PARTITION BY instrument ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)",
)
def adv_panel(spark, sf_dir):
    return panels.average_dollar_volume(dense(spark, sf_dir, "supp_week")).select("instrument", "dt", rounded(F.col("adv"), 2).alias("adv"))


@query("benchmark_close", f"WITH {BARS['supp_week']} SELECT dt, {sql_round('avg(close)', 4)} AS close FROM bars GROUP BY dt")
def benchmark_close(spark, sf_dir):
    return panels.benchmark(panels.supp_week(spark, sf_dir)).select("dt", rounded(F.col("close"), 4).alias("close"))


@query("last_date", f"WITH {BARS['supp_week']} SELECT max(dt) AS last_date FROM bars")
def last_date(spark, sf_dir):
    return panels.last_date(panels.supp_week(spark, sf_dir))


@query(
    "next_session",
    f"""WITH {BARS['supp_week']}, c AS (SELECT dt, row_number() OVER (ORDER BY dt) AS p FROM (SELECT DISTINCT dt FROM bars))
SELECT a.dt AS signal_date, b.dt AS trade_date, e.dt AS end_date FROM c a JOIN c b ON b.p = a.p + 1 LEFT JOIN c e ON e.p = a.p + 6""",
)
def next_session(spark, sf_dir):
    return panels.sessions_after(panels.supp_week(spark, sf_dir), 5)


@query(
    "ingest_audit",
    f"""WITH {BARS['user_day']} SELECT instrument, count(*) AS n_rows, count(*) - count(DISTINCT dt) AS duplicate_dates,
count_if(NOT (open > 0 AND high > 0 AND low > 0 AND close > 0)) AS non_positive, count_if(high < low) AS high_below_low FROM bars GROUP BY 1""",
)
def ingest_audit(spark, sf_dir):
    return ingest.audit(panels.user_day(spark, sf_dir))
