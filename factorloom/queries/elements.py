"""Elementwise operators, arithmetic and scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import books
from ..plans import compiler
from .base import dense, dense_sql, rounded, sql_round

_NULLSAFE = "CASE WHEN open IS NOT NULL AND close IS NOT NULL THEN {f}(open, close) END"
_OPS: dict[str, tuple[str, str, int]] = {
    "abs": ("Abs($close-1500)", "abs(close - 1500)", 4),
    "log": ("Log($volume-30)", "CASE WHEN volume - 30 > 0 THEN ln(volume - 30) END", 6),
    "sign": ("Sign($close-$open)", "sign(close - open)", 1),
    "greater": ("Greater($open,$close)", _NULLSAFE.format(f="greatest"), 4),
    "less": ("Less($open,$close)", _NULLSAFE.format(f="least"), 4),
    "power": ("Power($close,0.5)", "pow(close, 0.5)", 4),
    "if": ("If($close-$open,$high,$low)", "CASE WHEN close - open > 0 THEN high ELSE low END", 4),
    "arith": ("-($high-$low)*2/($volume-40)+1", "CASE WHEN volume - 40 <> 0 THEN -(high - low) * 2 / (volume - 40) + 1 END", 4),
    "less_infinite": ("Less(1/($volume-40),5)", "CASE WHEN volume - 40 = 0 THEN 5 ELSE CASE WHEN volume IS NOT NULL THEN least(1 / (volume - 40), 5) END END", 6),
}


def _register(name: str, formula: str, value: str, digits: int) -> None:
    @query(f"op_{name}", f"{dense_sql('supp_week')} SELECT instrument, dt, {sql_round(value, digits)} AS value FROM d")
    def op(spark, sf_dir):
        return compiler.evaluate(dense(spark, sf_dir, "supp_week"), formula).withColumn("value", rounded(F.col("value"), digits))


for _name, _spec in _OPS.items():
    _register(_name, *_spec)


@query(
    "label_forward_return",
    f"{dense_sql('supp_week')} SELECT instrument, dt, {sql_round('lead(close, 6) OVER o / lead(close, 1) OVER o - 1', 6)} AS y FROM d WINDOW o AS (PARTITION BY instrument ORDER BY pos)",
)
def label_forward_return(spark, sf_dir):
    return dense(spark, sf_dir, "supp_week").select("instrument", "dt", rounded(compiler.label(F.col("close"), 5), 6).alias("y"))


@query(
    "tradability",
    f"""{dense_sql('supp_week')}, r AS (SELECT *, close / lag(close, 1) OVER (PARTITION BY instrument ORDER BY pos) - 1 AS ret FROM d)
SELECT instrument, dt, volume IS NULL OR volume <= 0 AS suspended, coalesce(ret >= 0.09, false) AS limit_up, coalesce(ret <= -0.09, false) AS limit_down FROM r""",
)
def tradability(spark, sf_dir):
    return books.tradability(dense(spark, sf_dir, "supp_week"))


@query("stamp_duty", "SELECT o_orderkey, CAST(CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 0.001 ELSE 0.0005 END AS DOUBLE) AS stamp FROM orders")
def stamp_duty(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select("o_orderkey", books.stamp_on_sale(F.to_date("o_orderdate"), "1998-01-01", 0.001, 0.0005).alias("stamp"))
