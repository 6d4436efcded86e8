"""One query for each rolling operator, over the weekly supplier panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..plans import compiler
from .base import dense, dense_sql, rounded, sql_round

_W = 8
_FRAME = f"PARTITION BY instrument ORDER BY pos ROWS BETWEEN {_W - 1} PRECEDING AND CURRENT ROW"
_PAIR = "CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN x END"
_TEXT = f"""SELECT instrument, dt, {{value}} AS value FROM (
  SELECT *, list(x) OVER w AS every, list(x) FILTER (WHERE x IS NOT NULL) OVER w AS seen, count(x) OVER w AS n, count(*) OVER w AS rows,
    min(x) OVER w AS lo, max(x) OVER w AS hi, avg(x) OVER w AS mean, {{window}} AS v
  FROM (SELECT instrument, dt, pos, close AS x, CASE WHEN volume + 1 > 0 THEN ln(volume + 1) END AS y FROM d)
  WINDOW w AS ({_FRAME}), o AS (PARTITION BY instrument ORDER BY pos), u AS (PARTITION BY instrument ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

_X, _Y = "$close", "Log($volume+1)"
_MP = max(2, _W // 2)
#: operator: formula, window expression, value over the window's columns, digits
_OPS: dict[str, tuple[str, str, str, int]] = {
    "ref": (f"Ref({_X},3)", "lag(x, 3) OVER o", "v", 4),
    "delta": (f"Delta({_X},{_W})", f"x - lag(x, {_W}) OVER o", "v", 4),
    "mean": (f"Mean({_X},{_W})", "avg(x) OVER w", "", 4),
    "sum": (f"Sum({_X},{_W})", "sum(x) OVER w", "", 3),
    "std": (f"Std({_X},{_W})", "stddev_samp(x) OVER w", "", 4),
    "var": (f"Var({_X},{_W})", "var_samp(x) OVER w", "", 2),
    "max": (f"Max({_X},{_W})", "max(x) OVER w", "", 4),
    "min": (f"Min({_X},{_W})", "min(x) OVER w", "", 4),
    "med": (f"Med({_X},{_W})", "quantile_cont(x, 0.5::DOUBLE) OVER w", "", 4),
    "quantile": (f"Quantile({_X},{_W},0.25)", "quantile_cont(x, 0.25::DOUBLE) OVER w", "", 4),
    "skew": (f"Skew({_X},{_W})", "skewness(x) OVER w", "", 5),
    "kurt": (f"Kurt({_X},{_W})", "kurtosis(x) OVER w", "", 5),
    "slope": (f"Slope({_X},{_W})", "regr_slope(x, pos) OVER w", "", 4),
    "rsquare": (f"Rsquare({_X},{_W})", "regr_r2(x, pos) OVER w", f"CASE WHEN n >= {_MP} AND lo < hi THEN v END", 6),
    "resi": (
        f"Resi({_X},{_W})",
        "last_value(x IGNORE NULLS) OVER w - (regr_intercept(x, pos) OVER w + regr_slope(x, pos) OVER w * last_value(CASE WHEN x IS NOT NULL THEN pos END IGNORE NULLS) OVER w)",
        "",
        4,
    ),
    "corr": (f"Corr({_X},{_Y},{_W})", f"CASE WHEN count({_PAIR}) OVER w >= {_MP} AND stddev_samp({_PAIR}) OVER w > 0 AND stddev_samp(CASE WHEN x IS NOT NULL THEN y END) OVER w > 0 THEN corr(x, y) OVER w END", "v", 6),
    "cov": (f"Cov({_X},{_Y},{_W})", f"CASE WHEN count({_PAIR}) OVER w >= {_MP} THEN covar_samp(x, y) OVER w END", "v", 4),
    "mad": (f"Mad({_X},{_W})", "NULL", f"CASE WHEN n >= {_MP} THEN list_sum(list_transform(seen, lambda e: abs(e - mean))) / n END", 4),
    "wma": (f"WMA({_X},{_W})", "NULL", f"CASE WHEN n >= {_MP} THEN list_sum(list_transform(every, lambda e, i: coalesce(e, 0) * i)) / (rows * (rows + 1) / 2) END", 4),
    "rank": (
        f"Rank({_X},{_W})",
        "NULL",
        f"CASE WHEN n >= {_MP} AND x IS NOT NULL THEN (len(list_filter(seen, lambda e: e < x)) + (len(list_filter(seen, lambda e: e = x)) + 1) / 2.0::DOUBLE) / n END",
        6,
    ),
    "idxmax": (f"IdxMax({_X},{_W})", "NULL", f"CASE WHEN n >= {_MP} THEN list_position(every, hi) - 1 END", 1),
    "idxmin": (f"IdxMin({_X},{_W})", "NULL", f"CASE WHEN n >= {_MP} THEN list_position(every, lo) - 1 END", 1),
    "ema": (
        f"EMA({_X},{_W})",
        "list({'p': pos, 'e': x}) FILTER (WHERE x IS NOT NULL) OVER u",
        f"CASE WHEN len(v) >= {_MP} THEN list_sum(list_transform(v, lambda s: s.e * pow(1 - 2.0 / {_W + 1}, pos - s.p))) / list_sum(list_transform(v, lambda s: pow(1 - 2.0 / {_W + 1}, pos - s.p))) END",
        4,
    ),
}


def _register(name: str, formula: str, window: str, value: str, digits: int) -> None:
    value = value or f"CASE WHEN n >= {_MP} THEN v END"

    sql = f"{dense_sql('supp_week')}\n{_TEXT.format(window=window, value=sql_round(value, digits))}"
    for label, engine in ((f"op_{name}", "columns"), (f"blocks_{name}", "blocks")):

        @query(label, sql)
        def op(spark, sf_dir, engine=engine):
            return compiler.evaluate(dense(spark, sf_dir, "supp_week"), formula, engine=engine).withColumn("value", rounded(F.col("value"), digits))


for _name, _spec in _OPS.items():
    _register(_name, *_spec)


@query(
    "op_nested",
    f"""{dense_sql('supp_week')}, a AS (SELECT instrument, dt, pos, close / nullif(lag(close, 1) OVER (PARTITION BY instrument ORDER BY pos), 0) - 1 AS r FROM d),
b AS (SELECT instrument, dt, pos, CASE WHEN count(r) OVER w >= 3 THEN stddev_samp(r) OVER w END AS s FROM a WINDOW w AS (PARTITION BY instrument ORDER BY pos ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))
SELECT instrument, dt, {sql_round('CASE WHEN count(s) OVER w >= 5 THEN avg(s) OVER w END', 6)} AS value FROM b WINDOW w AS (PARTITION BY instrument ORDER BY pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
)
def op_nested(spark, sf_dir):
    return compiler.evaluate(dense(spark, sf_dir, "supp_week"), "Mean(Std($close/Ref($close,1)-1,6),10)").withColumn("value", rounded(F.col("value"), 6))
