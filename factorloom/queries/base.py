"""SQL of the panels and small helpers that the query modules share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import written
from ..sources import panels


def rounded(x: Column, digits: int) -> Column:
    """Rounded, without negative zero. Engines break exact decimal ties differently; a bias far below the last digit moves
    them all to one side."""
    return F.round(x.cast("double") + F.lit(1.37 * 10.0 ** -(digits + 4)), digits) + F.lit(0.0)


def sql_round(x: str, digits: int) -> str:
    return f"round(CAST({x} AS DOUBLE) + {1.37 * 10.0 ** -(digits + 4)!r}, {digits}) + 0.0"


def _lineitem(key: str, unit: str) -> str:
    return f"""bars AS (
  SELECT instrument, dt, f.e / f.g AS open, high, low, amount / volume AS close, amount / volume AS vwap, volume, amount FROM (
    SELECT CAST({key} AS VARCHAR) AS instrument, CAST(date_trunc('{unit}', l_shipdate) AS DATE) AS dt,
      min({{'a': l_shipdate, 'b': l_orderkey, 'c': l_linenumber, 'd1': l_partkey, 'd2': l_suppkey, 'e': l_extendedprice, 'g': l_quantity}}) AS f,
      max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, sum(l_quantity) AS volume, sum(l_extendedprice) AS amount
    FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2))"""


_EVENTS = """bars AS (
  SELECT instrument, dt, open, high, low, close, amount / volume AS vwap, volume, amount FROM (
    SELECT CAST(user_id AS VARCHAR) AS instrument, CAST(ts AS DATE) AS dt, arg_min(value, {'t': ts, 'e': event_id}) AS open, max(value) AS high, min(value) AS low,
      arg_max(value, {'t': ts, 'e': event_id}) AS close, CAST(count(*) AS DOUBLE) AS volume, sum(value) AS amount
    FROM events GROUP BY 1, 2))"""

BARS = {"part_quarter": _lineitem("l_partkey", "quarter"), "supp_week": _lineitem("l_suppkey", "week"), "user_day": _EVENTS}
DENSE = """cal AS (SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS pos FROM (SELECT DISTINCT dt FROM bars)),
d AS (SELECT i.instrument, c.dt, c.pos, b.open, b.high, b.low, b.close, b.vwap, b.volume, b.amount
  FROM (SELECT DISTINCT instrument FROM bars) i CROSS JOIN cal c LEFT JOIN bars b ON b.instrument = i.instrument AND b.dt = c.dt)"""


def dense_sql(panel: str) -> str:
    return f"WITH {BARS[panel]},\n{DENSE}"


def bars(spark: SparkSession, sf_dir: str, panel: str) -> DataFrame:
    """Bars that are made once: the calendar, the grid and a benchmark read them again."""
    return written(getattr(panels, panel)(spark, sf_dir), panel)


def dense(spark: SparkSession, sf_dir: str, panel: str) -> DataFrame:
    return panels.densify(bars(spark, sf_dir, panel))


def sql_normal_cdf(x: str) -> str:
    """The standard normal distribution function by Simpson's rule over [0, x], |x| up to 9."""
    return (
        f"(0.5 + greatest(least({x}, 9), -9) * list_sum(list_transform(range(0, 1001), lambda i: (CASE WHEN i = 0 OR i = 1000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) "
        f"* exp(-pow(greatest(least({x}, 9), -9) * i / 1000.0, 2) / 2))) / 3000 / sqrt(2 * pi()))"
    )


def sql_normal_quantile(p: str) -> str:
    """Its inverse for p of at least one half: a rational approximation, relative error about 1e-9."""
    from ..functions.scalars import _LOW, _MIDDLE, _OUTER

    def poly(x: str, c: tuple[float, ...]) -> str:
        out = repr(c[0])
        for k in c[1:]:
            out = f"({out} * {x} + {k!r})"
        return out

    r, t = f"pow({p} - 0.5, 2)", f"sqrt(-2 * ln(1 - ({p})))"
    return f"CASE WHEN {p} <= {1 - _LOW!r} THEN ({p} - 0.5) * {poly(r, _MIDDLE[0])} / {poly(r, _MIDDLE[1])} ELSE -{poly(t, _OUTER[0])} / {poly(t, _OUTER[1])} END"


def sql_deflated(source: str, by: str = "") -> str:
    """CTEs m (strategy moments of `source`: [by, ]strategy, ret), g (trials and variance) and ds (n, sharpe, hurdle, dsr)."""
    on = f"USING ({by})" if by else "ON true"
    each = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    top = f"sqrt(greatest(var, 1e-12)) * ((1 - 0.5772156649) * ({sql_normal_quantile('(1 - 1 / greatest(trials, 2)::DOUBLE)')}) + 0.5772156649 * ({sql_normal_quantile('(1 - 1 / (greatest(trials, 2) * exp(1::DOUBLE)))')}))"
    return f"""dev AS (SELECT *, ret - avg(ret) OVER (PARTITION BY {each}strategy) AS e FROM {source} WHERE ret IS NOT NULL),
m AS (SELECT {each}strategy, count(*) AS n, avg(ret) AS mean, stddev_samp(ret) AS sd, avg(e*e*e) / nullif(pow(avg(e*e), 1.5), 0) AS skew, avg(e*e*e*e) / nullif(pow(avg(e*e), 2), 0) AS kurt FROM dev GROUP BY {each}strategy),
g AS (SELECT {each}count(*) AS trials, coalesce(var_pop(mean / nullif(sd, 0)), 0) AS var FROM m{group}),
hu AS (SELECT m.*, mean / nullif(sd, 0) AS sharpe, {top} AS hurdle FROM m JOIN g {on}),
zs AS (SELECT *, (sharpe - hurdle) * sqrt(n - 1) / sqrt(greatest(1 - coalesce(skew, 0) * sharpe + (coalesce(kurt, 3) - 1) / 4 * sharpe * sharpe, 1e-12)) AS z FROM hu),
ds AS (SELECT {each}strategy, n, sharpe, hurdle, CASE WHEN n >= 20 AND sd > 0 THEN {sql_normal_cdf('z')} ELSE 0 END AS dsr FROM zs)"""
