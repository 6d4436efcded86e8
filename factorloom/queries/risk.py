"""Style exposures and regimes over the weekly supplier panel, with windows that fit it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import risk
from ..sources import panels
from .base import bars, dense_sql, rounded, sql_round

_BASE = f"""{dense_sql('supp_week')}, bm AS (SELECT dt, avg(close) AS b FROM bars GROUP BY dt), br AS (SELECT dt, b, b / lag(b) OVER (ORDER BY dt) - 1 AS bench FROM bm),
r AS (SELECT d.instrument, d.dt, d.pos, d.close, d.volume, d.close / lag(d.close) OVER (PARTITION BY d.instrument ORDER BY d.pos) - 1 AS ret, br.bench FROM d LEFT JOIN br ON br.dt = d.dt)"""
_OVER = "(PARTITION BY instrument ORDER BY pos ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"


def _full(x: str, w: int, value: str) -> str:
    o = _OVER.format(n=w - 1)
    return f"CASE WHEN count({x}) OVER {o} = {w} THEN {value.format(o=o)} END"


_LAG = "lag(close, {k}) OVER (PARTITION BY instrument ORDER BY pos)"
_PAIR = "CASE WHEN bench IS NOT NULL THEN ret END"
_STYLE = {
    "beta": f"CASE WHEN count({_PAIR}) OVER {_OVER.format(n=7)} = 8 THEN covar_samp({_PAIR}, bench) OVER {_OVER.format(n=7)} / nullif(var_samp(bench) OVER {_OVER.format(n=7)}, 0) END",
    "size": _full("close * volume", 4, "ln(avg(close * volume) OVER {o})"),
    "volatility": _full("ret", 6, "stddev_samp(ret) OVER {o}"),
    "momentum": f"{_LAG.format(k=4)} / {_LAG.format(k=8)} - 1",
    "turnover": f"({_full('volume', 4, 'avg(volume) OVER {o}')}) / ({_full('volume', 8, 'avg(volume) OVER {o}')})",
}


def exposed(spark, sf_dir):
    made = bars(spark, sf_dir, "supp_week")
    return risk.exposures(panels.densify(made), panels.benchmark(made), beta=8, size=4, vol=6, slow=8, fast=4)


@query("exposures_all", f"{_BASE} SELECT instrument, dt, {', '.join(f'{sql_round(v, 5)} AS {k}' for k, v in _STYLE.items())} FROM r")
def exposures_all(spark, sf_dir):
    return exposed(spark, sf_dir).select("instrument", "dt", *[rounded(F.col(c), 5).alias(c) for c in _STYLE])


_Z = f"""{_BASE}, e AS (SELECT instrument, dt, pos, ret, bench, {', '.join(f'{v} AS {k}' for k, v in _STYLE.items())} FROM r),
z AS (SELECT *, coalesce(greatest(least((beta - avg(beta) OVER (PARTITION BY dt)) / nullif(stddev_samp(beta) OVER (PARTITION BY dt), 0), 3), -3), 0) AS z_beta FROM e)"""


@query("exposures_z", f"{_Z} SELECT instrument, dt, {sql_round('z_beta', 5)} AS z_beta FROM z")
def exposures_z(spark, sf_dir):
    return risk.zscored(exposed(spark, sf_dir), ("beta",)).select("instrument", "dt", rounded(F.col("z_beta"), 5).alias("z_beta"))


@query(
    "neutralise_one",
    f"""{_Z}, n AS (SELECT instrument, dt, momentum AS alpha, z_beta, CASE WHEN momentum IS NOT NULL THEN z_beta END AS x FROM z)
SELECT instrument, dt, {sql_round('CASE WHEN count(alpha) OVER w >= 30 THEN alpha - avg(alpha) OVER w - coalesce(CASE WHEN var_pop(x) OVER w > 1e-18 THEN covar_pop(x, alpha) OVER w / var_pop(x) OVER w END, 0) * (z_beta - avg(x) OVER w) ELSE alpha END', 5)} AS alpha FROM n WINDOW w AS (PARTITION BY dt)""",
)
def neutralise_one(spark, sf_dir):
    z = risk.zscored(exposed(spark, sf_dir), ("beta",)).withColumn("alpha", F.col("momentum"))
    return risk.neutralise_one(z).withColumn("alpha", rounded(F.col("alpha"), 5))


def _fit_sql(target: str, names: tuple[str, ...]) -> str:
    """CTEs up to o (instrument, dt, y, rest, n): the normal equations' residual by orthogonal columns of each date."""
    z = {k: f"coalesce(greatest(least(({k} - avg({k}) OVER (PARTITION BY dt)) / nullif(stddev_samp({k}) OVER (PARTITION BY dt), 0), 3), -3), 0)" for k in names}
    ctes = [f"{_Z}, o0 AS (SELECT instrument, dt, {target} AS y, {', '.join(f'{v} AS z{i}' for i, v in enumerate(z.values()))} FROM e)"]
    ctes.append(f"a0 AS (SELECT instrument, dt, y, count(y) OVER d AS n, y - avg(y) OVER d AS rest, {', '.join(f'CASE WHEN y IS NOT NULL THEN z{i} - avg(CASE WHEN y IS NOT NULL THEN z{i} END) OVER d END AS q{i}' for i in range(len(names)))} FROM o0 WINDOW d AS (PARTITION BY dt))")
    for i in range(len(names)):
        share = lambda x: f"coalesce(sum({x} * q{i}) OVER d / nullif(CASE WHEN sum(q{i} * q{i}) OVER d > 1e-9 THEN sum(q{i} * q{i}) OVER d END, 0), 0) * q{i}"  # noqa: E731, B023
        later = [f"q{j} - {share(f'q{j}')} AS q{j}" for j in range(i + 1, len(names))]
        ctes.append(f"a{i + 1} AS (SELECT instrument, dt, y, n, rest - {share('rest')} AS rest{''.join(', ' + x for x in later)} FROM a{i} WINDOW d AS (PARTITION BY dt))")
    return ", ".join(ctes)


@query("neutralise", f"{_fit_sql('momentum', tuple(_STYLE))} SELECT instrument, dt, {sql_round('CASE WHEN n >= 30 AND y IS NOT NULL THEN rest ELSE y END', 5)} AS alpha FROM a5")
def neutralise(spark, sf_dir):
    """Least squares on all styles by date."""
    return risk.neutralise(risk.zscored(exposed(spark, sf_dir)).withColumn("alpha", F.col("momentum"))).withColumn("alpha", rounded(F.col("alpha"), 5))


@query("specific_vol", f"{_Z}, s AS (SELECT instrument, dt, pos, ret - beta * bench AS rest FROM z) SELECT instrument, dt, {sql_round(_full('rest', 4, 'stddev_samp(rest) OVER {o}'), 5)} AS specific FROM s")
def specific_vol(spark, sf_dir):
    return risk.specific_volatility(exposed(spark, sf_dir), 4).withColumn("specific", rounded(F.col("specific"), 5))


@query(
    "crowding_r2",
    f"""{_fit_sql('turnover', tuple(_STYLE)[:4])}, r2 AS (SELECT dt, CASE WHEN max(n) >= 50 AND var_pop(y) > 0 THEN 1 - avg(rest * rest) / nullif(var_pop(y), 0) END AS r2 FROM a4 GROUP BY dt)
SELECT dt, {sql_round('r2', 5)} AS r2, {sql_round('CASE WHEN count(r2) OVER w = 5 THEN avg(r2) OVER w END', 5)} AS smoothed FROM r2 WINDOW w AS (ORDER BY dt ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
)
def crowding_r2(spark, sf_dir):
    """How much of turnover the styles explain by date."""
    return risk.crowding(risk.zscored(exposed(spark, sf_dir)), smooth=5).select("dt", rounded(F.col("r2"), 5).alias("r2"), rounded(F.col("smoothed"), 5).alias("smoothed"))


_REGIME = f"""{_BASE}, g AS (SELECT dt, b, bench AS ret, CASE WHEN count(b) OVER t = 20 THEN avg(b) OVER t END AS m, CASE WHEN count(bench) OVER v = 10 THEN stddev_samp(bench) OVER v END AS sd FROM br WINDOW t AS (ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), v AS (ORDER BY dt ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
h AS (SELECT *, CASE WHEN count(sd) OVER u >= 30 THEN quantile_cont(sd, 0.5::DOUBLE) OVER u END AS usual FROM g WINDOW u AS (ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
l AS (SELECT dt, ret, CASE WHEN b > m THEN 'up-trend' ELSE 'down-trend' END AS trend, CASE WHEN sd > usual THEN 'high-vol' ELSE 'low-vol' END AS vol FROM h)"""


def _labels(spark, sf_dir):
    return risk.regimes(panels.benchmark(panels.supp_week(spark, sf_dir)), 20, 10, 30)


@query("regimes", f"{_REGIME} SELECT dt, trend, vol FROM l")
def regimes(spark, sf_dir):
    return _labels(spark, sf_dir).select("dt", "trend", "vol")


@query(
    "regime_breakdown",
    f"""{_REGIME}, u AS (SELECT trend AS regime, ret FROM l UNION ALL SELECT vol, ret FROM l) SELECT regime, count(ret) AS days, {sql_round('avg(ret) * 52', 6)} AS mean, {sql_round('avg(ret) / stddev_samp(ret) * sqrt(52)', 6)} AS ir FROM u GROUP BY regime""",
)
def regime_breakdown(spark, sf_dir):
    labels = _labels(spark, sf_dir)
    out = risk.regime_breakdown(labels.select("dt", "ret"), labels, 52)
    return out.select("regime", "days", rounded(F.col("mean"), 6).alias("mean"), rounded(F.col("ir"), 6).alias("ir"))
