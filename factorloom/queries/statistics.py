"""Multiple-testing statistics over the long-short series of the quarterly factors and the weekly supplier returns."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..catalog import ORACLES, query
from ..operators import statistics as st
from ..operators.risk import returns
from ..runtime import written
from .base import dense, dense_sql, rounded, sql_deflated, sql_round
from .crosssection import _CORR, _FACTOR_SQL, _PCT, _RANKED

#: Every supplier is a strategy.
_RET_SQL = f"""{dense_sql('supp_week')}, a AS (SELECT instrument AS strategy, dt AS t, close / lag(close, 1) OVER (PARTITION BY instrument ORDER BY pos) - 1 AS ret FROM d),
s AS (SELECT * FROM a WHERE ret IS NOT NULL)"""


def all_strategies(spark, sf_dir):
    r = returns(dense(spark, sf_dir, "supp_week"))
    return r.select(F.col("instrument").alias("strategy"), F.col("dt").alias("t"), "ret").where("ret is not null")


@query(
    "tstat_sharpe",
    f"{_RET_SQL} SELECT strategy, {sql_round('avg(ret) / (stddev_samp(ret) / sqrt(count(ret)))', 6)} AS t, {sql_round('avg(ret) / stddev_samp(ret) * sqrt(52)', 6)} AS sharpe FROM s GROUP BY strategy",
)
def tstat_sharpe(spark, sf_dir, of=all_strategies):
    return of(spark, sf_dir).groupBy("strategy").agg(rounded(st.tstat(F.col("ret")), 6).alias("t"), rounded(st.sharpe(F.col("ret"), 52), 6).alias("sharpe"))


@query(
    "moments_for_dsr",
    f"""{_RET_SQL}, m AS (SELECT *, ret - avg(ret) OVER (PARTITION BY strategy) AS e FROM s)
SELECT strategy, count(*) AS n, {sql_round('avg(ret)', 6)} AS mean, {sql_round('stddev_samp(ret)', 6)} AS sd, {sql_round('avg(e*e*e) / pow(avg(e*e), 1.5)', 5)} AS skew, {sql_round('avg(e*e*e*e) / pow(avg(e*e), 2)', 5)} AS kurt FROM m GROUP BY strategy""",
)
def moments_for_dsr(spark, sf_dir, of=all_strategies):
    return st.moments(of(spark, sf_dir)).select("strategy", "n", *[rounded(F.col(c), k).alias(c) for c, k in (("mean", 6), ("sd", 6), ("skew", 5), ("kurt", 5))])


@query("deflated_sharpe", f"{_RET_SQL}, {sql_deflated('s')} SELECT strategy, n, {sql_round('sharpe', 6)} AS sharpe, {sql_round('hurdle', 6)} AS hurdle, {sql_round('dsr', 5)} AS dsr FROM ds")
def deflated_sharpe(spark, sf_dir):
    out = st.deflated_sharpe(all_strategies(spark, sf_dir))
    return out.select("strategy", "n", *[rounded(F.col(c), k).alias(c) for c, k in (("sharpe", 6), ("hurdle", 6), ("dsr", 5))])


@query(
    "nonoverlap",
    f"{_RET_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY t) - 1 AS k FROM s) SELECT strategy, t, {sql_round('ret', 6)} AS ret FROM k WHERE k % 5 = 0",
)
def nonoverlap(spark, sf_dir, of=all_strategies):
    return st.nonoverlapping(of(spark, sf_dir), 5, ["strategy"], "t").withColumn("ret", rounded(F.col("ret"), 6))


@query("autocorr", f"{_RET_SQL}, b AS (SELECT strategy, ret, lag(ret) OVER (PARTITION BY strategy ORDER BY t) AS b FROM s) SELECT strategy, {sql_round('corr(ret, b)', 6)} AS rho FROM b WHERE b IS NOT NULL GROUP BY strategy")
def autocorr(spark, sf_dir, of=all_strategies):
    return st.autocorrelation(of(spark, sf_dir)).withColumn("rho", rounded(F.col("rho"), 6))


@query(
    "newey_west",
    f"""{_RET_SQL}, e AS (SELECT strategy, t, ret, avg(ret) OVER (PARTITION BY strategy) AS m FROM s),
p AS (SELECT strategy, m, ret - m AS e, lag(ret - m, 1) OVER o AS e1, lag(ret - m, 2) OVER o AS e2, lag(ret - m, 3) OVER o AS e3 FROM e WINDOW o AS (PARTITION BY strategy ORDER BY t)),
g AS (SELECT strategy, count(*) AS n, first(m) AS mean, (sum(e*e) + 2 * (0.75 * sum(e*e1) + 0.5 * sum(e*e2) + 0.25 * sum(e*e3))) / count(*) AS lr FROM p GROUP BY strategy)
SELECT strategy, n, {sql_round('mean', 6)} AS mean, {sql_round('CASE WHEN lr > 0 THEN mean / sqrt(lr / n) END', 5)} AS t_nw FROM g""",
)
def newey_west(spark, sf_dir, of=all_strategies):
    return st.newey_west(of(spark, sf_dir), 3).select("strategy", "n", rounded(F.col("mean"), 6).alias("mean"), rounded(F.col("t_nw"), 5).alias("t_nw"))


@query("effective_breadth_pairs", f"{_RET_SQL} SELECT x.strategy AS a, y.strategy AS b, {sql_round('corr(x.ret, y.ret)', 6)} AS corr FROM s x JOIN s y ON x.t = y.t AND x.strategy < y.strategy GROUP BY 1, 2")
def effective_breadth_pairs(spark, sf_dir, of=all_strategies):
    return st.pair_correlations(of(spark, sf_dir)).withColumn("corr", rounded(F.col("corr"), 6))


@query(
    "log_wealth",
    f"""{_RET_SQL} SELECT strategy, count(*) AS n, {sql_round('avg(ret)', 6)} AS mean, {sql_round('CASE WHEN min(ret) > -1 THEN avg(ln(1 + ret)) END', 6)} AS log_growth,
{sql_round('CASE WHEN min(ret) > -1 THEN exp(avg(ln(1 + ret))) - 1 END', 6)} AS geometric, {sql_round('skewness(ret)', 5)} AS skew, min(ret) <= -1 AS ruined FROM s GROUP BY strategy""",
)
def log_wealth(spark, sf_dir, of=all_strategies):
    out = st.log_wealth(of(spark, sf_dir))
    return out.select("strategy", "n", *[rounded(F.col(c), k).alias(c) for c, k in (("mean", 6), ("log_growth", 6), ("geometric", 6), ("skew", 5))], "ruined")


@query(
    "cpcv",
    f"""{_RET_SQL}, k AS (SELECT strategy, ret, row_number() OVER (PARTITION BY strategy ORDER BY t) - 1 AS k, count(*) OVER (PARTITION BY strategy) AS n FROM s),
b AS (SELECT strategy, ret, list_sum([CAST(k >= floor(n * i / 8) AS INT) FOR i IN [1, 2, 3, 4, 5, 6, 7]]) AS b FROM k),
g AS (SELECT strategy, b, count(*) AS c, sum(ret) AS s, sum(ret * ret) AS ss FROM b GROUP BY 1, 2),
p AS (SELECT x.strategy, x.c + y.c AS c, x.s + y.s AS s, x.ss + y.ss AS ss FROM g x JOIN g y ON x.strategy = y.strategy AND x.b < y.b),
q AS (SELECT strategy, (s / c) / sqrt((ss - s * s / c) / (c - 1)) * sqrt(52) AS r FROM p)
SELECT strategy, count(r) AS paths, {sql_round('quantile_cont(r, 0.05::DOUBLE)', 5)} AS p05, {sql_round('quantile_cont(r, 0.5::DOUBLE)', 5)} AS p50, {sql_round('quantile_cont(r, 0.95::DOUBLE)', 5)} AS p95, {sql_round('avg(CAST(r < 0 AS INT))', 6)} AS p_negative FROM q GROUP BY strategy""",
)
def cpcv(spark, sf_dir, of=all_strategies):
    out = st.cpcv(of(spark, sf_dir), periods=52)
    return out.select("strategy", "paths", *[rounded(F.col(c), k).alias(c) for c, k in (("p05", 5), ("p50", 5), ("p95", 5), ("p_negative", 6))])


_PBO = f"""{_RET_SQL}, nr AS (SELECT s_nationkey AS strategy, t, avg(ret) AS ret FROM s JOIN supplier ON CAST(s_suppkey AS VARCHAR) = s.strategy GROUP BY 1, 2),
cv AS (SELECT strategy FROM nr GROUP BY strategy HAVING count(*) >= floor(0.8 * (SELECT count(DISTINCT t) FROM nr))), gd AS (SELECT nr.* FROM nr JOIN cv USING (strategy)),
wh AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS k, count(*) OVER () AS n FROM (SELECT t FROM gd GROUP BY t HAVING count(*) = (SELECT count(*) FROM cv))),
bl AS (SELECT strategy, k // (n // 8) AS b, count(*) AS c, sum(ret) AS s, sum(ret * ret) AS q FROM gd JOIN wh USING (t) WHERE k // (n // 8) < 8 GROUP BY 1, 2),
ms AS (SELECT m FROM (SELECT unnest(range(0, 256)) AS m) WHERE bit_count(m) = 4),
hv AS (SELECT m, strategy, (m >> b) & 1 AS side, sum(c) AS c, sum(s) AS s, sum(q) AS q FROM ms, bl GROUP BY 1, 2, 3),
ra AS (SELECT m, strategy, side, (s / c) / (sqrt(greatest(q - c * (s / c) * (s / c), 0) / (c - 1)) + 1e-12) AS r FROM hv),
bs AS (SELECT m, arg_max(strategy, {{'r': r, 'k': -strategy}}) AS strategy FROM ra WHERE side = 1 GROUP BY m),
rk AS (SELECT m, strategy, (rank() OVER (PARTITION BY m ORDER BY r) + (count(*) OVER (PARTITION BY m, r) - 1) / 2.0::DOUBLE) / (count(*) OVER (PARTITION BY m) + 1) AS w FROM ra WHERE side = 0)
SELECT {sql_round('avg(CAST(w <= 0.5 AS INT))', 6)} AS pbo FROM rk JOIN bs USING (m, strategy)"""


@query("overfitting_probability", _PBO)
def overfitting_probability(spark, sf_dir):
    """All choices of half of eight blocks. Suppliers share no week, so a strategy holds all suppliers of a nation in equal
    parts."""
    nation = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("strategy"), F.col("s_nationkey").alias("nation"))
    held = all_strategies(spark, sf_dir).join(nation, "strategy").groupBy(F.col("nation").alias("strategy"), "t").agg(F.avg("ret").alias("ret"))
    p = st.overfitting_probability(held, blocks=8)
    return spark.createDataFrame([(float(p),)], "pbo double").select(rounded(F.col("pbo"), 6).alias("pbo"))


@query(
    "average_correlation",
    f"""{_RET_SQL}, en AS (SELECT strategy FROM s GROUP BY strategy HAVING count(*) >= 30 AND stddev_samp(ret) > 0), kp AS (SELECT s.* FROM s JOIN en USING (strategy)),
pr AS (SELECT x.strategy AS a, y.strategy AS b, corr(x.ret, y.ret) AS c FROM kp x JOIN kp y ON x.t = y.t AND x.strategy < y.strategy GROUP BY 1, 2),
av AS (SELECT (SELECT count(DISTINCT k) FROM (SELECT a AS k FROM pr UNION ALL SELECT b FROM pr)) AS n, sum(abs(CASE WHEN isnan(c) THEN 0 ELSE coalesce(c, 0) END)) AS total FROM pr)
SELECT n AS n_raw, {sql_round('total / (n * (n - 1) / 2)', 5)} AS mean_abs_corr, {sql_round('n / (1 + (n - 1) * total / (n * (n - 1) / 2))', 4)} AS n_eff_avg_corr FROM av""",
)
def average_correlation(spark, sf_dir):
    out = st.average_correlation(all_strategies(spark, sf_dir))
    return out.select("n_raw", rounded(F.col("mean_abs_corr"), 5).alias("mean_abs_corr"), rounded(F.col("n_eff_avg_corr"), 4).alias("n_eff_avg_corr"))


@query("effective_trials")
def effective_trials(spark, sf_dir):
    """Eigenvalues of the correlation matrix; no SQL."""
    held = written(all_strategies(spark, sf_dir), "returns")
    found = st.effective_trials(held) | st.effective_breadth(held)
    return spark.createDataFrame([(k, float(v)) for k, v in sorted(found.items())], "measure string, value double")


@query(
    "evaluate_series",
    f"""{dense_sql('supp_week')}, z AS (SELECT instrument AS strategy, pos, close / lag(close, 1) OVER o - 1 AS signal, lead(close, 2) OVER o / lead(close, 1) OVER o - 1 AS fwd FROM d WINDOW o AS (PARTITION BY instrument ORDER BY pos)),
k AS (SELECT *, count(*) OVER (PARTITION BY strategy) AS n FROM z WHERE signal IS NOT NULL AND fwd IS NOT NULL),
r AS (SELECT *, {_PCT.format(by='strategy', x='signal')} AS rs, {_PCT.format(by='strategy', x='fwd')} AS rf, greatest(least((signal - avg(signal) OVER (PARTITION BY strategy)) / stddev_samp(signal) OVER (PARTITION BY strategy), 1), -1) AS position FROM k WHERE n >= 30)
SELECT strategy, n, {sql_round(_CORR.format(a='rs', b='rf'), 6)} AS spearman, {sql_round(_CORR.format(a='signal', b='fwd'), 6)} AS pearson, {sql_round('avg(CAST(sign(position) = sign(fwd) AS INT))', 6)} AS hit_rate,
{sql_round('avg(position * fwd) / stddev_samp(position * fwd) * sqrt(52)', 5)} AS sharpe FROM r GROUP BY strategy, n""",
)
def evaluate_series(spark, sf_dir):
    from pyspark.sql import Window

    from ..plans.compiler import label

    r = returns(dense(spark, sf_dir, "supp_week"))
    rows = r.select(F.col("instrument").alias("strategy"), F.col("pos").alias("t"), F.col("ret").alias("signal"), label(F.col("close"), 1).alias("fwd"))
    out = st.evaluate_series(rows, periods=52)
    return out.select("strategy", "n", *[rounded(F.col(c), k).alias(c) for c, k in (("spearman", 6), ("pearson", 6), ("hit_rate", 6), ("sharpe", 5))])


_LAGS = "{0}, vl AS ({1}), vk AS (SELECT factor, lag, dt, instrument, value, y, count(*) OVER (PARTITION BY factor, lag, dt) AS n FROM vl WHERE value IS NOT NULL AND y IS NOT NULL), rl AS (SELECT *, {2} AS rf, {3} AS ry FROM vk WHERE n > 30), cl AS (SELECT factor, lag, dt, {4} AS ic FROM rl GROUP BY 1, 2, 3), lc AS (SELECT factor, lag, avg(ic) AS ic FROM cl GROUP BY 1, 2)".format(
    _FACTOR_SQL,
    " UNION ALL ".join(f"SELECT factor, {k} AS lag, dt, instrument, {f'lag(value, {k}) OVER (PARTITION BY factor, instrument ORDER BY dt)' if k else 'value'} AS value, y FROM v" for k in (0, 1, 2)),
    _PCT.format(by="factor, lag, dt", x="value"),
    _PCT.format(by="factor, lag, dt", x="y"),
    _CORR.format(a="rf", b="ry"),
)


@query("lag_decay", f"{_LAGS} SELECT factor, lag, {sql_round('ic', 6)} AS ic FROM lc")
def lag_decay(spark, sf_dir):
    """Mean coefficient by delay."""
    from .crosssection import values

    return st.lag_decay(values(spark, sf_dir), (0, 1, 2)).withColumn("ic", rounded(F.col("ic"), 6))


@query(
    "lag_decay_shape",
    f"""{_LAGS}, ed AS (SELECT factor, arg_min(ic, lag) AS base, arg_max(ic, lag) AS last, max(lag) - min(lag) AS steps, arg_min(lag, {{'y': ic, 'x': lag}}) AS worst FROM lc GROUP BY 1)
SELECT factor, {sql_round('base', 6)} AS base, {sql_round('(base - last) / steps', 6)} AS per_step, (SELECT min(lag) FROM lc WHERE lc.factor = ed.factor AND base > 0 AND ic <= base / 2) AS half_life, worst,
coalesce((SELECT min(lag) FROM lc WHERE lc.factor = ed.factor AND base > 0 AND ic <= base / 2) <= 1, false) AS race FROM ed""",
)
def lag_decay_shape(spark, sf_dir):
    from .crosssection import values

    out = st.decay_shape(st.lag_decay(values(spark, sf_dir), (0, 1, 2)), "lag", "ic", ["factor"])
    return out.select("factor", rounded(F.col("base"), 6).alias("base"), rounded(F.col("per_step"), 6).alias("per_step"), "half_life", "worst", "race")


#: Further names of queries over every supplier.
for _f in (tstat_sharpe, moments_for_dsr, nonoverlap, autocorr, newey_west, effective_breadth_pairs, log_wealth, cpcv):
    query(f"{_f.__name__}_all", ORACLES[_f.__name__])(partial(_f, of=all_strategies))
