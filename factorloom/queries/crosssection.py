"""Cross-sectional evaluation over the quarterly part panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import crosssection as xs
from ..plans import compiler
from ..runtime import written
from .base import dense, dense_sql, rounded, sql_round

FACTORS = {"momentum": "Mean($close,3)/$close-1", "range": "($high-$low)/$close", "size": "Log($amount+1)"}
_FACTOR_SQL = f"""{dense_sql('part_quarter')},
f AS (SELECT instrument, dt, CASE WHEN count(close) OVER w >= 2 THEN avg(close) OVER w END / close - 1 AS momentum, (high - low) / close AS range, ln(amount + 1) AS size,
  lead(close, 2) OVER o / lead(close, 1) OVER o - 1 AS y
  FROM d WINDOW o AS (PARTITION BY instrument ORDER BY pos), w AS (PARTITION BY instrument ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
v AS (SELECT instrument, dt, y, 'momentum' AS factor, momentum AS value FROM f UNION ALL SELECT instrument, dt, y, 'range', range FROM f UNION ALL SELECT instrument, dt, y, 'size', size FROM f)"""
_PCT = "(rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0::DOUBLE) / count({x}) OVER (PARTITION BY {by})"
_RANKED = f""", k AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY factor, dt) AS n FROM v WHERE value IS NOT NULL AND y IS NOT NULL) WHERE n > 30),
r AS (SELECT *, {_PCT.format(by='factor, dt', x='value')} AS rf, {_PCT.format(by='factor, dt', x='y')} AS ry FROM k)"""
_CORR = "CASE WHEN stddev_pop({a}) > 0 AND stddev_pop({b}) > 0 THEN corr({a}, {b}) END"


def values(spark, sf_dir: str) -> DataFrame:
    """factor, dt, instrument, value, y for the three factors and the forward return of a quarter, entered a quarter late."""
    panel = dense(spark, sf_dir, "part_quarter").withColumn("y", compiler.label(F.col("close"), 1))
    wide = compiler.evaluate(panel, FACTORS, ("instrument", "dt", "y"))
    return xs.melt(wide, list(FACTORS), ("instrument", "dt", "y"))


@query("rank_ic", f"{_FACTOR_SQL}{_RANKED} SELECT factor, dt, n, {sql_round(_CORR.format(a='rf', b='ry'), 6)} AS rank_ic FROM r GROUP BY factor, dt, n")
def rank_ic(spark, sf_dir):
    return xs.rank_ic(values(spark, sf_dir)).withColumn("rank_ic", rounded(F.col("rank_ic"), 6))


@query(
    "pearson_ic",
    f"""{_FACTOR_SQL}{_RANKED}, q AS (SELECT factor, quantile_cont(value, 0.01::DOUBLE) AS lo, quantile_cont(value, 0.99::DOUBLE) AS hi FROM r GROUP BY factor),
c AS (SELECT r.*, greatest(least(value, hi), lo) AS w FROM r JOIN q USING (factor))
SELECT factor, dt, {sql_round(_CORR.format(a='w', b='y'), 6)} AS pearson_ic, {sql_round('avg(y) FILTER (WHERE rf > 0.8) - avg(y) FILTER (WHERE rf <= 0.2)', 6)} AS ls FROM c GROUP BY factor, dt""",
)
def pearson_ic(spark, sf_dir):
    return xs.evaluate(values(spark, sf_dir)).select("factor", "dt", rounded(F.col("pearson_ic"), 6).alias("pearson_ic"), rounded(F.col("ls"), 6).alias("ls"))


@query(
    "quantile_ls",
    f"{_FACTOR_SQL}{_RANKED} SELECT factor, dt, {sql_round('avg(y) FILTER (WHERE rf > 1 - 1.0::DOUBLE / 5) - avg(y) FILTER (WHERE rf <= 1.0::DOUBLE / 5)', 6)} AS spread FROM r WHERE n >= 50 GROUP BY factor, dt",
)
def quantile_ls(spark, sf_dir):
    return xs.quantile_spread(values(spark, sf_dir)).withColumn("spread", rounded(F.col("spread"), 6))


@query("xs_rank_pct", f"{_FACTOR_SQL}, z AS (SELECT * FROM v WHERE value IS NOT NULL) SELECT factor, dt, instrument, {sql_round(_PCT.format(by='factor, dt', x='value'), 6)} AS pct FROM z")
def xs_rank_pct(spark, sf_dir):
    return values(spark, sf_dir).where("value is not null").select("factor", "dt", "instrument", rounded(xs.percent_rank("value", ["factor", "dt"]), 6).alias("pct"))


#: NULLs are a partition of their own, so ranks among the values need no join.
_CENTRED = "SELECT factor, dt, instrument, CASE WHEN value IS NULL THEN 0 ELSE (rank() OVER p + (count(*) OVER (PARTITION BY factor, dt, value) - 1) / 2.0::DOUBLE) / count(value) OVER (PARTITION BY factor, dt) - 0.5 END AS r FROM v WINDOW p AS (PARTITION BY factor, dt, value IS NULL ORDER BY value)"


@query("xs_rank_centred", f"{_FACTOR_SQL}, c AS ({_CENTRED}) SELECT factor, dt, instrument, {sql_round('r', 6)} AS r FROM c")
def xs_rank_centred(spark, sf_dir):
    return values(spark, sf_dir).select("factor", "dt", "instrument", rounded(xs.centred_rank("value", ["factor", "dt"]), 6).alias("r"))


@query(
    "winsorise_xs",
    f"""{_FACTOR_SQL}, q AS (SELECT factor, dt, quantile_cont(value, 0.01::DOUBLE) AS lo, quantile_cont(value, 0.99::DOUBLE) AS hi FROM v GROUP BY factor, dt)
SELECT factor, dt, instrument, {sql_round('CASE WHEN value IS NOT NULL THEN greatest(least(value, hi), lo) END', 6)} AS value FROM v JOIN q USING (factor, dt)""",
)
def winsorise_xs(spark, sf_dir):
    return xs.winsorise(values(spark, sf_dir), by=("factor", "dt")).select("factor", "dt", "instrument", rounded(F.col("value"), 6).alias("value"))


@query(
    "numerical_checks",
    f"""{_FACTOR_SQL}, q AS (SELECT factor, quantile_cont(value, 0.01::DOUBLE) AS a, quantile_cont(value, 0.5::DOUBLE) AS m, quantile_cont(value, 0.99::DOUBLE) AS z FROM v GROUP BY factor),
w AS (SELECT factor, 1 - count(value) / count(*) AS invalid, avg(CASE WHEN value IS NOT NULL THEN CAST(abs(value - m) > 1e6 * greatest(abs(z - a), 1e-12) AS INT) END) AS extreme FROM v JOIN q USING (factor) GROUP BY factor),
g AS (SELECT factor, dt, count(value) AS present, count(DISTINCT value) AS distinct_values FROM v GROUP BY factor, dt),
h AS (SELECT *, present / greatest(max(present) OVER (PARTITION BY factor), 1) AS cover FROM g),
s AS (SELECT factor, avg(cover) AS coverage, quantile_cont(CAST(distinct_values AS DOUBLE), 0.5::DOUBLE) AS median_distinct, avg(distinct_values / greatest(present, 1)) AS unique_share FROM h GROUP BY factor)
SELECT factor, {sql_round('invalid', 6)} AS invalid, {sql_round('extreme', 6)} AS extreme, {sql_round('coverage', 6)} AS coverage, {sql_round('median_distinct', 2)} AS median_distinct, {sql_round('unique_share', 6)} AS unique_share,
  invalid + extreme <= 0.30 AND coverage >= 0.30 AND median_distinct > 2 AND unique_share >= 0.10 AS passed FROM w JOIN s USING (factor)""",
)
def numerical_checks(spark, sf_dir):
    out = xs.numerical_checks(written(values(spark, sf_dir), "values"))
    return out.select("factor", *[rounded(F.col(c), k).alias(c) for c, k in (("invalid", 6), ("extreme", 6), ("coverage", 6), ("median_distinct", 2), ("unique_share", 6))], "passed")


@query("composite_rank", f"{_FACTOR_SQL}, c AS ({_CENTRED}) SELECT dt, instrument, {sql_round('avg(CASE WHEN factor = ' + chr(39) + 'range' + chr(39) + ' THEN -r ELSE r END)', 6)} AS score FROM c GROUP BY dt, instrument")
def composite_rank(spark, sf_dir):
    signs = spark.createDataFrame([("momentum", 1), ("range", -1), ("size", 1)], "factor string, sign int")
    return xs.composite(values(spark, sf_dir), signs).withColumn("score", rounded(F.col("score"), 6))


@query(
    "family_composites",
    f"{_FACTOR_SQL}, c AS ({_CENTRED}) SELECT 'price' AS family, dt, instrument, {sql_round('avg(CASE WHEN factor = ' + chr(39) + 'size' + chr(39) + ' THEN -r ELSE r END)', 6)} AS score FROM c GROUP BY dt, instrument",
)
def family_composites(spark, sf_dir):
    families = spark.createDataFrame([("momentum", "price", 1), ("range", "price", 1), ("size", "price", -1), ("none", "alone", 1)], "factor string, family string, sign int")
    return xs.family_composites(values(spark, sf_dir), families).withColumn("score", rounded(F.col("score"), 6))


@query("global_zscore", f"{_FACTOR_SQL}, s AS (SELECT factor, avg(value) AS m, stddev_pop(value) AS s FROM v GROUP BY factor) SELECT factor, dt, instrument, {sql_round('(value - m) / s', 6)} AS z FROM v JOIN s USING (factor)")
def global_zscore(spark, sf_dir):
    return xs.global_zscore(values(spark, sf_dir)).select("factor", "dt", "instrument", rounded(F.col("z"), 6).alias("z"))


_IC_SQL = f"{_FACTOR_SQL}{_RANKED}, ic AS (SELECT factor, dt, {_CORR.format(a='rf', b='ry')} AS ic FROM r GROUP BY factor, dt)"
_WEIGHT_SQL = f""", kn AS (SELECT *, lag(ic, 2) OVER (PARTITION BY factor ORDER BY dt) AS known FROM ic),
tr AS (SELECT *, CASE WHEN count(known) OVER w >= 2 THEN avg(known) OVER w END AS trail FROM kn WINDOW w AS (PARTITION BY factor ORDER BY dt ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
wt AS (SELECT dt, factor, 0.5 / count(*) OVER (PARTITION BY dt) + 0.5 * coalesce(trail / nullif(sum(abs(trail)) OVER (PARTITION BY dt), 0), 0) AS weight FROM tr)"""


def _weights(spark, of):
    ic = xs.rank_ic(of).select("factor", "dt", F.col("rank_ic").alias("ic"))
    return xs.dynamic_weights(ic, spark.createDataFrame([(f, 1) for f in FACTORS], "factor string, sign int"), 4, 1)


@query("dynamic_weights", f"{_IC_SQL}{_WEIGHT_SQL} SELECT dt, factor, {sql_round('weight', 6)} AS weight FROM wt")
def dynamic_weights(spark, sf_dir):
    return _weights(spark, values(spark, sf_dir)).withColumn("weight", rounded(F.col("weight"), 6))


@query(
    "combine",
    f"""{_IC_SQL}{_WEIGHT_SQL}, c AS ({_CENTRED}), j AS (SELECT c.dt, c.instrument, c.r, w.weight FROM c ASOF LEFT JOIN wt w ON w.factor = c.factor AND w.dt <= c.dt)
SELECT dt, instrument, {sql_round('sum(r * coalesce(weight, 0))', 6)} AS score FROM j GROUP BY dt, instrument""",
)
def combine(spark, sf_dir):
    held = written(values(spark, sf_dir), "values")
    return xs.combine(held, _weights(spark, held)).withColumn("score", rounded(F.col("score"), 6))


@query("future_noise_test")
def future_noise_test(spark, sf_dir):
    """Every hypothesis formula's shape with short windows, checked for look-ahead; no SQL: the scrambling is a Spark hash."""
    formulas = {"mean": "Mean($close,5)/$close-1", "corr": "Corr($close,Log($volume+1),6)", "rank": "Rank($close,5)", "ema": "EMA($close,4)/$close"}
    return xs.leak_check(dense(spark, sf_dir, "user_day"), formulas)
