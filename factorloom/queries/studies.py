"""Models, studies and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import books, models, reports
from ..operators import crosssection as xs
from ..plans import compiler, studies
from ..sources import panels
from .books import _book_sql, _measured, _metrics_sql
from .base import BARS, DENSE, bars, dense, dense_sql, rounded, sql_round
from .crosssection import FACTORS, values
from .records import _ID, _TRIALS, trials


@query("shrinkage_weights")
def shrinkage_weights(spark, sf_dir):
    """A linear solve over shrunk covariances; no SQL."""
    ic = xs.rank_ic(values(spark, sf_dir)).select("factor", "dt", F.col("rank_ic").alias("ic"))
    return models.shrinkage_weights(ic, lookback=12, horizon=1, every=4, least=6)


@query("walk_forward")
def walk_forward(spark, sf_dir):
    """Boosted trees by year; no SQL."""
    panel = dense(spark, sf_dir, "part_quarter").withColumn("y", compiler.label(F.col("close"), 1))
    rows = compiler.evaluate(panel, FACTORS, ("instrument", "dt", "y"))
    return models.walk_forward(rows, list(FACTORS), 1999, 2001, train=1, rounds=5)


@query(
    "horizon_ensemble",
    f"""{dense_sql('supp_week')}, l AS (SELECT instrument, dt, lead(close, 2) OVER o / lead(close, 1) OVER o - 1 AS y_1, lead(close, 6) OVER o / lead(close, 1) OVER o - 1 AS y_5 FROM d WINDOW o AS (PARTITION BY instrument ORDER BY pos)),
u AS (SELECT instrument, dt, 'y_1' AS model, y_1 AS s FROM l WHERE y_1 IS NOT NULL UNION ALL SELECT instrument, dt, 'y_5', y_5 FROM l WHERE y_5 IS NOT NULL),
r AS (SELECT instrument, dt, (rank() OVER (PARTITION BY model, dt ORDER BY s) + (count(*) OVER (PARTITION BY model, dt, s) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY model, dt) AS r FROM u)
SELECT instrument, dt, {sql_round('avg(r)', 6)} AS score FROM r GROUP BY 1, 2""",
)
def horizon_ensemble(spark, sf_dir):
    wide = models.horizon_labels(dense(spark, sf_dir, "supp_week"), (1, 5))
    long = wide.unpivot(["instrument", "dt"], ["y_1", "y_5"], "model", "score").where("score is not null")
    return models.rank_average(long).withColumn("score", rounded(F.col("score"), 6))


def _signed(rank_or_z: str) -> str:
    """Mean of the two factors with sign -1 of (factor, instrument, pos, x)."""
    return f"SELECT instrument, pos, avg(-({rank_or_z})) AS score FROM {{rows}} GROUP BY 1, 2"


def _audit_factors(name: str, frame: str) -> str:
    mean = f"CASE WHEN count(close) OVER w >= 2 THEN avg(close) OVER w END"
    return f"""f{name} AS (SELECT instrument, pos, 'reversal' AS factor, close / nullif(lag(close) OVER (PARTITION BY instrument ORDER BY pos), 0) - 1 AS value FROM rt UNION ALL SELECT instrument, pos, 'trend', close / nullif({mean}, 0) - 1 FROM rt WINDOW w AS (PARTITION BY instrument ORDER BY pos ROWS BETWEEN {frame})),
r{name} AS (SELECT factor, instrument, pos, CASE WHEN value IS NULL THEN 0 ELSE (rank() OVER p + (count(*) OVER (PARTITION BY factor, pos, value) - 1) / 2.0::DOUBLE) / count(value) OVER (PARTITION BY factor, pos) - 0.5 END AS x FROM f{name} WINDOW p AS (PARTITION BY factor, pos, value IS NULL ORDER BY value)),
b{name} AS ({_signed('x').format(rows=f'r{name}')})"""


_AUDIT = f"""{_audit_factors('c', '4 PRECEDING AND CURRENT ROW')}, {_audit_factors('l', '2 PRECEDING AND 2 FOLLOWING')},
gs AS (SELECT factor, avg(value) AS m, stddev_pop(value) AS s FROM fc GROUP BY factor), gz AS (SELECT instrument, pos, coalesce((value - m) / nullif(s, 0), 0) AS x FROM fc JOIN gs USING (factor)), bg AS ({_signed('x').format(rows='gz')}),
sc AS (SELECT 'base' AS score_of, instrument, pos, score FROM bc UNION ALL SELECT 'early', instrument, pos, lead(score) OVER (PARTITION BY instrument ORDER BY pos) FROM bc UNION ALL SELECT 'centred', instrument, pos, score FROM bl UNION ALL SELECT 'global', instrument, pos, score FROM bg)"""
_AUDIT_RUNS = "('causal', 'base', 1.0), ('same_day', 'early', 1.0), ('no_costs', 'base', 0.0), ('triple_costs', 'base', 3.0), ('centred_windows', 'centred', 1.0), ('global_scaling', 'global', 1.0)"


@query("protocol_audit", f"{_book_sql(_AUDIT, _AUDIT_RUNS)} {_metrics_sql(244)}")
def protocol_audit(spark, sf_dir):
    """One convention changed at a time through the sequential engine."""
    made = bars(spark, sf_dir, "supp_week")
    panel, bench = panels.densify(made), books.benchmark_returns(panels.benchmark(made))
    formulas = {"reversal": ("$close/Ref($close,1)-1", -1), "trend": ("$close/Mean($close,5)-1", -1)}
    return _measured(studies.audit(panel, bench, formulas, 4, 10, 20, limits=False))


_FORWARD = f"""WITH {BARS['supp_week']}, {DENSE},
k AS (SELECT dt AS signal_date, instrument, row_number() OVER (PARTITION BY dt ORDER BY volume DESC, instrument) AS rank FROM bars),
m AS (SELECT instrument, dt AS signal_date, lead(close, 6) OVER o / lead(close, 1) OVER o - 1 AS move FROM d WINDOW o AS (PARTITION BY instrument ORDER BY pos)),
b AS (SELECT dt AS signal_date, lead(close, 6) OVER (ORDER BY dt) / lead(close, 1) OVER (ORDER BY dt) - 1 AS benchmark FROM (SELECT dt, avg(close) AS close FROM bars GROUP BY dt)),
w AS (SELECT signal_date, count(move) AS n, avg(move) AS realised FROM k JOIN m USING (signal_date, instrument) WHERE rank <= 10 GROUP BY 1)
SELECT signal_date, n, {sql_round('realised', 6)} AS realised, {sql_round('benchmark', 6)} AS benchmark, {sql_round('realised - benchmark', 6)} AS excess, realised - benchmark > 0 AS hit FROM w JOIN b USING (signal_date)"""


@query("forward_results", _FORWARD)
def forward_results(spark, sf_dir):
    bars = panels.supp_week(spark, sf_dir)
    rank = F.row_number().over(Window.partitionBy("dt").orderBy(F.desc("volume"), "instrument"))
    published = bars.withColumn("rank", rank).where("rank <= 10").select(F.col("dt").alias("signal_date"), "instrument")
    out = reports.forward_results(published, dense(spark, sf_dir, "supp_week"), panels.benchmark(bars))
    return out.withColumns({c: rounded(F.col(c), 6) for c in ("realised", "benchmark", "excess")})


@query(
    "decay",
    f"""{_TRIALS}, s AS (SELECT * FROM t WHERE later_ic_mean IS NOT NULL ORDER BY abs(ic_t) DESC, fingerprint, name LIMIT 20)
SELECT count(*) AS n, {sql_round('avg(abs(ic_mean))', 6)} AS discovery, {sql_round('avg(later_ic_mean * sign(ic_mean))', 6)} AS later FROM s""",
)
def decay(spark, sf_dir):
    return reports.decay(trials(spark, sf_dir)).select("n", rounded(F.col("discovery"), 6).alias("discovery"), rounded(F.col("later"), 6).alias("later"))


@query("search_allocation", f"{_TRIALS} SELECT family, count(*) AS evaluated, {sql_round('count(*) / (SELECT count(*) FROM t)', 6)} AS share, count_if(abs(ic_t) >= 1) AS rewarded FROM t GROUP BY 1")
def search_allocation(spark, sf_dir):
    return reports.search_allocation(trials(spark, sf_dir)).withColumn("share", rounded(F.col("share"), 6))


@query("versions", f"{_TRIALS} SELECT run_id AS version, source AS config_sha, count(*) AS n, CAST(min(created_at) AS DATE) AS first, CAST(max(created_at) AS DATE) AS last FROM t GROUP BY 1, 2")
def versions(spark, sf_dir):
    runs = trials(spark, sf_dir).select(F.col("run_id").alias("version"), F.col("source").alias("config_sha"), F.to_date("created_at").alias("started_at"))
    return reports.versions(runs)


@query("insert_if_absent", f"{_TRIALS} SELECT DISTINCT {_ID} AS id FROM t WHERE run_id = '1996' AND {_ID} NOT IN (SELECT {_ID} FROM t WHERE run_id = '1995')")
def insert_if_absent(spark, sf_dir):
    from ..operators.records import absent, formula_id

    t = trials(spark, sf_dir).select("run_id", formula_id().alias("id"))
    return absent(t.where("run_id = '1996'").select("id"), t.where("run_id = '1995'").select("id"), ["id"])
