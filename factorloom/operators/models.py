"""Factor combination by shrunk covariances and by boosted trees."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .crosssection import percent_rank


def shrunk_covariance(x: np.ndarray) -> np.ndarray:
    """Ledoit and Wolf's 2004 estimator: the sample covariance drawn toward a multiple of the identity, by the closed-form
    intensity."""
    n, p = x.shape
    x = x - x.mean(axis=0)
    s = x.T @ x / n
    mu = np.trace(s) / p
    apart = ((s - mu * np.eye(p)) ** 2).sum() / p
    noise = min(apart, sum(((np.outer(r, r) - s) ** 2).sum() for r in x) / (n * n * p))
    return s if apart == 0 else noise / apart * mu * np.eye(p) + (1 - noise / apart) * s


def shrinkage_weights(ic: DataFrame, lookback: int = 250, horizon: int = 5, every: int = 20, least: int = 60) -> DataFrame:
    """dt, factor, weight: every 20th date, the solution of shrunk covariance times weights = mean over the coefficients that
    were known by then, clipped at three times the 90 % quantile of its absolute values and scaled to a sum of 1 of them.

    ic: (dt, factor, ic) of a bounded set of factors; its dates x factors matrix goes to the driver."""
    wide = ic.groupBy("dt").pivot("factor").agg(F.first("ic")).orderBy("dt").toPandas().set_index("dt")
    names, dates, m = list(wide.columns), list(wide.index), wide.to_numpy(dtype=float)
    out = []
    for k in range(0, len(dates), every):
        past = m[max(0, k - horizon - lookback) : max(0, k - horizon)]
        past = past[~np.isnan(past).any(axis=1)]
        if len(past) < least:
            continue
        w = np.linalg.solve(shrunk_covariance(past) + 1e-12 * np.eye(len(names)), past.mean(axis=0))
        bound = 3 * np.quantile(np.abs(w), 0.9)
        w = np.clip(w, -bound, bound)
        if np.abs(w).sum() > 0:
            out += [(dates[k], n, float(v)) for n, v in zip(names, w / np.abs(w).sum())]
    return ic.sparkSession.createDataFrame(out, "dt date, factor string, weight double")


def folds(first: int, last: int, train: int = 6) -> list[tuple[tuple[int, int], int, int]]:
    """((first, last) training year, validation year, test year): the validation year precedes the test year."""
    return [((y - 1 - train, y - 2), y - 1, y) for y in range(first + train + 1, last + 1)]


def walk_forward(rows: DataFrame, features: list[str], first: int, last: int, train: int = 6, purge_days: int = 10, depth: int = 3, rounds: int = 50) -> DataFrame:
    """instrument, dt, score: for each test year, boosted trees fitted on earlier years and stopped on the year before, with
    `purge_days` left out at both ends. rows: instrument, dt, y and the features (missing ones are 0).

    The trees are Spark's; scores are not numerically those of other boosting libraries."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    data = VectorAssembler(inputCols=features, outputCol="x").transform(rows.fillna(0.0, features)).select("instrument", "dt", "y", "x")
    edge = lambda y, days: F.date_add(F.make_date(F.lit(y), F.lit(1), F.lit(1)), days)
    out = None
    for (a, z), check, test in folds(first, last, train):
        fit = data.where((F.col("dt") >= edge(a, 0)) & (F.col("dt") < edge(z + 1, -purge_days))).withColumn("check", F.lit(False))
        valid = data.where((F.col("dt") >= edge(check, purge_days)) & (F.col("dt") < edge(check + 1, -purge_days))).withColumn("check", F.lit(True))
        both = fit.unionByName(valid).where("y is not null")
        if both.where("not check").isEmpty() or both.where("check").isEmpty():
            continue
        model = GBTRegressor(featuresCol="x", labelCol="y", validationIndicatorCol="check", maxDepth=depth, maxIter=rounds, seed=7).fit(both)
        part = model.transform(data.where(F.year("dt") == test)).select("instrument", "dt", F.col("prediction").alias("score"))
        out = part if out is None else out.unionByName(part)
    return rows.sparkSession.createDataFrame([], "instrument string, dt date, score double") if out is None else out


def rank_average(scores: DataFrame) -> DataFrame:
    """instrument, dt, score: mean percentile rank over the models of (model, instrument, dt, score)."""
    return scores.withColumn("r", percent_rank("score", ["model", "dt"])).groupBy("instrument", "dt").agg(F.avg("r").alias("score"))


def horizon_labels(panel: DataFrame, horizons: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """The panel with y_h for each horizon."""
    from ..plans.compiler import label

    return panel.withColumns({f"y_{h}": label(F.col("close"), h) for h in horizons})


def choose(metrics: DataFrame, by: str = "info_ratio") -> DataFrame:
    """The run with the greatest value (ties by name)."""
    return metrics.withColumn("__k", F.row_number().over(Window.partitionBy().orderBy(F.desc_nulls_last(by), "run"))).where("__k = 1").drop("__k")
