"""Multiple-testing and validation statistics.

What touches rows is a DataFrame aggregate; what is left (moments, block sums, tiles of a matrix of strategies) is small and
finished with numpy. Strategy returns are long: (strategy, t, ret).
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import ship, written
from .crosssection import correlation, percent_rank

NORMAL = NormalDist()
EULER = 0.5772156649  # fixed value
#: Eigenvalues need a matrix of strategies in one task: 1.2 GB, and as much again to work on, at this number.
MOST_EIGENVALUES = 12_000


def tstat(x: Column) -> Column:
    """Mean over its standard error; NULL for fewer than three values."""
    return F.when(F.count(x) > 2, F.try_divide(F.avg(x), F.when(F.stddev_samp(x) > 0, F.stddev_samp(x)) / F.sqrt(F.count(x).cast("double"))))


def sharpe(x: Column, periods: float) -> Column:
    s = F.stddev_samp(x)
    return F.try_divide(F.avg(x), F.when(s > 0, s)) * math.sqrt(periods)


def nonoverlapping(df: DataFrame, step: int, by: list[str], order: str) -> DataFrame:
    """Every step-th row from the first."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1).where(F.col("__k") % step == 0).drop("__k")


def moments(returns: DataFrame) -> DataFrame:
    """strategy, n, mean, sd (sample), skew and kurt (population moments, kurt not in excess)."""
    x = F.col("ret")
    flat = F.min(x) == F.max(x)
    return returns.where("ret is not null").groupBy("strategy").agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.when(~flat, F.skewness(x)).alias("skew"), F.when(~flat, F.kurtosis(x) + 3).alias("kurt")
    )


def expected_maximum(trials: int, variance: float) -> float:
    """Expected greatest per-period Sharpe ratio of that many trials of noise."""
    n = max(trials, 2)
    return math.sqrt(max(variance, 1e-12)) * ((1 - EULER) * NORMAL.inv_cdf(1 - 1 / n) + EULER * NORMAL.inv_cdf(1 - 1 / (n * math.e)))


def deflated_probability(n: int, mean: float, sd: float, skew: float, kurt: float, trials: int, variance: float) -> float:
    """Probability that the true Sharpe ratio exceeds the expected maximum of the trials; 0 below 20 observations."""
    if n < 20 or not sd or not sd > 0:
        return 0.0
    sr = mean / sd
    spread = math.sqrt(max(1 - skew * sr + (kurt - 1) / 4 * sr * sr, 1e-12))
    return NORMAL.cdf((sr - expected_maximum(trials, variance)) * math.sqrt(n - 1) / spread)


def expected_maximum_column(trials: Column, variance: Column) -> Column:
    from ..functions.scalars import normal_quantile

    n = F.greatest(trials, F.lit(2)).cast("double")
    return F.sqrt(F.greatest(variance, F.lit(1e-12))) * ((1 - EULER) * normal_quantile(1 - 1 / n) + EULER * normal_quantile(1 - 1 / (n * math.e)))


def deflated(moment: DataFrame, trials: Column, variance: Column) -> DataFrame:
    """`moment` (n, mean, sd, skew, kurt as moments() has them) with sharpe, hurdle and dsr added."""
    from ..functions.scalars import normal_cdf

    some = F.col("sd") > 0
    ratio = F.try_divide("mean", F.when(some, F.col("sd")))
    sr, skew, kurt = F.col("sharpe"), F.coalesce("skew", F.lit(0.0)), F.coalesce("kurt", F.lit(3.0))
    spread = F.sqrt(F.greatest(1 - skew * sr + (kurt - 1) / 4 * sr * sr, F.lit(1e-12)))
    out = moment.withColumn("sharpe", ratio).withColumn("hurdle", expected_maximum_column(trials, variance))
    return out.withColumn("dsr", F.when((F.col("n") >= 20) & some, normal_cdf((sr - F.col("hurdle")) * F.sqrt(F.col("n") - 1.0) / spread)).otherwise(0.0))


def deflated_sharpe(returns: DataFrame, trials: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """strategy, n, sharpe, hurdle, dsr for each strategy; trials default to the number of strategies (of each value of
    `by`, columns that strategies carry) and the variance is the population variance of their Sharpe ratios. Nothing reaches
    the driver; the counts and variances, a row for each value of `by`, are joined back."""
    keys = [*by, "strategy"]
    x = F.col("ret")
    flat = F.min(x) == F.max(x)
    every = returns.where("ret is not null").groupBy(*keys).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.when(~flat, F.skewness(x)).alias("skew"), F.when(~flat, F.kurtosis(x) + 3).alias("kurt")
    )
    whole = every.groupBy(*by).agg(F.count("*").alias("__trials"), F.coalesce(F.var_pop(F.try_divide("mean", F.when(F.col("sd") > 0, F.col("sd")))), F.lit(0.0)).alias("__variance"))
    joined = every.join(whole, list(by)) if by else every.join(F.broadcast(whole))  # one row
    return deflated(joined, F.lit(trials) if trials else F.col("__trials"), F.col("__variance")).select(*keys, "n", "sharpe", "hurdle", "dsr")


def hurdle_sharpe(trials: int, variance: float, n: int, target: float = 0.95, periods: int = 52) -> float:
    """Annual Sharpe ratio that a standard-normal-shaped series of n periods needs for the target probability."""
    if n < 20:
        return math.nan
    x = np.random.default_rng(0).standard_normal(n)
    x = (x - x.mean()) / x.std(ddof=1)
    m = x - x.mean()
    skew, kurt = (m**3).mean() / (m**2).mean() ** 1.5, (m**4).mean() / (m**2).mean() ** 2
    low, high = 0.0, 3.0
    for _ in range(50):
        middle = (low + high) / 2
        if deflated_probability(n, middle, 1.0, skew, kurt, trials, variance) < target:
            low = middle
        else:
            high = middle
    return (low + high) / 2 * math.sqrt(periods)


def block_sums(returns: DataFrame, blocks: int, keep: float = 0.8) -> DataFrame:
    """strategy, block, n, s, ss over the periods that all well-covered strategies share, cut into equal blocks (a
    remainder of periods at the end is left out)."""
    periods = returns.select("t").distinct().count()
    covered = returns.where("ret is not null").groupBy("strategy").agg(F.count("*").alias("c")).where(F.col("c") >= int(keep * periods)).select("strategy")
    good = returns.where("ret is not null").join(F.broadcast(covered), "strategy")
    strategies = covered.count()
    whole = good.groupBy("t").agg(F.count("*").alias("c")).where(F.col("c") == strategies).select("t")
    placed = whole.withColumn("k", F.row_number().over(Window.orderBy("t")) - 1)  # one row a period
    total = whole.count() // blocks
    if total == 0 or strategies < 2:
        return returns.sparkSession.createDataFrame([], "strategy string, block int, n long, s double, ss double")
    placed = placed.withColumn("block", F.floor(F.col("k") / total).cast("int")).where(F.col("block") < blocks)
    return good.join(placed, "t").groupBy("strategy", "block").agg(F.count("*").alias("n"), F.sum("ret").alias("s"), F.sum(F.col("ret") * F.col("ret")).alias("ss"))


def average_ranks(x: np.ndarray) -> np.ndarray:
    """Ascending ranks from 1, ties averaged."""
    _, inverse, count = np.unique(x, return_inverse=True, return_counts=True)
    upto = np.cumsum(count)
    return (upto - (count - 1) / 2)[inverse]


def overfitting_probability(returns: DataFrame, blocks: int = 16, most: int = 3000, seed: int = 0) -> float:
    """Combinatorially symmetric cross-validation: how often the best strategy of one half ranks in the lower half of the
    other. Mean and deviation of a half follow from block sums, so only blocks x strategies numbers leave Spark."""
    rows = block_sums(returns, blocks).collect()
    names = sorted({r["strategy"] for r in rows})
    if len(names) < 2:
        return math.nan
    at = {s: i for i, s in enumerate(names)}
    n, s, ss = (np.zeros((blocks, len(names))) for _ in range(3))
    for r in rows:
        n[r["block"], at[r["strategy"]]], s[r["block"], at[r["strategy"]]], ss[r["block"], at[r["strategy"]]] = r["n"], r["s"], r["ss"]
    if (n < 2).any():
        return math.nan
    halves = np.array(list(itertools.combinations(range(blocks), blocks // 2)))
    if len(halves) > most:
        halves = halves[np.random.default_rng(seed).choice(len(halves), most, replace=False)]
    chosen = np.zeros((len(halves), blocks))
    np.put_along_axis(chosen, halves, 1.0, axis=1)

    def ratio(pick: np.ndarray) -> np.ndarray:
        c, t, q = pick @ n, pick @ s, pick @ ss
        mean = t / c
        return mean / (np.sqrt(np.maximum(q - c * mean**2, 0) / (c - 1)) + 1e-12)

    inside, outside = ratio(chosen), ratio(1 - chosen)
    best = inside.argmax(axis=1)
    rank = np.array([average_ranks(o)[b] for o, b in zip(outside, best)]) / (len(names) + 1)
    return float((np.log(rank / (1 - rank)) <= 0).mean())


#: Strategies of a tile, the unit in which pairs are compared; a task holds two blocks of at most MOST_TILES tiles.
TILE, MOST_TILES = 512, 16


def tiles(returns: DataFrame, least: int) -> tuple[DataFrame, int]:
    """tile, names, cells (row by row the centred returns of its strategies over all periods, NaN where absent), and how many
    strategies there are: those with `least` observations and some spread that share a period with another one, in
    order of their names. A return that is NaN counts as absent."""
    spark = returns.sparkSession
    ship(spark)
    seen = returns.where(F.col("ret").isNotNull() & ~F.isnan("ret")).select("strategy", "t", F.col("ret").cast("double").alias("ret"))
    good = seen.groupBy("strategy").agg(F.count("*").alias("n"), F.stddev_samp("ret").alias("s")).where((F.col("n") >= least) & (F.col("s") > 0))
    kept = written(seen.join(F.broadcast(good.select("strategy")), "strategy"), "series")
    periods = written(kept.groupBy("t").agg(F.count("*").alias("c")).where("c > 1").select("t", (F.row_number().over(Window.orderBy("t")) - 1).alias("at")), "periods")  # a row a period
    shared = kept.join(F.broadcast(periods), "t")
    names = written(shared.select("strategy").distinct().select("strategy", (F.row_number().over(Window.orderBy("strategy")) - 1).alias("i")), "strategies")  # a row a strategy
    wide, n = periods.count(), names.count()
    placed = shared.join(F.broadcast(names), "strategy").select("strategy", "i", "at", "ret", F.floor(F.col("i") / TILE).cast("int").alias("tile"))

    def pack(rows: pa.Table) -> pa.Table:
        i = rows["i"].to_numpy()
        row = i - i.min()
        cells = np.full((int(row.max()) + 1, wide), np.nan)
        cells[row, rows["at"].to_numpy()] = rows["ret"].to_numpy()
        cells -= np.nanmean(cells, axis=1, keepdims=True)
        _, first = np.unique(row, return_index=True)
        return pa.table({"tile": pa.array([rows["tile"][0].as_py()], pa.int32()), "names": [rows["strategy"].take(pa.array(first)).to_pylist()], "cells": [cells.tobytes()]})

    return written(placed.groupBy("tile").applyInArrow(pack, "tile int, names array<string>, cells binary"), "tiles"), n


def tile_correlations(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Correlations of each row of x with each row of y over the periods that both have (NaN where one is constant there), and
    how many periods those are. Six products give all sums; pairs whose spread is small next to them are done again by themselves."""
    m, k = (~np.isnan(x)).astype(float), (~np.isnan(y)).astype(float)
    u, v = np.where(m > 0, x, 0.0), np.where(k > 0, y, 0.0)
    n, su, sv, suu, svv = m @ k.T, u @ k.T, m @ v.T, (u * u) @ k.T, m @ (v * v).T
    vu, vv = n * suu - su * su, n * svv - sv * sv
    with np.errstate(all="ignore"):
        out = (n * (u @ v.T) - su * sv) / (np.sqrt(vu) * np.sqrt(vv))
    out[n < 2] = np.nan
    for i, j in np.argwhere((n > 1) & ~((vu > 1e-7 * n * suu) & (vv > 1e-7 * n * svv))):
        both = (m[i] > 0) & (k[j] > 0)
        a, b = x[i, both], y[j, both]
        out[i, j] = np.nan
        if a.min() < a.max() and b.min() < b.max():
            a, b = a - a.mean(), b - b.mean()
            out[i, j] = (a @ b) / (np.sqrt(a @ a) * np.sqrt(b @ b))
    return out, n


def over_tiles(packed: DataFrame, n: int, each, schema: str) -> DataFrame:
    """What `each` (tile, tile, names, names, correlations, shared periods) makes of every pair of tiles, as record batches.

    Tiles meet in pairs of blocks, so that a tile is sent once for each block and a task holds two blocks and the
    correlations of one pair of tiles."""
    count = max(1, -(-n // TILE))
    size = max(1, min(MOST_TILES, count // 16))
    blocks = -(-count // size)
    block = F.floor(F.col("tile") / size).cast("int")
    met = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(F.least(block, "other").alias("i"), F.greatest(block, "other").alias("j"), "tile", "names", "cells")

    def compare(group):
        held = {}
        for batch in group:
            for t, names, cells in zip(batch["tile"].to_pylist(), batch["names"], batch["cells"]):
                held[t] = (int(batch["i"][0].as_py()), int(batch["j"][0].as_py())), names.values, np.frombuffer(cells.as_buffer()).reshape(len(names.values), -1)
        for p in sorted(held):
            (i, j), left, x = held[p]
            for q in sorted(held):
                if p <= q and (p // size, q // size) == (i, j):
                    r, shared = tile_correlations(x, held[q][2])
                    if p == q:
                        shared = np.triu(shared, 1)
                    yield each(p, q, left, held[q][1], r, shared)

    def run(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from compare(group)

    # a pair of blocks costs far more than its bytes, so the exchange keeps its number of tasks
    return met.repartition(min(blocks * (blocks + 1), 2_000), "i", "j").groupBy("i", "j").applyInArrow(run, schema)


def pair_correlations(returns: DataFrame, least: int = 30) -> DataFrame:
    """a, b, corr for a < b: pairwise-complete correlations of strategies with `least` observations and some spread. Every pair
    that shares a period is a row, so the result grows with the square of the strategies; what a task holds does not."""

    def rows(p, q, left, right, r, shared):
        i, j = np.nonzero(shared)
        return pa.RecordBatch.from_arrays([left.take(pa.array(i)), right.take(pa.array(j)), pa.array(r[i, j], from_pandas=True)], ["a", "b", "corr"])

    return over_tiles(*tiles(returns, least), rows, "a string, b string, corr double")


def absolute_sum(packed: DataFrame, n: int) -> DataFrame:
    """total, one row: the sum of the absolute correlations of all pairs."""

    def total(p, q, left, right, r, shared):
        return pa.RecordBatch.from_arrays([pa.array([float(np.abs(np.nan_to_num(r[shared > 0])).sum())])], ["total"])

    return over_tiles(packed, n, total, "total double").agg(F.coalesce(F.sum("total"), F.lit(0.0)).alias("total"))


def spectrum(packed: DataFrame, n: int) -> tuple[float, float]:
    """Mean absolute correlation and participation of the correlation matrix. Its eigenvalues need the whole matrix in one
    task, on an executor; more than MOST_EIGENVALUES strategies are refused."""
    if n > MOST_EIGENVALUES:
        raise ValueError(f"eigenvalues are for at most {MOST_EIGENVALUES} strategies, not {n}")

    def square(p, q, left, right, r, shared):
        whole = np.where(shared > 0, np.nan_to_num(r), 0.0)
        return pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([q], pa.int32()), pa.array([whole.tobytes()], pa.binary())], ["p", "q", "cells"])

    def solve(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.eye(n)
        for batch in group:
            for p, q, cells in zip(batch["p"].to_pylist(), batch["q"].to_pylist(), batch["cells"]):
                here = m[p * TILE : (p + 1) * TILE, q * TILE : (q + 1) * TILE]
                here += np.frombuffer(cells.as_buffer()).reshape(here.shape)
        total = sum(float(np.abs(row).sum()) for row in m) - n  # the half above the diagonal
        yield pa.RecordBatch.from_arrays([pa.array([total / (n * (n - 1) / 2)]), pa.array([participation(m)])], ["rho", "independent"])

    blocks = written(over_tiles(packed, n, square, "p int, q int, cells binary"), "correlations")
    found = blocks.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(solve, "rho double, independent double").first()
    return found["rho"], found["independent"]


def participation(m: np.ndarray) -> float:
    """Effective number of independent series: squared sum of eigenvalues over the sum of squares. The half above the diagonal
    of `m` is read."""
    e = np.clip(np.linalg.eigvalsh(m, UPLO="U"), 0, None)
    return float(e.sum() ** 2 / (e**2).sum()) if (e > 0).any() else float(len(m))


def effective_trials(returns: DataFrame, raw: int | None = None) -> dict:
    """Trial-count diagnostics: raw, by eigenvalues, by mean absolute correlation."""
    packed, n = tiles(returns, 30)
    if n < 2:
        return {"n_raw": raw or n, "n_eff_eigenvalue": float(n), "n_eff_avg_corr": float(n), "mean_abs_corr": 0.0}
    rho, independent = spectrum(packed, n)
    return {"n_raw": raw or n, "n_eff_eigenvalue": round(independent, 1), "n_eff_avg_corr": round(n / (1 + (n - 1) * rho), 1), "mean_abs_corr": round(rho, 3)}


def average_correlation(returns: DataFrame, least: int = 30) -> DataFrame:
    """n_raw, mean_abs_corr, n_eff_avg_corr of strategies that share periods, as one row: n / (1 + (n - 1) * rho). Pairs are
    added up where they are compared."""
    packed, n = tiles(returns, least)
    rho = F.try_divide(F.col("total"), F.lit(n * (n - 1) / 2))
    return absolute_sum(packed, n).select(F.lit(n).cast("long").alias("n_raw"), rho.alias("mean_abs_corr"), (n / (1 + (n - 1) * rho)).alias("n_eff_avg_corr"))


def market_neutral(returns: DataFrame) -> DataFrame:
    """Returns minus the mean of their period."""
    return returns.withColumn("ret", F.col("ret") - F.avg("ret").over(Window.partitionBy("t")))


def effective_breadth(returns: DataFrame, rebalances: int = 52) -> dict:
    """Independent bets of a universe, raw and market neutral, and bets a year."""
    packed, n = tiles(returns, 20)
    if n < 2:
        return {"n_instruments": n, "independent_bets": float(n), "independent_bets_neutral": float(n), "breadth_per_year": float(n * rebalances)}
    neutral = spectrum(*tiles(market_neutral(returns), 20))[1]
    return {"n_instruments": n, "independent_bets": round(spectrum(packed, n)[1], 2), "independent_bets_neutral": round(neutral, 2), "breadth_per_year": round(neutral * rebalances, 1), "collapse_ratio": round(neutral / n, 3)}


def required_ic(target_ir: float, breadth: float) -> float:
    return target_ir / math.sqrt(breadth) if breadth > 0 else math.nan


#: Gross Sharpe ratios above which a result needs an explanation.
CEILINGS = {"futures": 1.0, "crypto": 1.5, "equity": 2.0}


def search_verdict(bets: float, trials: int) -> tuple[float, str]:
    """Trials for each independent bet, and what that says: above 25 too wide, above 8 on the wide side."""
    each = round(trials / max(bets, 1), 1)
    return each, "too wide for the universe" if each > 25 else "on the wide side" if each > 8 else "proportionate"


def implausible(gross_sharpe: float | None, market: str) -> bool:
    return gross_sharpe is not None and market in CEILINGS and gross_sharpe > CEILINGS[market]


def cpcv_splits(n: int, blocks: int = 8, test: int = 2, purge: int = 0, embargo: int = 0) -> list[tuple[list[tuple[int, int]], np.ndarray]]:
    """(test ranges, train rows) of each choice of test blocks; rows just before a test block are purged, rows just after it
    are embargoed."""
    edge = np.linspace(0, n, blocks + 1).astype(int)
    out = []
    for chosen in itertools.combinations(range(blocks), test):
        train = np.ones(n, dtype=bool)
        ranges = [(int(edge[b]), int(edge[b + 1])) for b in chosen]
        for a, z in ranges:
            train[max(0, a - purge) : min(n, z + embargo)] = False
        out.append((ranges, np.flatnonzero(train)))
    return out


def cpcv(returns: DataFrame, blocks: int = 8, test: int = 2, periods: float = 252.0) -> DataFrame:
    """strategy, paths, p05, p50, p95, p_negative of the Sharpe ratio over all choices of test blocks; ratios come from
    block sums joined to the table of choices."""
    spark = returns.sparkSession
    order = Window.partitionBy("strategy").orderBy("t")
    placed = returns.where("ret is not null").withColumn("k", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(Window.partitionBy("strategy")))
    edges = [F.floor(F.col("n") * b / blocks) for b in range(1, blocks)]
    block = sum(((F.col("k") >= e).cast("int") for e in edges), F.lit(0))
    sums = placed.withColumn("block", block).groupBy("strategy", "block").agg(F.count("*").alias("c"), F.sum("ret").alias("s"), F.sum(F.col("ret") * F.col("ret")).alias("ss"))
    choices = [(i, b) for i, c in enumerate(itertools.combinations(range(blocks), test)) for b in c]
    joined = sums.join(F.broadcast(spark.createDataFrame(choices, "path int, block int")), "block").groupBy("strategy", "path").agg(F.sum("c").alias("c"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    variance = (F.col("ss") - F.col("s") * F.col("s") / F.col("c")) / F.when(F.col("c") > 1, F.col("c") - 1)
    ratio = F.try_divide(F.col("s") / F.col("c"), F.when(variance > 0, F.sqrt(variance))) * math.sqrt(periods)
    q = lambda p: F.percentile("ratio", F.lit(p))
    return joined.withColumn("ratio", ratio).groupBy("strategy").agg(F.count("ratio").alias("paths"), q(0.05).alias("p05"), q(0.5).alias("p50"), q(0.95).alias("p95"), F.avg((F.col("ratio") < 0).cast("int")).alias("p_negative"))


def overfitting_factor(tweaks: int, strength: float = 1.0) -> float:
    """Discount of an in-sample Sharpe ratio by the number of tweaks, 2 at least for 0 and growing with their log."""
    return max(1.0, 2 * (1 + strength * math.log1p(tweaks) / math.log(21)))


def log_wealth(returns: DataFrame) -> DataFrame:
    """strategy, n, mean, log_growth, geometric, drag, skew (bias corrected), ruined: growth is NULL after a total loss."""
    x = F.col("ret")
    n = F.count(x).cast("double")
    flat = F.min(x) == F.max(x)
    ruined = F.min(x) <= -1
    growth = F.when(~ruined, F.avg(F.log1p(F.when(x > -1, x))))
    return returns.where("ret is not null").groupBy("strategy").agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), growth.alias("log_growth"), F.expm1(growth).alias("geometric"), (F.avg(x) - F.expm1(growth)).alias("drag"),
        F.when(flat, 0.0).when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"), ruined.alias("ruined"),
    )


def newey_west(returns: DataFrame, lags: int) -> DataFrame:
    """strategy, n, mean, t_nw: Bartlett weights, autocovariances over n. One window pass gives all lags."""
    order = Window.partitionBy("strategy").orderBy("t")
    e = returns.where("ret is not null").withColumn("mean", F.avg("ret").over(Window.partitionBy("strategy"))).withColumn("e", F.col("ret") - F.col("mean"))
    e = e.withColumns({f"p{k}": F.col("e") * F.lag("e", k).over(order) for k in range(1, lags + 1)})
    n = F.count("*")
    long_run = F.sum(F.col("e") * F.col("e")) / n
    for k in range(1, lags + 1):
        long_run = long_run + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(f"p{k}"), F.lit(0.0)) / n
    return e.groupBy("strategy").agg(n.alias("n"), F.first("mean").alias("mean"), F.when((n >= 10) & (long_run > 0), F.first("mean") / F.sqrt(F.when(long_run > 0, long_run) / n)).alias("t_nw"))


def newey_west_lags(n: int) -> int:
    return int(4 * (n / 100) ** (2 / 9))


def autocorrelation(returns: DataFrame) -> DataFrame:
    """strategy, rho: correlation of a return with the one before."""
    before = returns.withColumn("b", F.lag("ret").over(Window.partitionBy("strategy").orderBy("t"))).where("b is not null and ret is not null")
    return before.groupBy("strategy").agg(correlation(F.col("ret"), F.col("b")).alias("rho"))


def independent_decisions(rho: float, periods: float = 252.0) -> float:
    """Independent bets a year of a signal with that autocorrelation."""
    r = min(max(rho, 0.0), 0.999)
    return periods * (1 - r) / (1 + r)


def lag_decay(values: DataFrame, lags: tuple[int, ...] = (0, 1, 2, 3, 5)) -> DataFrame:
    """factor, lag, ic: mean rank coefficient when the value is acted on `lag` rows late (the value is delayed, not the
    return). values: (factor, dt, instrument, value, y)."""
    own = Window.partitionBy("factor", "instrument").orderBy("dt")
    every = values.select("factor", "dt", "instrument", "y", *[(F.lag("value", k).over(own) if k else F.col("value")).alias(str(k)) for k in lags])
    late = every.unpivot(["factor", "dt", "instrument", "y"], [str(k) for k in lags], "lag", "value")
    from .crosssection import rank_ic

    out = rank_ic(late.withColumn("factor", F.concat_ws("@", "factor", "lag")).drop("lag")).groupBy("factor").agg(F.avg("rank_ic").alias("ic"))
    return out.select(F.substring_index("factor", "@", 1).alias("factor"), F.substring_index("factor", "@", -1).cast("int").alias("lag"), "ic")


def decay_shape(curve: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """by, base, per_step, half_life, worst, race of a measured curve: its value at the least x, what each further step costs
    up to the greatest, the least x at which half of a positive base is gone, the x of the least value (the first of equal
    ones), and whether half is gone within one step. Curves with fewer than two values are left out."""
    ok = written(curve.where(F.col(y).isNotNull() & ~F.isnan(y)), "curve")  # a row a step, read twice
    ends = ok.groupBy(*by).agg(F.count("*").alias("__n"), F.min_by(y, x).alias("base"), F.max_by(y, x).alias("__last"), F.min(x).alias("__lo"), F.max(x).alias("__hi"), F.min(F.struct(F.col(y).alias("y"), F.col(x).alias("x"))).alias("__worst")).where("__n >= 2")
    half = ok.join(ends.select(*by, "base"), by).where((F.col("base") > 0) & (F.col(y) <= F.col("base") / 2)).groupBy(*by).agg(F.min(x).alias("half_life"))
    steps = F.greatest(F.col("__hi") - F.col("__lo"), F.lit(1))
    return ends.join(half, by, "left").select(*by, "base", ((F.col("base") - F.col("__last")) / steps).alias("per_step"), "half_life", F.col("__worst.x").alias("worst"), F.coalesce(F.col("half_life") <= 1, F.lit(False)).alias("race"))


def cost_verdict(curve: DataFrame, by: list[str], multiple: str = "multiple", value: str = "value") -> DataFrame:
    """by, at_cost, breaks_at, free_uplift, survives_3x of results at multiples of the assumed costs: the value at 1 (or else
    at the least multiple), the least multiple from 1 on at which nothing is left, what costs take away, and whether
    something is left at 3."""
    ok = curve.where(F.col(value).isNotNull() & ~F.isnan(value))
    at = lambda m: F.max(F.when(F.col(multiple) == m, F.col(value)))
    base = F.coalesce(at(1.0), F.min_by(value, multiple))
    return ok.groupBy(*by).agg(base.alias("at_cost"), F.min(F.when((F.col(multiple) >= 1) & (F.col(value) <= 0), F.col(multiple))).alias("breaks_at"), (at(0.0) - base).alias("free_uplift"), F.coalesce(at(3.0) > 0, F.lit(False)).alias("survives_3x"))


def evaluate_series(signals: DataFrame, periods: float = 252.0, lags: int = 5) -> DataFrame:
    """One row a single-instrument signal (strategy, t, signal, fwd): n, spearman, pearson, hit rate, mean and Newey-West t
    of a capped z-position's return, Sharpe ratio, and buy and hold. Signals of fewer than 30 rows are left out."""
    ok = signals.where("signal is not null and fwd is not null")
    own = Window.partitionBy("strategy")
    z = F.try_divide(F.col("signal") - F.avg("signal").over(own), F.when(F.stddev_samp("signal").over(own) > 0, F.stddev_samp("signal").over(own)))
    rows = ok.withColumn("n", F.count("*").over(own)).where("n >= 30").withColumn("rs", percent_rank("signal", ["strategy"])).withColumn("rf", percent_rank("fwd", ["strategy"]))
    rows = rows.withColumn("position", F.greatest(F.least(F.coalesce(z, F.lit(0.0)), F.lit(1.0)), F.lit(-1.0))).withColumn("ret", F.col("position") * F.col("fwd"))
    base = rows.groupBy("strategy").agg(
        F.count("*").alias("n"), correlation(F.col("rs"), F.col("rf")).alias("spearman"), correlation(F.col("signal"), F.col("fwd")).alias("pearson"),
        F.avg((F.signum("position") == F.signum("fwd")).cast("int")).alias("hit_rate"), sharpe(F.col("ret"), periods).alias("sharpe"), sharpe(F.col("fwd"), periods).alias("sharpe_hold"), tstat(F.col("ret")).alias("t_naive"),
    )
    return base.join(newey_west(rows, lags).select("strategy", "t_nw"), "strategy")


def sharpe_error(annual: float, n: int, periods: float = 244.0) -> float:
    """Standard error of an annual Sharpe ratio."""
    per = annual / math.sqrt(periods)
    return math.sqrt((1 + per * per / 2) / max(n, 1)) * math.sqrt(periods)


def bisect_break(f, low: float = 0.0, high: float = 20.0, steps: int = 12) -> float:
    """The multiple at which a falling function of cost crosses zero; the bound where it does not."""
    if f(high) > 0:
        return high
    if f(low) <= 0:
        return low
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if f(middle) > 0 else (low, middle)
    return (low + high) / 2
