"""Cross-sections: percentile ranks, information coefficients, long-short spreads, winsorising, numerical checks.

Input is long: (dt, instrument, [factor,] value, y). One re-partition by (factor, dt) serves a whole evaluation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.compiler import finite


def percent_rank(x: str | Column, by: list[str]) -> Column:
    """Average-tie percentile rank of x among the non-NULL values of its group, from one sort: a row's ties are its peers."""
    x = F.col(x) if isinstance(x, str) else x
    order = Window.partitionBy(*by).orderBy(x.asc_nulls_last())
    ties = F.count(F.lit(1)).over(order.rangeBetween(Window.currentRow, Window.currentRow))
    n = F.count(x).over(Window.partitionBy(*by))
    return F.when(x.isNotNull(), (F.rank().over(order) + (ties - 1) / 2.0) / n)


#: Sketch accuracy of quantile brackets: each holds about six rows in SKETCH of its group.
SKETCH = 10_000


def exact_quantiles(df: DataFrame, by: list[str], x: str, at: tuple[float, ...]) -> DataFrame:
    """by, n, q (array): exact interpolated quantiles of the non-NULL values of few large groups. A sketch brackets each
    quantile; a second pass counts what lies below a bracket and keeps only the values in it, so that no task holds a group's
    values. NULL for groups without values."""
    edge = [min(1.0, max(0.0, q + d)) for q in at for d in (-2 / SKETCH, 2 / SKETCH)]
    bound = df.groupBy(*by).agg(F.count(x).alias("n"), F.percentile_approx(x, edge, SKETCH).alias("__b"))
    inside = df.where(F.col(x).isNotNull()).join(F.broadcast(bound), by)  # a row a group
    found = []
    for i in range(len(at)):
        lo, hi = F.col("__b")[2 * i], F.col("__b")[2 * i + 1]
        v = F.col(x)
        found += [F.count_if(v < lo).alias(f"__c{i}"), F.collect_list(F.when((v >= lo) & (v <= hi), v)).alias(f"__v{i}"), F.max(F.when(v < lo, v)).alias(f"__l{i}"), F.min(F.when(v > hi, v)).alias(f"__h{i}")]
    counted = inside.groupBy(*by).agg(F.first("n").alias("n"), *found)
    values = []
    for i, q in enumerate(at):
        near = F.concat(F.array(f"__l{i}"), F.array_sort(f"__v{i}"), F.array(f"__h{i}"))  # the values next to the bracket count too
        place = q * (F.col("n") - 1)
        k = F.floor(place)
        low, high = F.get(near, (k - F.col(f"__c{i}") + 1).cast("int")), F.get(near, (k - F.col(f"__c{i}") + 2).cast("int"))
        values.append(F.when(place > k, low + (high - low) * (place - k)).otherwise(low))
    return bound.select(*by, "n").join(counted.select(*by, F.array(*values).alias("q")), by, "left")


def centred_rank(x: str | Column, by: list[str]) -> Column:
    """Percentile rank minus one half; NULL becomes 0."""
    return F.coalesce(percent_rank(x, by) - 0.5, F.lit(0.0))


def melt(wide: DataFrame, factors: list[str], keys: tuple[str, ...] = ("instrument", "dt")) -> DataFrame:
    """One row for each key and factor."""
    return wide.unpivot(list(keys), factors, "factor", "value")


def valid(values: DataFrame, least: int = 31) -> DataFrame:
    """Rows with a finite value and y, of (factor, dt) groups of at least `least` such rows, with n."""
    rows = values.withColumn("value", finite(F.col("value"))).where("value is not null and y is not null")
    return rows.withColumn("n", F.count("*").over(Window.partitionBy("factor", "dt"))).where(F.col("n") >= least)


def ranked(values: DataFrame, least: int = 31) -> DataFrame:
    """The valid rows with ranks rf and ry."""
    by = ["factor", "dt"]
    return valid(values, least).withColumn("rf", percent_rank("value", by)).withColumn("ry", percent_rank("y", by))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation as an aggregate that never raises: NULL where either side is constant."""
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.try_divide(F.covar_pop(a, b), F.when(spread > 0, spread))


def evaluate(values: DataFrame, least: int = 31) -> DataFrame:
    """factor, dt, n, rank_ic, ls, pearson_ic: values (factor, dt, instrument, value, y).

    The long-short is the mean y of ranks above 0.8 minus that of ranks up to 0.2; the Pearson coefficient clips values at
    the factor's 1 % and 99 % quantiles over all kept rows. The values are read three times: costly ones should be written
    first."""
    rows = values.withColumn("value", finite(F.col("value"))).where("value is not null and y is not null")
    groups = rows.groupBy("factor", "dt").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("factor", "dt")  # a row a factor and date
    bounds = exact_quantiles(rows.join(F.broadcast(groups), ["factor", "dt"]).select("factor", "value"), ["factor"], "value", (0.01, 0.99))
    edge = bounds.select("factor", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))  # a row a factor
    clipped = ranked(values, least).join(F.broadcast(edge), "factor").withColumn("w", F.greatest(F.least("value", "hi"), F.col("lo")))
    return clipped.groupBy("factor", "dt").agg(
        F.count("*").alias("n"),
        correlation(F.col("rf"), F.col("ry")).alias("rank_ic"),
        (F.avg(F.when(F.col("rf") > 0.8, F.col("y"))) - F.avg(F.when(F.col("rf") <= 0.2, F.col("y")))).alias("ls"),
        correlation(F.col("w"), F.col("y")).alias("pearson_ic"),
    )


def rank_ic(values: DataFrame, least: int = 31) -> DataFrame:
    return ranked(values, least).groupBy("factor", "dt").agg(F.count("*").alias("n"), correlation(F.col("rf"), F.col("ry")).alias("rank_ic"))


def quantile_spread(values: DataFrame, q: int = 5, least: int = 50) -> DataFrame:
    """factor, dt, spread: mean y of the top 1/q by rank minus the bottom 1/q, for groups of at least `least`."""
    top, bottom = F.col("rf") > 1 - 1 / q, F.col("rf") <= 1 / q
    return ranked(values, least).groupBy("factor", "dt").agg((F.avg(F.when(top, F.col("y"))) - F.avg(F.when(bottom, F.col("y")))).alias("spread"))


def winsorise(values: DataFrame, column: str = "value", by: tuple[str, ...] = ("dt",), low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Clip to the exact quantiles of each group; infinities become NULL and NULL stays."""
    over = Window.partitionBy(*by)
    df = values.withColumn(column, finite(F.col(column)))
    lo, hi = F.percentile(column, F.lit(low)).over(over), F.percentile(column, F.lit(high)).over(over)
    return df.withColumn("__lo", lo).withColumn("__hi", hi).withColumn(column, F.when(F.col(column).isNotNull(), F.greatest(F.least(column, "__hi"), F.col("__lo")))).drop("__lo", "__hi")


def numerical_checks(values: DataFrame, max_invalid: float = 0.30, min_coverage: float = 0.30, min_unique: float = 0.10) -> DataFrame:
    """For each factor: invalid and extreme shares, mean coverage of the fullest date, median distinct values and mean share
    of distinct values of a date, and whether all pass. Values: (factor, dt, instrument, value) with NULLs in place."""
    df = values.withColumn("value", finite(F.col("value")))
    spread = exact_quantiles(df, ["factor"], "value", (0.01, 0.5, 0.99)).select("factor", "q")
    far = F.abs(F.col("value") - F.col("q")[1]) > 1e6 * F.greatest(F.abs(F.col("q")[2] - F.col("q")[0]), F.lit(1e-12))
    whole = df.join(F.broadcast(spread), "factor").groupBy("factor").agg((1 - F.count("value") / F.count("*")).alias("invalid"), F.avg(F.when(F.col("value").isNotNull(), far.cast("int"))).alias("extreme"))
    days = df.groupBy("factor", "dt").agg(F.count("value").alias("present"), F.countDistinct("value").alias("distinct"))
    most = F.greatest(F.max("present").over(Window.partitionBy("factor")), F.lit(1))
    by_day = days.withColumn("coverage", F.col("present") / most).groupBy("factor").agg(
        F.avg("coverage").alias("coverage"), F.percentile("distinct", F.lit(0.5)).alias("median_distinct"), F.avg(F.col("distinct") / F.greatest("present", F.lit(1))).alias("unique_share")
    )
    ok = (F.col("invalid") + F.coalesce("extreme", F.lit(1.0)) <= max_invalid) & (F.col("coverage") >= min_coverage) & (F.col("median_distinct") > 2) & (F.col("unique_share") >= min_unique)
    return whole.join(by_day, "factor").withColumn("passed", F.coalesce(ok, F.lit(False)))


def leak_check(panel: DataFrame, formulas: dict[str, str], cut: float = 0.6, seed: int = 1, tolerance: float = 1e-8) -> DataFrame:
    """Per formula: does scrambling the fields after a cut change values up to it? passed, worst difference, NULL mismatches.

    Both sides are evaluated in one plan; the scrambled one multiplies every later field by a hash of its cell."""
    from ..plans.compiler import evaluate as compile_and_run

    last = panel.agg(F.max("pos").alias("p"))
    fields = [c for c in panel.columns if c not in ("instrument", "dt", "pos", "__last")]
    joined = panel.join(F.broadcast(last.withColumnRenamed("p", "__last")))
    later = F.col("pos") > F.floor((F.col("__last") + 1) * cut)
    noise = lambda c: 0.5 + F.pmod(F.xxhash64(F.lit(seed), F.lit(c), "instrument", "pos"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    other = joined.select("instrument", "dt", "pos", *[F.when(later, F.col(c) * noise(c)).otherwise(F.col(c)).alias(c) for c in fields])
    a, b = (melt(compile_and_run(p, formulas, ("instrument", "pos")), list(formulas), ("instrument", "pos")).withColumnRenamed("value", v) for p, v in ((panel, "a"), (other, "b")))
    early = a.join(b, ["instrument", "pos", "factor"]).join(F.broadcast(last)).where(F.col("pos") <= F.floor((F.col("p") + 1) * cut))
    out = early.groupBy("factor").agg(F.coalesce(F.max(F.abs(F.col("a") - F.col("b"))), F.lit(0.0)).alias("worst"), F.count_if(F.col("a").isNull() != F.col("b").isNull()).alias("mismatches"))
    return out.withColumn("passed", (F.col("worst") <= tolerance) & (F.col("mismatches") == 0))


def composite(values: DataFrame, signs: DataFrame | None = None) -> DataFrame:
    """dt, instrument, score: mean over factors of sign * centred rank (signs: factor, sign; absent signs are 1)."""
    r = values.withColumn("r", centred_rank("value", ["factor", "dt"]))
    if signs is not None:
        r = r.join(F.broadcast(signs.select("factor", "sign")), "factor", "left")
    else:
        r = r.withColumn("sign", F.lit(1))
    return r.groupBy("dt", "instrument").agg(F.avg(F.col("r") * F.coalesce("sign", F.lit(1))).alias("score"))


def family_composites(values: DataFrame, families: DataFrame, least: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """family, dt, instrument, score: equal-weight signed centred ranks of families with at least `least` members, with the
    columns to `keep`, which a date and instrument have one value of. families: factor, family, sign."""
    size = families.withColumn("m", F.count("*").over(Window.partitionBy("family"))).where(F.col("m") >= least)
    r = values.withColumn("r", centred_rank("value", ["factor", "dt"])).join(F.broadcast(size), "factor")
    return r.groupBy("family", "dt", "instrument").agg(F.avg(F.col("r") * F.col("sign")).alias("score"), *[F.max(c).alias(c) for c in keep])


def global_zscore(values: DataFrame) -> DataFrame:
    """value minus the mean over the population deviation of all its factor's rows: the deliberately leaking scaling."""
    s = values.groupBy("factor").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return values.join(F.broadcast(s), "factor").withColumn("z", F.try_divide(F.col("value") - F.col("m"), F.when(F.col("s") > 0, F.col("s")))).drop("m", "s")


def dynamic_weights(ic: DataFrame, signs: DataFrame, lookback: int, horizon: int, shrink: float = 0.5) -> DataFrame:
    """dt, factor, weight: trailing mean of coefficients that were known `horizon` + 1 dates before, scaled by the sum of
    absolute values, shrunk to sign / n. ic: (dt, factor, ic) on a full grid."""
    own = Window.partitionBy("factor").orderBy("dt")
    known = ic.withColumn("known", F.lag("ic", horizon + 1).over(own))
    over = own.rowsBetween(-(lookback - 1), 0)
    trail = F.when(F.count("known").over(over) >= max(1, lookback // 2), F.avg("known").over(over))
    day = Window.partitionBy("dt")
    df = known.withColumn("trail", trail).join(F.broadcast(signs.select("factor", "sign")), "factor")
    total = F.sum(F.abs("trail")).over(day)
    n = F.count("*").over(day)
    return df.select("dt", "factor", (shrink * F.col("sign") / n + (1 - shrink) * F.coalesce(F.try_divide("trail", F.when(total > 0, total)), F.lit(0.0))).alias("weight"))


def combine(values: DataFrame, weights: DataFrame) -> DataFrame:
    """dt, instrument, score: sum of the latest weight on or before the date times the centred rank; missing weights are 0."""
    dates = values.select("dt", "factor").distinct().withColumn("weight", F.lit(None).cast("double")).withColumn("__w", F.lit(0))
    every = weights.select("dt", "factor", "weight").withColumn("__w", F.lit(1)).unionByName(dates)
    filled = every.withColumn("weight", F.last("weight", ignorenulls=True).over(Window.partitionBy("factor").orderBy("dt", F.desc("__w")).rowsBetween(Window.unboundedPreceding, 0))).where("__w = 0")
    r = values.withColumn("r", centred_rank("value", ["factor", "dt"]))
    return r.join(filled.select("dt", "factor", "weight"), ["dt", "factor"], "left").groupBy("dt", "instrument").agg(F.sum(F.col("r") * F.coalesce("weight", F.lit(0.0))).alias("score"))
