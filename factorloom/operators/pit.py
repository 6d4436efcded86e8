"""Point-in-time data: what was known when.

Rows are (key, tag, period, filed, value): `period` is what a value is about, `filed` when it became known. Two rules of
"latest" exist and differ where an old period is restated late: `as_of` takes the latest period, then its latest filing;
`latest_filed` takes the latest filing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .crosssection import centred_rank, exact_quantiles, winsorise


def reporting_lag(rows: DataFrame) -> DataFrame:
    return rows.withColumn("lag_days", F.datediff("filed", "period"))


def as_of(rows: DataFrame, day: Column) -> DataFrame:
    """key, tag, value, period, filed: the value of the latest period known on `day`, as last filed by then."""
    known = rows.where((F.col("filed") <= day) & F.col("value").isNotNull())
    return known.groupBy("key", "tag").agg(F.max_by(F.struct("value", "period", "filed"), F.struct("period", "filed", "value")).alias("r")).select("key", "tag", "r.*")


def latest_filed(rows: DataFrame, day: Column) -> DataFrame:
    """The value filed last by `day`, whatever its period."""
    known = rows.where((F.col("filed") <= day) & F.col("value").isNotNull())
    return known.groupBy("key", "tag").agg(F.max_by(F.struct("value", "period", "filed"), F.struct("filed", "period", "value")).alias("r")).select("key", "tag", "r.*")


def panel(rows: DataFrame, dates: DataFrame) -> DataFrame:
    """key, tag, dt, value: the value filed last on or before each date (dates: dt), for keys and tags that have any.

    Filings and dates are one stream for each key and tag; the last non-NULL value is carried forward."""
    one = rows.where("value is not null").groupBy("key", "tag", F.col("filed").alias("dt")).agg(F.max_by("value", F.struct("period", "value")).alias("value"))
    days = dates.select("dt").distinct().agg(F.collect_list("dt").alias("days"))  # as long as the calendar
    asked = one.select("key", "tag").distinct().join(F.broadcast(days)).select("key", "tag", F.explode("days").alias("dt")).withColumn("value", F.lit(None).cast("double")).withColumn("asked", F.lit(1))
    every = one.withColumn("asked", F.lit(0)).unionByName(asked)
    over = Window.partitionBy("key", "tag").orderBy("dt", "asked").rowsBetween(Window.unboundedPreceding, 0)
    return every.withColumn("value", F.last("value", ignorenulls=True).over(over)).where("asked = 1 and value is not null").drop("asked")


def restatements(rows: DataFrame) -> DataFrame:
    """Rows whose key, tag and period were filed more than once; all filings are kept."""
    return rows.withColumn("filings", F.count("*").over(Window.partitionBy("key", "tag", "period"))).where("filings > 1")


def coverage(panel_rows: DataFrame, keys: int) -> DataFrame:
    """tag, dt, share of keys that have a value."""
    return panel_rows.groupBy("tag", "dt").agg((F.count("value") / F.lit(keys)).alias("coverage"))


def quality_report(rows: DataFrame) -> DataFrame:
    """For each tag: rows, keys, lag median, 90 % and maximum, negative lags, restated rows, outliers (more than 20 times the
    interquartile range from the median)."""
    lagged = reporting_lag(rows).withColumn("restated", (F.count("*").over(Window.partitionBy("key", "tag", "period")) > 1).cast("int"))
    q = exact_quantiles(rows, ["tag"], "value", (0.25, 0.5, 0.75)).select("tag", "q")
    far = F.abs(F.col("value") - F.col("q")[1]) > 20 * (F.col("q")[2] - F.col("q")[0] + 1e-9)
    return lagged.join(F.broadcast(q), "tag").groupBy("tag").agg(
        F.count("*").alias("n_rows"), F.countDistinct("key").alias("n_keys"), F.percentile("lag_days", F.lit(0.5)).alias("lag_median"), F.percentile("lag_days", F.lit(0.9)).alias("lag_p90"),
        F.max("lag_days").alias("lag_max"), F.count_if(F.col("lag_days") < 0).alias("negative_lags"), F.sum("restated").alias("restated"), F.count_if(far).alias("outliers"),
    )


def warnings(report: dict) -> list[str]:
    """What a report says against its data."""
    found = []
    if report["negative_lags"]:
        found.append(f"{report['negative_lags']} values were known before their period ended")
    if report["lag_p90"] is not None and report["lag_p90"] > 180:
        found.append("a tenth of the values came half a year late or later")
    if report["n_rows"] and report["outliers"] / report["n_rows"] > 0.01:
        found.append("more than 1 % of the values are outliers")
    if report["n_rows"] and report["restated"] / report["n_rows"] > 0.5:
        found.append("most values were restated")
    return found


def delisting_calendar(filings: DataFrame) -> DataFrame:
    """key, delisted: the first filing of each key."""
    return filings.groupBy("key").agg(F.min("filed").alias("delisted"))


def parse_form_index(spark: SparkSession, path: str) -> DataFrame:
    """form, company, cik, filed of the delisting forms in a fixed-width index; other lines do not match."""
    line = spark.read.text(path)
    cut = lambda a, n: F.trim(F.substring("value", a, n))
    rows = line.select(cut(1, 12).alias("form"), cut(13, 62).alias("company"), cut(75, 12).try_cast("long").alias("cik"), cut(87, 12).try_cast("date").alias("filed"))
    return rows.where(F.col("form").isin("25", "25-NSE") & F.col("cik").isNotNull() & F.col("filed").isNotNull())


def parse_statements(spark: SparkSession, submissions: str, numbers: str, tags: list[str]) -> DataFrame:
    """key, adsh, tag, period, filed, value, form of a quarter's tab-separated submission and number files (unzipped)."""
    read = lambda p: spark.read.option("sep", "\t").option("header", True).csv(p)
    date = lambda c: F.to_date(F.try_to_timestamp(c, F.lit("yyyyMMdd")))
    sub = read(submissions).select("adsh", F.col("cik").try_cast("long").alias("key"), "form", date("filed").alias("filed"))
    num = read(numbers).where(F.col("tag").isin(tags) & F.col("uom").isin("USD", "shares")).select("adsh", "tag", date("ddate").alias("period"), F.col("value").try_cast("double").alias("value"))
    return num.where("value is not null").join(sub, "adsh").where("filed is not null and key is not null").select("key", "adsh", "tag", "period", "filed", "value", "form")


def statement_url(year: int, quarter: int) -> str:
    return f"https://www.sec.gov/files/dera/data/financial-statement-data-sets/{year}q{quarter}.zip"


def market_cap(prices: DataFrame, shares: DataFrame) -> DataFrame:
    """key, dt, cap: price times the shares known on the date."""
    return prices.join(shares.select("key", "dt", F.col("value").alias("shares")), ["key", "dt"]).select("key", "dt", (F.col("close") * F.col("shares")).alias("cap"))


#: Fundamental ratios as (name, numerator tag, denominator, expected sign); 'cap' is market value.
RATIOS = (
    ("earnings_yield", "NetIncomeLoss", "cap", 1),
    ("book_to_market", "StockholdersEquity", "cap", 1),
    ("sales_yield", "Revenues", "cap", 1),
    ("cash_flow_yield", "NetCashProvidedByUsedInOperatingActivities", "cap", 1),
    ("return_on_equity", "NetIncomeLoss", "StockholdersEquity", 1),
    ("gross_profitability", "GrossProfit", "Assets", 1),
    ("leverage", "Liabilities", "Assets", -1),
)
GROWTH_ROWS = 250


def fundamentals(wide: DataFrame) -> DataFrame:
    """The ratios over a wide point-in-time panel (key, dt, cap and one column a tag), each clipped to its date's 1 % and 99 %
    quantiles; asset growth compares with GROWTH_ROWS rows before. Tags that are absent leave their ratios out."""
    have = set(wide.columns)
    df, names = wide, []
    for name, top, bottom, _ in RATIOS:
        if {top, bottom} <= have:
            df = df.withColumn(name, F.try_divide(F.col(top), F.when(F.col(bottom) > 0, F.col(bottom))))
            names.append(name)
    if "Assets" in have:
        before = F.lag("Assets", GROWTH_ROWS).over(Window.partitionBy("key").orderBy("dt"))
        df = df.withColumn("asset_growth", F.try_divide(F.col("Assets"), F.when(before > 0, before)) - 1)
        names.append("asset_growth")
    for name in names:
        df = winsorise(df, name)
    return df.select("key", "dt", *names)


def fundamental_composite(ratios: DataFrame) -> DataFrame:
    """key, dt, score: mean signed centred rank of the ratios that are there (asset growth counts against)."""
    sign = {n: s for n, _, _, s in RATIOS} | {"asset_growth": -1}
    names = [c for c in ratios.columns if c in sign]
    total = sum((sign[n] * centred_rank(n, ["dt"]) for n in names), F.lit(0.0))
    return ratios.select("key", "dt", (total / max(1, len(names))).alias("score"))


def timing_inflation(values: DataFrame, label: str = "y") -> DataFrame:
    """dt, honest, leaky: rank coefficients of the value known on the date and of the value its period had, side by side.
    values: (dt, instrument, known, true, y)."""
    from .crosssection import rank_ic

    long = values.unpivot(["dt", "instrument", label], ["known", "true"], "factor", "value").withColumnRenamed(label, "y")
    ic = rank_ic(long)
    return ic.groupBy("dt").agg(F.max(F.when(F.col("factor") == "known", F.col("rank_ic"))).alias("honest"), F.max(F.when(F.col("factor") == "true", F.col("rank_ic"))).alias("leaky"))
