"""Price files to panels: CSV directories, audit, provider layout, universe membership."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICES = ("open", "high", "low", "close")
NUMBERS = (*PRICES, "volume", "amount", "vwap", "factor")


class RefusedData(ValueError):
    """Data with audit findings that were not overridden."""


def read_csv(spark: SparkSession, path: str, symbol_column: str | None = None) -> DataFrame:
    """instrument, dt and the number columns of one long CSV, or of a directory with a file for each instrument (its
    lower-cased stem). Headers are trimmed and lower-cased; cells that are not numbers are NULL, rows without a date go."""
    raw = spark.read.option("header", True).csv(path, pathGlobFilter="*.csv") if symbol_column is None else spark.read.option("header", True).csv(path)
    stem = F.lower(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)\.[^.]*$", 1))
    source = stem if symbol_column is None else F.lower(F.trim(F.col(symbol_column)))
    df = raw.withColumn("__instrument", source)
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    if "date" not in df.columns:
        raise RefusedData("no date column")
    numbers = [F.col(c).try_cast("double").alias(c) for c in NUMBERS if c in df.columns]
    return df.select(F.col("__instrument").alias("instrument"), F.to_date(F.col("date").try_cast("timestamp")).alias("dt"), *numbers).where("dt is not null")


def audit(bars: DataFrame) -> DataFrame:
    """Findings for each instrument: rows, duplicate dates, non-positive prices, highs below lows."""
    missing = [c for c in PRICES if c not in bars.columns]
    if missing:
        raise RefusedData(f"missing columns: {', '.join(missing)}")
    positive = F.lit(True)
    for c in PRICES:
        positive &= F.coalesce(F.col(c) > 0, F.lit(False))
    return bars.groupBy("instrument").agg(
        F.count("*").alias("n_rows"), (F.count("*") - F.countDistinct("dt")).alias("duplicate_dates"), F.count_if(~positive).alias("non_positive"), F.count_if(F.col("high") < F.col("low")).alias("high_below_low")
    )


def clean(bars: DataFrame) -> DataFrame:
    """One row for each instrument and date (the last file row wins where `row` orders them), with derived columns:
    amount = close * volume, vwap = amount / volume (NULL for no volume), factor = 1 where they are absent."""
    order = F.col("row").desc() if "row" in bars.columns else F.col("close").desc_nulls_last()
    one = bars.withColumn("__k", F.row_number().over(Window.partitionBy("instrument", "dt").orderBy(order))).where("__k = 1").drop("__k")
    have = set(bars.columns)
    amount = F.col("amount") if "amount" in have else F.lit(None).cast("double")
    one = one.withColumn("amount", F.coalesce(amount, F.col("close") * F.col("volume")))
    vwap = F.col("vwap") if "vwap" in have else F.lit(None).cast("double")
    factor = F.col("factor") if "factor" in have else F.lit(None).cast("double")
    return one.withColumn("vwap", F.coalesce(vwap, F.try_divide("amount", F.when(F.col("volume") > 0, F.col("volume"))))).withColumn("factor", F.coalesce(factor, F.lit(1.0)))


def write_provider(bars: DataFrame, path: str) -> None:
    """Tables `bars` (by year), `calendar` and `members` under a path."""
    one = clean(bars)
    one.withColumn("year", F.year("dt")).write.mode("overwrite").partitionBy("year").parquet(f"{path}/bars")
    one.select("dt").distinct().write.mode("overwrite").parquet(f"{path}/calendar")
    one.groupBy("instrument").agg(F.min("dt").alias("first"), F.max("dt").alias("last")).write.mode("overwrite").parquet(f"{path}/members")


def read_provider(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of a provider; a date range prunes the partitions by year (widen it by the formulas' look-back)."""
    df = spark.read.parquet(f"{path}/bars")
    if start:
        df = df.where((F.col("year") >= int(start[:4])) & (F.col("dt") >= F.lit(start).cast("date")))
    if end:
        df = df.where((F.col("year") <= int(end[:4])) & (F.col("dt") <= F.lit(end).cast("date")))
    return df.drop("year")


def run(spark: SparkSession, source: str, target: str, symbol_column: str | None = None, force: bool = False) -> dict:
    """Collect, audit, refuse findings unless forced, write; returns the settings of a study over the data."""
    bars = read_csv(spark, source, symbol_column)
    found = audit(bars).agg(F.sum("duplicate_dates").alias("d"), F.sum("non_positive").alias("p"), F.sum("high_below_low").alias("h"), F.count("*").alias("n")).first()
    if not force and (found["d"] or found["p"] or found["h"]):
        raise RefusedData(f"{found['d']} duplicate dates, {found['p']} non-positive prices, {found['h']} highs below lows")
    write_provider(bars, target)
    years = bars.agg(F.min(F.year("dt")).alias("a"), F.max(F.year("dt")).alias("z")).first()
    return study_settings(found["n"], years["a"], years["z"])


def study_settings(instruments: int, first_year: int, last_year: int) -> dict:
    """Discovery ends after 60 % of the years; the book holds a fifth of the names, 3 to 30."""
    topk = max(3, min(30, instruments // 5))
    return {"discovery_end": f"{first_year + int((last_year - first_year + 1) * 0.6) - 1}-12-31", "topk": topk, "keep_rank": min(instruments, 2 * topk)}


BIN_SCHEMA = T.StructType([T.StructField("instrument", T.StringType()), T.StructField("field", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("value", T.DoubleType())])


def read_bins(spark: SparkSession, path: str) -> DataFrame:
    """instrument, field, pos, value of a column-per-file store: little-endian float32, the first one the start row."""

    def unpack(frames):
        import numpy as np
        import pandas as pd

        for frame in frames:
            for file, content in zip(frame["path"], frame["content"]):
                values = np.frombuffer(content, dtype="<f4")
                if len(values):
                    instrument, name = file.rsplit("/", 2)[-2:]
                    yield pd.DataFrame({"instrument": instrument, "field": name.split(".")[0], "pos": int(values[0]) + np.arange(len(values) - 1), "value": values[1:].astype(float)})

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.day.bin").load(path).select("path", "content").mapInPandas(unpack, BIN_SCHEMA)
