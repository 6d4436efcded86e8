"""Bars from a stream of trades: tumbling windows with a watermark, and a stateful moving average for each user."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 10) -> DataFrame:
    """A stream over a folder of event files; the pattern lets a single file stand for a folder of one."""
    stored = spark.read.parquet(path).schema
    return spark.readStream.schema(stored).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path[:-1]}[{path[-1]}]").withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_bars(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """instrument, start, open, high, low, close, volume, amount; rows later than the watermark are dropped."""
    order = F.struct("ts", "event_id")
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), F.col("user_id").cast("string").alias("instrument"))
        .agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").cast("double").alias("volume"), F.sum("value").alias("amount"))
        .select("instrument", F.to_date("w.start").alias("dt"), "open", "high", "low", "close", "volume", "amount")
    )


def running_average(events: DataFrame, span: int = 10) -> DataFrame:
    """user_id, n, average: exponential average in order of arrival, one small state a user."""
    keep = 1 - 2.0 / (span + 1)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, top, bottom = state.get if state.exists else (0, 0.0, 0.0)
        for frame in frames:
            for v in frame.sort_values(["ts", "event_id"])["value"]:
                n, top, bottom = n + 1, top * keep + v, bottom * keep + 1
        state.update((n, top, bottom))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "average": [top / bottom if bottom else 0.0]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, average double", "n long, top double, bottom double", "update", "NoTimeout")
