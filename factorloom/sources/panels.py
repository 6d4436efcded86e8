"""Bars from transaction tables and dense panels.

A panel is long: instrument, dt, pos (0-based row of the calendar) and the price fields; an absent bar is a row of NULLs,
so that a frame of w rows is w bars of the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import parts

FIELDS = ("open", "high", "low", "close", "vwap", "volume", "amount")
def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem_bars(spark: SparkSession, sf_dir: str, instrument: str, unit: str) -> DataFrame:
    """Bars of unit prices: volume, amount, vwap = close, and the first price of the bar as open."""
    t = read(spark, sf_dir, "lineitem").where(F.col("l_quantity") > 0)
    price = F.col("l_extendedprice") / F.col("l_quantity")
    first = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    bars = t.groupBy(F.col(instrument).cast("string").alias("instrument"), F.to_date(F.date_trunc(unit, "l_shipdate")).alias("dt")).agg(
        F.min(first).alias("f"), F.max(price).alias("high"), F.min(price).alias("low"), F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("amount")
    )
    close = F.col("amount") / F.col("volume")
    return bars.select("instrument", "dt", (F.col("f.l_extendedprice") / F.col("f.l_quantity")).alias("open"), "high", "low", close.alias("close"), close.alias("vwap"), "volume", "amount")


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of event values by user."""
    t = read(spark, sf_dir, "events")
    order = F.struct("ts", "event_id")
    bars = t.groupBy(F.col("user_id").cast("string").alias("instrument"), F.to_date("ts").alias("dt")).agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"),
        F.count("*").cast("double").alias("volume"), F.sum("value").alias("amount"),
    )
    return bars.select("instrument", "dt", "open", "high", "low", "close", (F.col("amount") / F.col("volume")).alias("vwap"), "volume", "amount")


def part_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem_bars(spark, sf_dir, "l_partkey", "quarter")


def supp_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem_bars(spark, sf_dir, "l_suppkey", "week")


def user_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_bars(spark, sf_dir)


def calendar(bars: DataFrame) -> DataFrame:
    """dt, pos: the distinct dates in order. The single-task rank sees one row a date."""
    return bars.select("dt").distinct().withColumn("pos", F.row_number().over(Window.orderBy("dt")) - 1)


def densify(bars: DataFrame) -> DataFrame:
    """Every instrument on every date of the calendar, dealt by instrument; absent bars are NULL.

    A bar stands for itself and for the empty dates up to the next one, the first also for those before it, so that the
    grid comes out of one exchange by instrument, which later windows reuse. The calendar, a row a date, is broadcast. The
    exchange keeps its number of tasks: what follows it costs far more a row than its size tells."""
    dates = calendar(bars)
    own = Window.partitionBy("instrument").orderBy("__at")
    placed = bars.join(F.broadcast(dates.select("dt", F.col("pos").alias("__at"), F.count("*").over(Window.partitionBy()).alias("__n"))), "dt").drop("dt")
    dealt = placed.repartition(parts(bars.sparkSession), "instrument")
    first = F.when(F.lag("__at").over(own).isNull(), 0).otherwise(F.col("__at"))
    last = F.coalesce(F.lead("__at").over(own), F.col("__n").cast("int")) - 1
    cells = dealt.withColumn("__first", first).withColumn("__last", last).withColumn("pos", F.explode(F.sequence("__first", "__last")))
    fields = [c for c in bars.columns if c not in ("instrument", "dt")]
    here = F.col("pos") == F.col("__at")
    return cells.join(F.broadcast(dates), "pos").select("instrument", "dt", "pos", *[F.when(here, F.col(c)).alias(c) for c in fields])


def members(bars: DataFrame) -> DataFrame:
    """instrument, first, last: the span of dates in which an instrument trades."""
    return bars.groupBy("instrument").agg(F.min("dt").alias("first"), F.max("dt").alias("last"))


def universe(membership: DataFrame, start: Column, end: Column) -> DataFrame:
    """Distinct instruments that were members at any time from `start` to `end`."""
    return membership.where((F.col("first") <= end) & (F.col("last") >= start)).select("instrument").distinct()


def average_dollar_volume(panel: DataFrame, rows: int = 20, scale: float = 1.0) -> DataFrame:
    """instrument, dt, adv: mean of close * volume over full windows only."""
    over = Window.partitionBy("instrument").orderBy("pos").rowsBetween(-(rows - 1), 0)
    value = F.col("close") * F.col("volume") * scale
    return panel.select("instrument", "dt", F.when(F.count(value).over(over) == rows, F.avg(value).over(over)).alias("adv"))


def benchmark(bars: DataFrame) -> DataFrame:
    """dt, pos, close: the mean close of all instruments on a date."""
    return bars.groupBy("dt").agg(F.avg("close").alias("close")).withColumn("pos", F.row_number().over(Window.orderBy("dt")) - 1)


def last_date(bars: DataFrame) -> DataFrame:
    return bars.agg(F.max("dt").alias("last_date"))


def sessions_after(bars: DataFrame, horizon: int) -> DataFrame:
    """signal_date, trade_date (the next session) and end_date (`horizon` sessions later, NULL past the end)."""
    over = Window.orderBy("pos")  # one row a date
    return (
        calendar(bars)
        .select(F.col("dt").alias("signal_date"), F.lead("dt", 1).over(over).alias("trade_date"), F.lead("dt", 1 + horizon).over(over).alias("end_date"))
        .where(F.col("trade_date").isNotNull())
    )
