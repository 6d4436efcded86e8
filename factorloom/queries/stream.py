"""The streaming bars, run to the end of their input; late rows of a finished input cannot occur, so batch SQL checks them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..catalog import query
from ..streaming import bars
from .base import BARS, rounded, sql_round


def _finished(stream):
    """The table that a stream's last batch has written; a whole result replaces the one before."""
    spark = stream.sparkSession
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or f"file://{tempfile.mkdtemp(prefix='factorloom-stream-')}"
    path = f"{base}/stream/{uuid.uuid4().hex[:12]}"
    write = lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/table")
    stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/table")


@query("stream_bars", f"WITH {BARS['user_day']} SELECT instrument, dt, {sql_round('open', 4)} AS open, {sql_round('close', 4)} AS close, {sql_round('volume', 1)} AS volume, {sql_round('amount', 3)} AS amount FROM bars")
def stream_bars(spark, sf_dir):
    out = _finished(bars.tumbling_bars(bars.read_events(spark, f"{sf_dir}/events.parquet")))
    return out.select("instrument", "dt", *[rounded(F.col(c), k).alias(c) for c, k in (("open", 4), ("close", 4), ("volume", 1), ("amount", 3))])
