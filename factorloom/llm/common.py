"""Shared plumbing: the shared folder, row keys, sharding by a sorted key, Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import parts, remove, scratch, ship, shared_root


def save(df: DataFrame, label: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """Write a table to the shared folder and read it back: later reads survive a lost executor."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _tidy() -> None:
    """Give memory that a task no longer uses back to the system: workers outlive tasks, and stages follow one another."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every system has it
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The same function over Arrow batches, which tidies up behind itself."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _tidy()

    return tidy


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_of_id(column: str | Column) -> Column:
    """crc32 of an id's decimal text; a null id counts as the empty text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


ROW_KEY = ["__fl_id", "__fl_null", "__fl_text"]


def row_key(id_col: str, text_hash: Column) -> list[Column]:
    """Null-safe key of a row by id and text, for plain equi-joins; rows that share it are the same document."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias(ROW_KEY[0]), F.col(id_col).isNull().alias(ROW_KEY[1]), text_hash.alias(ROW_KEY[2])]


LOWEST = int(np.iinfo(np.int64).min)


class Ranges:
    """Ascending bounds of ranges of (key, tie), both long and null keys lowest: `count` of them. A key that fills several
    ranges is cut by its ties; rows equal in both may lie in any range that ends or begins with them."""

    def __init__(self, bounds: list[tuple[int, int]]):
        bounds = sorted(bounds)
        self.key = np.array([k for k, _ in bounds], dtype=np.int64)
        self.tie = np.array([t for _, t in bounds], dtype=np.int64)
        self.count = len(bounds) + 1
        self.dealt = 0  # rows that could go to several ranges take turns

    def of(self, keys: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Range of each row."""
        out = np.searchsorted(self.key, keys, side="right").astype(np.int32)
        low = np.searchsorted(self.key, keys, side="left")
        for i in np.flatnonzero(out > low):  # a bound has the row's key
            a, b = int(low[i]), int(out[i])
            first, last = a + np.searchsorted(self.tie[a:b], ties[i], side="left"), a + np.searchsorted(self.tie[a:b], ties[i], side="right")
            if last - first > 1:
                self.dealt += 1
                last = first + 1 + self.dealt % (last - first)
            out[i] = last
        return out


def ranges(df: DataFrame, key: str, tie: str, shards: int) -> Ranges:
    """At most `shards` ranges of about equal numbers of rows. The driver gets one bounded sketch of the keys and, where a
    key fills several ranges, one of the ties of such keys."""
    if shards < 2:
        return Ranges([])
    quantiles = lambda column, at: F.percentile_approx(column, [float(x) for x in at], 10_000)
    keys = df.select(F.coalesce(F.col(key), F.lit(LOWEST)).alias("k"), F.col(tie).alias("t"))
    found = keys.agg(quantiles("k", np.arange(1, shards) / shards).alias("q")).first()["q"] or []
    value, times = np.unique(np.array(found, dtype=np.int64), return_counts=True)
    bounds = [(int(v), LOWEST) for v in value]
    hot = {int(v): int(n) for v, n in zip(value, times) if n > 1}
    if hot:
        most = max(hot.values())
        cut = keys.where(F.col("k").isin(list(hot))).groupBy("k").agg(quantiles("t", np.arange(1, most + 1) / (most + 1)).alias("q"))
        for r in cut.collect():  # fewer than `shards` rows
            each = hot[r["k"]]
            bounds += [(r["k"], int(r["q"][i * (most + 1) // each - 1])) for i in range(1, each)]
    return Ranges(bounds)


_ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


@lru_cache(64)
def arrow(ddl: str) -> pa.Schema:
    """The Arrow schema of 'name type, ...'; types are those of _ARROW and arrays of them."""
    fields = []
    for item in ddl.split(", "):
        name, kind = item.split()
        fields.append((name, pa.list_(_ARROW[kind[6:-1]]) if kind.startswith("array<") else _ARROW[kind]))
    return pa.schema(fields)


def batch(ddl: str, *columns) -> pa.RecordBatch:
    """A record batch of columns in the order of `ddl`."""
    schema = arrow(ddl)
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) and c.type == f.type else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def chunks(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(first row, number of rows) of consecutive stretches of a column of at most `most` bytes, or of one longer text."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi - lo
        lo = hi


__all__ = ["LOWEST", "ROW_KEY", "Ranges", "arrow", "batch", "chunks", "crc32_of_id", "parts", "remove", "ranges", "row_key", "save", "scratch", "shared_root", "ship", "table", "tidied"]
