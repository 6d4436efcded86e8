"""Seeded random price panels for tests and leak checks."""

from __future__ import annotations

from datetime import date, timedelta
from itertools import count, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: The draws in their order, from one generator a panel, each for all days and names at once.
DRAWS = (("move", "normal", (0.0004, 0.02)), ("above", "normal", (0, 0.01)), ("below", "normal", (0, 0.01)), ("place", "random", ()), ("volume", "lognormal", (12, 0.4)))
FIRST_PRICE, NAME = 50, "S{:03d}"
SCHEMA = "instrument string, dt date, pos int, open double, high double, low double, close double, vwap double, volume double, amount double"


def draws(days: int, names: int, seed: int) -> dict[str, np.ndarray]:
    """The random numbers of a panel by what they stand for, days by names."""
    generator = np.random.default_rng(seed)
    return {what: getattr(generator, kind)(*parameters, size=(days, names)) for what, kind, parameters in DRAWS}


def weekdays(start: str, n: int) -> list[date]:
    first = date.fromisoformat(start)
    return list(islice((d for d in (first + timedelta(days=k) for k in count()) if d.weekday() < 5), n))


def panel(spark: SparkSession, days: int = 260, names: int = 40, seed: int = 0, start: str = "2020-01-01") -> DataFrame:
    """instrument, dt, pos and the price fields: geometric walks with lognormal volume on business days. High and low lie
    a random share of the close away from it, the open at a random place between them."""
    d = draws(days, names, seed)
    dates = weekdays(start, days)
    frames = []
    for k in range(names):
        close = FIRST_PRICE * (1 + d["move"][:, k]).cumprod()
        top, bottom = close * (1 + abs(d["above"][:, k])), close * (1 - abs(d["below"][:, k]))
        frame = pd.DataFrame({"instrument": NAME.format(k), "dt": dates, "pos": range(days), "open": bottom + (top - bottom) * d["place"][:, k], "high": top, "low": bottom, "close": close})
        frames.append(frame.assign(vwap=(top + bottom + close) / 3, volume=d["volume"][:, k], amount=lambda x: x["close"] * x["volume"]))
    return spark.createDataFrame(pd.concat(frames), SCHEMA)
