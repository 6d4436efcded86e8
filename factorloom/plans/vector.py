"""The same formulas evaluated a block at a time: one group an instrument, all windows of an operator in one numpy call.

Spark recomputes a bounded frame for every row and function, which for a large batch costs far more than the data; here a
history, as long as the calendar, is one block. Results equal those of the column plan; the caller of `compiler.evaluate` chooses.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..runtime import parts, ship
from .formula import Binary, Call, Field, Minus, Node, canonical, constant


def _least(w: int) -> int:
    return max(2, w // 2)


def _finite(x: np.ndarray) -> np.ndarray:
    return np.where(np.isfinite(x), x, np.nan)


class Windows:
    """The last w rows at each row (NaN before the first); what is asked of them is computed once."""

    def __init__(self, x: np.ndarray, w: int):
        self.w, self.x = w, x
        self.rows = np.minimum(np.arange(1, len(x) + 1), w)

    @cached_property
    def v(self) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(self.w - 1, np.nan), self.x]), self.w)

    @cached_property
    def ok(self) -> np.ndarray:
        return ~np.isnan(self.v)

    @cached_property
    def n(self) -> np.ndarray:
        upto = np.concatenate([np.zeros(self.w, dtype=np.int64), np.cumsum(~np.isnan(self.x))])
        return upto[self.w :] - upto[: len(self.x)]

    @cached_property
    def sum(self) -> np.ndarray:
        return np.where(self.ok, self.v, 0.0).sum(axis=1)

    @cached_property
    def mean(self) -> np.ndarray:
        return self.sum / self.n

    @cached_property
    def apart(self) -> np.ndarray:
        return np.where(self.ok, self.v - self.mean[:, None], 0.0)

    @cached_property
    def high(self) -> np.ndarray:
        return np.where(self.ok, self.v, -np.inf).max(axis=1)

    @cached_property
    def low(self) -> np.ndarray:
        return np.where(self.ok, self.v, np.inf).min(axis=1)

    def moment(self, k: int) -> np.ndarray:
        return (self.apart**k).sum(axis=1)

    def quantile(self, q: float) -> np.ndarray:
        s = np.sort(self.v, axis=1)  # NaN last
        at = np.maximum(self.n - 1, 0) * q
        a = np.floor(at).astype(int)
        row = np.arange(len(s))
        low, high = s[row, a], s[row, np.minimum(a + 1, np.maximum(self.n - 1, 0))]
        return low + (high - low) * (at - a)

    def line(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slope, residual at the last value, share explained)."""
        t = np.where(self.ok, np.arange(self.w), 0.0)
        tm = t.sum(axis=1) / self.n
        d = np.where(self.ok, np.arange(self.w) - tm[:, None], 0.0)
        sxy, sxx, syy = (d * self.apart).sum(axis=1), (d * d).sum(axis=1), self.moment(2)
        slope = sxy / sxx
        last = self.w - 1 - np.argmax(self.ok[:, ::-1], axis=1)
        row = np.arange(len(last))
        residual = self.apart[row, last] - slope * d[row, last]
        return slope, residual, np.where(self.low < self.high, sxy**2 / (sxx * syy), np.nan)


def _skew(s: Windows) -> np.ndarray:
    n = s.n.astype(float)
    m2, m3 = s.moment(2) / n, s.moment(3) / n
    return np.where(n < 3, np.nan, np.where(s.low == s.high, 0.0, m3 / m2**1.5 * np.sqrt(n * (n - 1)) / (n - 2)))


def _kurt(s: Windows) -> np.ndarray:
    n = s.n.astype(float)
    g = s.moment(4) / n / (s.moment(2) / n) ** 2 - 3
    return np.where(n < 4, np.nan, np.where(s.low == s.high, -3.0, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g + 6)))


def _wma(s: Windows) -> np.ndarray:
    weight = np.maximum(np.arange(1, s.w + 1)[None, :] - (s.w - s.rows)[:, None], 0)
    return (np.where(s.ok, s.v, 0.0) * weight).sum(axis=1) / (s.rows * (s.rows + 1) / 2)


def _rank(s: Windows) -> np.ndarray:
    last = s.v[:, -1:]
    return np.where(np.isnan(last[:, 0]), np.nan, ((s.v < last).sum(axis=1) + ((s.v == last).sum(axis=1) + 1) / 2) / s.n)


def _index(s: Windows, extreme: np.ndarray) -> np.ndarray:
    return (np.argmax(s.v == extreme[:, None], axis=1) - (s.w - s.rows)).astype(float)


ONE = {
    "Mean": lambda s: s.mean, "Sum": lambda s: s.sum, "Var": lambda s: s.moment(2) / (s.n - 1), "Std": lambda s: np.sqrt(s.moment(2) / (s.n - 1)), "Max": lambda s: s.high, "Min": lambda s: s.low,
    "Med": lambda s: s.quantile(0.5), "Skew": _skew, "Kurt": _kurt, "Mad": lambda s: np.abs(s.apart).sum(axis=1) / s.n, "WMA": _wma, "Rank": _rank, "IdxMax": lambda s: _index(s, s.high),
    "IdxMin": lambda s: _index(s, s.low), "Slope": lambda s: s.line()[0], "Resi": lambda s: s.line()[1], "Rsquare": lambda s: s.line()[2],
}
ELEMENT = {
    "Abs": np.abs, "Sign": np.sign, "Log": lambda x: np.where(x > 0, np.log(np.where(x > 0, x, 1.0)), np.where(np.isnan(x), np.nan, np.nan)), "Greater": np.maximum, "Less": np.minimum, "Power": np.power,
    "If": lambda c, a, b: np.where(c > 0, a, b),
}


class Block:
    """Fields of one history in calendar order, and what has been computed of it."""

    def __init__(self, fields: dict[str, np.ndarray], keys: dict[int, str] | None = None):
        self.keys = {} if keys is None else keys  # of nodes by identity, shared by all histories of a task
        self.fields = {k: _finite(v) for k, v in fields.items()}
        self.size = len(next(iter(fields.values())))
        self.done: dict[str, np.ndarray] = {}
        self.windows: dict[tuple[str, int], Windows] = {}

    def key(self, node: Node) -> str:
        found = self.keys.get(id(node))
        if found is None:
            found = self.keys[id(node)] = canonical(node)
        return found

    def value(self, node: Node) -> np.ndarray:
        if (c := constant(node)) is not None:
            return np.full(self.size, float(c))
        key = self.key(node)
        if key not in self.done:
            self.done[key] = self._make(node)
        return self.done[key]

    def _windows(self, node: Node, w: int) -> Windows:
        key = self.key(node), w
        if key not in self.windows:
            self.windows[key] = Windows(_finite(self.value(node)), w)
        return self.windows[key]

    def _make(self, node: Node) -> np.ndarray:
        if isinstance(node, Field):
            return self.fields[node.name]
        if isinstance(node, Minus):
            return -self.value(node.of)
        if isinstance(node, Binary):
            a, b = self.value(node.left), self.value(node.right)
            if node.sign == "/":
                return np.where(b == 0, a * np.inf, a / np.where(b == 0, 1.0, b))
            return a + b if node.sign == "+" else a - b if node.sign == "-" else a * b
        return self._rolling(node) if node.rolling else ELEMENT[node.op](*map(self.value, node.args))

    def _rolling(self, call: Call) -> np.ndarray:
        w, x = call.window, call.series[0]
        if call.op in ("Ref", "Delta"):
            v = _finite(self.value(x))
            before = np.concatenate([np.full(min(w, self.size), np.nan), v[: max(0, self.size - w)]])
            return before if call.op == "Ref" else v - before
        if call.op == "EMA":
            return pd.Series(_finite(self.value(x))).ewm(span=w, min_periods=_least(w)).mean().to_numpy()
        if call.op in ("Corr", "Cov"):
            a, b = (_finite(self.value(s)) for s in call.series)
            both = ~np.isnan(a) & ~np.isnan(b)
            p, q = (Windows(np.where(both, s, np.nan), w) for s in (a, b))
            cross = (p.apart * q.apart).sum(axis=1)
            spread = np.sqrt(p.moment(2) * q.moment(2))
            out = cross / (p.n - 1) if call.op == "Cov" else np.where((p.low < p.high) & (q.low < q.high) & (spread > 0), cross / np.where(spread > 0, spread, 1.0), np.nan)
            return np.where(p.n >= _least(w), out, np.nan)
        s = self._windows(x, w)
        out = s.quantile(float(constant(call.args[2]))) if call.op == "Quantile" else ONE[call.op](s)
        return np.where(s.n >= _least(w), out, np.nan)


def apply(panel: DataFrame, roots: dict[str, Node], keep: tuple[str, ...], used: list[str]) -> DataFrame:
    """The panel's `keep` columns and one column for each formula."""
    ship(panel.sparkSession)
    columns = list(dict.fromkeys([*keep, "instrument", "pos", *used]))
    schema = T.StructType([*(panel.schema[c] for c in keep), *(T.StructField(name, T.DoubleType()) for name in roots)])
    keys: dict[int, str] = {}

    def run(history: pa.Table) -> pa.Table:
        history = history.sort_by("pos")
        with np.errstate(all="ignore"):
            block = Block({f: history[f].cast(pa.float64()).to_numpy() for f in used}, keys)
            made = [pa.array(_finite(block.value(root)), from_pandas=True) for root in roots.values()]
        return pa.Table.from_arrays([*(history[c] for c in keep), *made], [*keep, *roots])

    # a history costs far more than its bytes, so the exchange keeps its number of tasks
    return panel.select(*columns).repartition(parts(panel.sparkSession), "instrument").groupBy("instrument").applyInArrow(run, schema)
