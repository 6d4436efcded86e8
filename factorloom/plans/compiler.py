"""Formulas to Column plans: one DAG for a whole batch, staged by window depth.

Every distinct subtree that a window needs is one column, shared by all formulas through its canonical form. Elementwise
parts are inlined; each level of rolling operators is one projection. All windows share the partition (instrument) and
the order (pos), so the plan has one exchange and one sort whatever the number of formulas.

Missing values are NULL; infinities live between elementwise operators and are scrubbed where a rolling operator takes
them in and at the end. Frames end at the current row; only `label` looks ahead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .formula import Binary, Call, Field, Minus, Node, Number, canonical, constant, parse

KEYS = ("instrument", "dt", "pos")
INF = float("inf")


def least_seen(w: int) -> int:
    return max(2, w // 2)


def finite(x: Column) -> Column:
    """NULL for infinities and NaN."""
    return F.when((F.abs(x) < INF), x)


def divide(a: Column, b: Column) -> Column:
    """a / b with signed infinities for division by zero and NaN for 0 / 0; never raises under ANSI. The second branch is
    reached for b = 0, or where a or b is NULL and so it is too."""
    return F.coalesce(F.try_divide(a, b), a * (b * 0 + F.lit(INF)))


class Frames:
    """Window specs of a panel; `centred` gives the deliberately leaking frames of the protocol audit."""

    def __init__(self, centred: bool = False):
        self.centred = centred
        self.order = Window.partitionBy("instrument").orderBy("pos")

    def rows(self, w: int) -> WindowSpec:
        return self.order.rowsBetween(-(w // 2), (w - 1) // 2) if self.centred else self.order.rowsBetween(-(w - 1), 0)


def _rolled(x: Column, w: int, frames: Frames, value: Column) -> Column:
    return F.when(F.count(x).over(frames.rows(w)) >= least_seen(w), value)


def _plain(aggregate: Callable[[Column], Column]):
    return lambda x, w, fr: _rolled(x, w, fr, aggregate(x).over(fr.rows(w)))


def _skew(x: Column, w: int, fr: Frames) -> Column:
    over = fr.rows(w)
    n = F.count(x).over(over).cast("double")
    flat = F.min(x).over(over) == F.max(x).over(over)
    value = F.when(flat, 0.0).otherwise(F.skewness(x).over(over) * F.sqrt(n * (n - 1)) / (n - 2))
    return F.when(n >= max(3, least_seen(w)), value)


def _kurt(x: Column, w: int, fr: Frames) -> Column:
    over = fr.rows(w)
    n = F.count(x).over(over).cast("double")
    flat = F.min(x).over(over) == F.max(x).over(over)
    value = F.when(flat, -3.0).otherwise((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x).over(over) + 6))
    return F.when(n >= max(4, least_seen(w)), value)


def _mad(x: Column, w: int, fr: Frames) -> Column:
    over = fr.rows(w)
    mean = F.avg(x).over(over)
    apart = F.aggregate(F.collect_list(x).over(over), F.lit(0.0), lambda s, v: s + F.abs(v - mean))
    return _rolled(x, w, fr, apart / F.count(x).over(over))


def ema_rows(w: int) -> int:
    """Rows after which a weight is below 1e-12 of the first."""
    return int(14 * w) + 8


def _ema(x: Column, w: int, fr: Frames) -> Column:
    """Weighted sums over a bounded frame. Weights are powers relative to the start of a segment as long as the frame, so
    that they neither overflow nor vanish; a frame touches the row's own segment and the one before."""
    keep, length = 1 - 2.0 / (w + 1), ema_rows(w)
    over = fr.order.rowsBetween(-(length - 1), 0)
    at, odd = F.col("pos") % length, F.floor(F.col("pos") / length) % 2
    grown = F.when(x.isNotNull(), F.pow(F.lit(1 / keep), at.cast("double")))
    part = lambda value, parity: F.coalesce(F.sum(F.when(odd == parity, value)).over(over), F.lit(0.0))
    back = F.lit(keep**length)

    def total(value: Column) -> Column:
        even, uneven = part(value, 0), part(value, 1)
        return F.when(odd == 0, even + uneven * back).otherwise(uneven + even * back)

    bottom = total(grown)
    enough = F.count(x).over(fr.order.rowsBetween(Window.unboundedPreceding, 0)) >= least_seen(w)
    return F.when(enough, F.try_divide(total(x * grown), F.when(bottom > 0, bottom)))


def _wma(x: Column, w: int, fr: Frames) -> Column:
    over = fr.rows(w)
    n = F.count(F.lit(1)).over(over).cast("double")
    first = F.min("pos").over(over) - 1
    weighted = F.sum(x * F.col("pos")).over(over) - first * F.sum(x).over(over)
    return _rolled(x, w, fr, weighted / (n * (n + 1) / 2))


def _rank(x: Column, w: int, fr: Frames) -> Column:
    over = fr.rows(w)
    seen = F.collect_list(x).over(over)
    last = F.last(x).over(over)
    below = F.aggregate(seen, F.lit(0), lambda s, v: s + (v < last).cast("int"))
    same = F.aggregate(seen, F.lit(0), lambda s, v: s + (v == last).cast("int"))
    return F.when(last.isNotNull(), _rolled(x, w, fr, (below + (same + 1) / 2.0) / F.count(x).over(over)))


def _index(sign: int):
    def compiled(x: Column, w: int, fr: Frames) -> Column:
        over = fr.rows(w)
        first = F.min(F.when(x.isNotNull(), F.struct((x * sign).alias("v"), F.col("pos").alias("p")))).over(over)["p"]
        return _rolled(x, w, fr, (first - F.min("pos").over(over)).cast("double"))

    return compiled


def _resi(x: Column, w: int, fr: Frames) -> Column:
    over = fr.rows(w)
    at = F.col("pos").cast("double")
    line = F.regr_intercept(x, at).over(over) + F.regr_slope(x, at).over(over) * F.last(F.when(x.isNotNull(), at), ignorenulls=True).over(over)
    return _rolled(x, w, fr, F.last(x, ignorenulls=True).over(over) - line)


def _rsquare(x: Column, w: int, fr: Frames) -> Column:
    over = fr.rows(w)
    return F.when(F.min(x).over(over) < F.max(x).over(over), _rolled(x, w, fr, F.regr_r2(x, F.col("pos").cast("double")).over(over)))


def _pairwise(a: Column, b: Column) -> tuple[Column, Column]:
    return F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)


def _cov(a: Column, b: Column, w: int, fr: Frames) -> Column:
    a, b = _pairwise(a, b)
    return _rolled(a, w, fr, F.covar_samp(a, b).over(fr.rows(w)))


def _corr(a: Column, b: Column, w: int, fr: Frames) -> Column:
    a, b = _pairwise(a, b)
    over = fr.rows(w)
    spread = F.stddev_samp(a).over(over) * F.stddev_samp(b).over(over)
    return _rolled(a, w, fr, F.try_divide(F.covar_samp(a, b).over(over), F.when(spread > 0, spread)))


#: Rolling operators: series columns, window and frames to a column. Adding an entry (and its arity) extends the language.
ROLLING: dict[str, Callable[..., Column]] = {
    "Ref": lambda x, w, fr: F.lag(x, w).over(fr.order),
    "Delta": lambda x, w, fr: x - F.lag(x, w).over(fr.order),
    "Mean": _plain(F.avg),
    "Sum": _plain(F.sum),
    "Std": _plain(F.stddev_samp),
    "Var": _plain(F.var_samp),
    "Max": _plain(F.max),
    "Min": _plain(F.min),
    "Med": _plain(lambda x: F.percentile(x, F.lit(0.5))),
    "Skew": _skew,
    "Kurt": _kurt,
    "Mad": _mad,
    "EMA": _ema,
    "WMA": _wma,
    "Rank": _rank,
    "IdxMax": _index(-1),
    "IdxMin": _index(1),
    "Slope": lambda x, w, fr: _rolled(x, w, fr, F.regr_slope(x, F.col("pos").cast("double")).over(fr.rows(w))),
    "Rsquare": _rsquare,
    "Resi": _resi,
    "Corr": _corr,
    "Cov": _cov,
}


def _both(a: Column, b: Column, value: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b), value)


ELEMENT: dict[str, Callable[..., Column]] = {
    "Abs": F.abs,
    "Sign": F.signum,
    "Log": lambda x: F.when(x > 0, F.ln(x)),
    "Greater": lambda a, b: _both(a, b, F.greatest(a, b)),
    "Less": lambda a, b: _both(a, b, F.least(a, b)),
    "Power": lambda a, b: F.pow(a, b),
    "If": lambda c, a, b: F.when((c > 0) & ~F.isnan(c), a).otherwise(b),
}
_ARITHMETIC = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": divide}


class Batch:
    """Formulas compiled together; `sources` maps fields to columns of the panel."""

    def __init__(self, formulas: Mapping[str, str | Node], centred: bool = False):
        self.roots = {k: parse(v) if isinstance(v, str) else v for k, v in formulas.items()}
        self.frames = Frames(centred)
        self.levels: dict[int, dict[str, Call]] = {}
        for name, root in self.roots.items():
            if not any(isinstance(n, Field) for n in self._every(root)):
                raise ValueError(f"{name} depends on no field")
            self._level(root)

    @staticmethod
    def _every(node: Node):
        stack = [node]
        while stack:
            n = stack.pop()
            yield n
            stack += n.parts()

    @staticmethod
    def column_of(node: Node) -> str:
        return "r_" + hashlib.sha1(canonical(node).encode()).hexdigest()[:16]

    def _level(self, node: Node) -> int:
        level = max(map(self._level, node.series if isinstance(node, Call) else node.parts()), default=0)
        if isinstance(node, Call) and node.rolling:
            level += 1
            self.levels.setdefault(level, {})[self.column_of(node)] = node
        return level

    def expression(self, node: Node) -> Column:
        """Column of a node over fields and the rolling columns made so far."""
        if (v := constant(node)) is not None:
            return F.lit(float(v))
        if isinstance(node, Field):
            return F.col(node.name)
        if isinstance(node, Minus):
            return -self.expression(node.of)
        if isinstance(node, Binary):
            return _ARITHMETIC[node.sign](self.expression(node.left), self.expression(node.right))
        if node.rolling:
            return F.col(self.column_of(node))
        return ELEMENT[node.op](*map(self.expression, node.args))

    def input_of(self, node: Node) -> str:
        """The column that holds a rolling operator's input."""
        if isinstance(node, Field):
            return node.name
        return self.column_of(node) if isinstance(node, Call) and node.rolling else "i" + self.column_of(node)

    def rolling(self, call: Call) -> Column:
        series = [F.col(self.input_of(s)) for s in call.series]
        if call.op == "Quantile":
            q = float(constant(call.args[2]))
            return _plain(lambda x: F.percentile(x, F.lit(q)))(series[0], call.window, self.frames)
        return ROLLING[call.op](*series, call.window, self.frames)

    def apply(self, panel: DataFrame, keep: tuple[str, ...] = ("instrument", "dt")) -> DataFrame:
        """The panel's `keep` columns and one column for each formula."""
        used = sorted({n.name for root in self.roots.values() for n in self._every(root) if isinstance(n, Field)})
        df = panel.withColumns({f: finite(F.col(f).cast("double")) for f in used})
        for level in sorted(self.levels):
            inputs = {self.input_of(s): s for call in self.levels[level].values() for s in call.series}
            fresh = {name: finite(self.expression(s)) for name, s in sorted(inputs.items()) if name not in df.columns}
            df = df.withColumns(fresh) if fresh else df  # once a column, however often a window function needs it
            df = df.withColumns({name: self.rolling(call) for name, call in sorted(self.levels[level].items())})
        return df.select(*keep, *[finite(self.expression(root)).alias(name) for name, root in self.roots.items()])


def evaluate(panel: DataFrame, formulas: Mapping[str, str] | str, keep: tuple[str, ...] = ("instrument", "dt"), centred: bool = False, engine: str = "columns") -> DataFrame:
    """Values of formulas over a dense panel (instrument, dt, pos and the fields).

    `engine` is "columns" (window expressions, whatever the batch) or "blocks" (one history at a time, see vector.py, which
    large batches are faster in). Both give the same values; centred frames exist as columns only."""
    if engine not in ("columns", "blocks") or (centred and engine == "blocks"):
        raise ValueError(f"no engine {engine} for these frames")
    batch = Batch({"value": formulas} if isinstance(formulas, str) else formulas, centred)
    if engine == "columns":
        return batch.apply(panel, keep)
    from . import vector

    used = sorted({n.name for root in batch.roots.values() for n in batch._every(root) if isinstance(n, Field)})
    return vector.apply(panel, batch.roots, keep, used)


def label(x: Column, horizon: int, lag: int = 1) -> Column:
    """Forward return from `lag` to `lag + horizon` rows ahead: the only expression that may look ahead."""
    order = Window.partitionBy("instrument").orderBy("pos")
    return finite(divide(F.lead(x, lag + horizon).over(order), F.lead(x, lag).over(order)) - 1)


def look_back(node: Node | str) -> int:
    """Rows before the current one that a formula can see; a date filter on a scan must be widened by it."""
    node = parse(node) if isinstance(node, str) else node
    inner = max(map(look_back, node.series if isinstance(node, Call) else node.parts()), default=0)
    if isinstance(node, Call) and node.rolling:
        own = node.window if node.op in ("Ref", "Delta") else ema_rows(node.window) if node.op == "EMA" else node.window - 1
        return inner + own
    return inner


__all__ = ["Batch", "ELEMENT", "Frames", "Number", "ROLLING", "divide", "evaluate", "finite", "label", "least_seen", "look_back"]
