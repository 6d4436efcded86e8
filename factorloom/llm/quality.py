"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad; its potentials see its own features and those of the lines before and after. Labels exist for
documents only, so every line of a training document carries the document's label. Forward-backward gives each line's
marginal of being good; the length-weighted mean over lines, calibrated by a logistic curve, is the document's score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Bound of the sample that the model is fitted on: so many whole documents of each label.
DOCS_OF_LABEL = 600
ITERATIONS = 60
L2 = 1e-2
KEEP = 0.7

OWN = 15
FEATURES = 1 + 3 * OWN + 2
SCORE_SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_lines long, n_good_lines long"
SAMPLE_SCHEMA = "label int, lines binary, lengths array<int>"
_SYMBOL = re.compile(r"[^\w\s]")
_DOUBLE = re.compile(r"([^\w\s])\1")
_DIGIT = re.compile(r"\d")


def line_features(line: str, seen_lines: set[str], seen_pairs: set[tuple[str, str]]) -> list[float]:
    """OWN features of a line given what the document said before (both sets are updated)."""
    words = line.split()
    if not words:
        return [0.0] * (OWN - 1) + [1.0]
    chars, n = len(line), len(words)
    upper = sum(map(str.isupper, words))
    pairs = list(zip(words, words[1:]))
    again = sum(p in seen_pairs for p in pairs) / len(pairs) if pairs else 0.0
    repeated = line in seen_lines
    seen_pairs.update(pairs)
    seen_lines.add(line)
    last = words[-1][-1]
    return [
        len(_SYMBOL.findall(line)) / chars,
        upper / n,
        len(_DIGIT.findall(line)) / chars,
        (chars - n + 1) / n / 10,
        math.log1p(n) / 5,
        min(1.0, len(_DOUBLE.findall(line)) / n),
        words.count("|") / n,
        line.count("!") / n,
        len(set(words)) / n,
        float(last in ".?!"),
        float(words[0][0].isupper()),
        float(repeated),
        sum(len(w) <= 3 for w in words) / n,
        again,
        0.0,
    ]


def own_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x OWN, characters of each line); blank lines are left out unless there is nothing else."""
    lines = [x for x in (text or "").split("\n") if x.strip()] or [""]
    seen_lines: set[str] = set()
    seen_pairs: set[tuple[str, str]] = set()
    return np.array([line_features(x, seen_lines, seen_pairs) for x in lines], dtype=np.float32), np.array([max(1, len(x)) for x in lines], dtype=np.int32)


def with_neighbours(own: np.ndarray) -> np.ndarray:
    n = len(own)
    out = np.zeros((n, FEATURES), dtype=np.float64)
    out[:, 0] = 1
    out[:, 1 : 1 + OWN] = own
    out[1:, 1 + OWN : 1 + 2 * OWN] = own[:-1]
    out[:-1, 1 + 2 * OWN : 1 + 3 * OWN] = own[1:]
    out[0, -2] = 1
    out[-1, -1] = 1
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # good minus bad
    stay: np.ndarray  # log potentials of staying bad, staying good; changing has 0
    slope: float
    offset: float
    prior: float

    def marginals(self, own: np.ndarray) -> list[float]:
        """Probability of good of each line."""
        unary = ((with_neighbours(own) - self.mean) / self.scale) @ self.weights
        good = 1 / (1 + np.exp(-np.clip(unary, -30, 30)))
        bad = (1 - good).tolist()
        good = good.tolist()
        s0, s1 = math.exp(self.stay[0]), math.exp(self.stay[1])
        n = len(good)
        forward = [(bad[0], good[0])]
        for t in range(1, n):
            a, b = forward[-1]
            x, y = (a * s0 + b) * bad[t], (a + b * s1) * good[t]
            z = (x + y) or 1.0
            forward.append((x / z, y / z))
        out = [0.0] * n
        x = y = 1.0
        for t in range(n - 1, -1, -1):
            a, b = forward[t]
            z = (a * x + b * y) or 1.0
            out[t] = b * y / z
            p, q = x * bad[t], y * good[t]
            x, y = p * s0 + q, p + q * s1
            z = (x + y) or 1.0
            x, y = x / z, y / z
        return out

    def score(self, text: str | None) -> tuple[float, int, int]:
        """(score, lines, good lines)."""
        own, length = own_features(text)
        if not self.weights.any():
            return self.prior, len(own), len(own) if self.prior >= KEEP else 0
        p = self.marginals(own)
        mean = float(np.dot(p, length) / length.sum())
        return 1 / (1 + math.exp(-(self.slope * (mean - 0.5) + self.offset))), len(own), sum(x >= 0.5 for x in p)


def _objective(x: np.ndarray, lengths: np.ndarray, label: np.ndarray, weight: np.ndarray, theta: np.ndarray) -> tuple[float, np.ndarray]:
    """Negative mean log likelihood of all-equal label sequences, and its gradient. Rows of x are the lines of all
    documents, one after another; documents come in descending length, so step t concerns the first few of them."""
    w, stay = theta[:-2], theta[-2:]
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    u = x @ w
    d = len(lengths)
    active = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(int(lengths.max()) + 1)]  # documents longer than t
    fb, fg, scale = np.zeros(len(u)), np.zeros(len(u)), np.zeros(len(u))
    s0, s1 = np.exp(stay)
    eu = np.exp(np.clip(u, -30, 30))
    rows = starts[:d]
    z = 1 + eu[rows]
    fb[rows], fg[rows], scale[rows] = 1 / z, eu[rows] / z, z
    for t in range(1, len(active)):
        k = active[t]
        if not k:
            break
        rows = starts[:k] + t
        a, b = fb[rows - 1], fg[rows - 1]
        p, q = a * s0 + b, (a + b * s1) * eu[rows]
        z = p + q
        fb[rows], fg[rows], scale[rows] = p / z, q / z, z
    log_z = np.add.reduceat(np.log(scale), starts)
    pairs = lengths - 1
    gold = np.where(label == 1, np.add.reduceat(u, starts) + pairs * stay[1], pairs * stay[0])
    value = float(np.sum(weight * (log_z - gold)))
    bb, bg = np.ones(len(u)), np.ones(len(u))
    expected = np.zeros((d, 2))
    for t in range(len(active) - 2, -1, -1):
        k = active[t + 1]
        if not k:
            continue
        rows = starts[:k] + t
        nb, ng = bb[rows + 1], bg[rows + 1] * eu[rows + 1]
        z = scale[rows + 1]
        expected[:k, 0] += fb[rows] * s0 * nb / z
        expected[:k, 1] += fg[rows] * s1 * ng / z
        bb[rows], bg[rows] = (s0 * nb + ng) / z, (nb + s1 * ng) / z
    good = fg * bg
    per_line = np.repeat(weight, lengths)
    gradient = np.concatenate([x.T @ (per_line * (good - np.repeat(label, lengths))), [np.sum(weight * (expected[:, 0] - pairs * (label == 0))), np.sum(weight * (expected[:, 1] - pairs * (label == 1)))]])
    return value + L2 / 2 * float(theta @ theta), gradient + L2 * theta


def _minimise(f, theta: np.ndarray, iterations: int) -> np.ndarray:
    """Limited-memory BFGS with backtracking."""
    value, g = f(theta)
    s_list: list[np.ndarray] = []
    y_list: list[np.ndarray] = []
    for _ in range(iterations):
        q, alphas = g.copy(), []
        for s, y in zip(reversed(s_list), reversed(y_list)):
            a = (s @ q) / (y @ s)
            q -= a * y
            alphas.append(a)
        if s_list:
            q *= (s_list[-1] @ y_list[-1]) / (y_list[-1] @ y_list[-1])
        else:
            q /= max(1.0, np.linalg.norm(q))
        for (s, y), a in zip(zip(s_list, y_list), reversed(alphas)):
            q += s * (a - (y @ q) / (y @ s))
        step, slope = 1.0, float(g @ q)
        if slope <= 0:
            break
        for _ in range(20):
            new = theta - step * q
            new_value, new_g = f(new)
            if new_value <= value - 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = new - theta, new_g - g
        if s @ y > 1e-12:
            s_list, y_list = [*s_list[-7:], s], [*y_list[-7:], y]
        done = value - new_value < 1e-6 * max(1.0, abs(value))
        theta, value, g = new, new_value, new_g
        if done:
            break
    return theta


def train(sample: list[tuple[int, np.ndarray, np.ndarray]], shares: tuple[float, float]) -> Model:
    """sample: (label, own features, line lengths) of each document; shares: of labels 0 and 1 among all labelled rows.
    Without both labels the score is constant: the share of label 1, or 1 where nothing is labelled."""
    none = Model(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), np.zeros(2), 1.0, 0.0, shares[1] if sum(shares) else 1.0)
    sample = sorted(sample, key=lambda s: -len(s[1]))
    label = np.array([s[0] for s in sample])
    if not len(label) or label.min() == label.max():
        return none
    x = np.concatenate([with_neighbours(s[1]) for s in sample])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    mean[0], scale[0] = 0, 1
    lengths = np.array([len(s[1]) for s in sample])
    each = np.where(label == 1, shares[1] / (label == 1).sum(), shares[0] / (label == 0).sum())
    balanced = np.where(label == 1, 1 / (label == 1).sum(), 1 / (label == 0).sum()) / lengths  # every document counts alike
    xs = (x - mean) / scale
    theta = _minimise(lambda t: _objective(xs, lengths, label, balanced * 20, t), np.zeros(FEATURES + 2), ITERATIONS)
    model = Model(mean, scale, theta[:-2], theta[-2:], 1.0, 0.0, shares[1])
    means = np.array([np.dot(model.marginals(s[1]), s[2]) / s[2].sum() for s in sample]) - 0.5
    ab = np.zeros(2)
    z = np.stack([means, np.ones(len(means))], axis=1)
    for _ in range(50):  # Newton steps of the logistic calibration, with a little shrinkage
        p = 1 / (1 + np.exp(-np.clip(z @ ab, -30, 30)))
        g = z.T @ (each * (p - label)) + 1e-4 * ab
        h = (z * (each * p * (1 - p) + 1e-9)[:, None]).T @ z + 1e-4 * np.eye(2)
        move = np.linalg.solve(h, g)
        ab -= np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    model.slope, model.offset = float(ab[0]), float(ab[1])
    return model


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own, lengths = own_features(text)
            yield common.batch(SAMPLE_SCHEMA, [label], [own.tobytes()], [lengths.tolist()])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", docs_of_label: int = DOCS_OF_LABEL) -> Model:
    """Fit on at most `docs_of_label` labelled documents of each label, the first by a hash of their id, whole.
    Null labels and unlabelled documents are ignored; of repeated ids one row is used."""
    spark = docs.sparkSession
    common.ship(spark)
    labelled = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    count = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(count.values())
    shares = (count.get(0, 0) / total, count.get(1, 0) / total) if total else (0.0, 0.0)
    chosen = None
    for k in (0, 1):
        part = labelled.where(F.col("label") == k).orderBy(F.xxhash64(F.lit(11), "id"), "id").limit(2 * docs_of_label)  # some have no text here
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64(F.lit(11), "id"), "id", "text"))
    rows = texts.withColumn("k", rank).where(F.col("k") <= docs_of_label).select("label", "text").mapInArrow(_sampled, SAMPLE_SCHEMA).collect()
    sample = [(r["label"], np.frombuffer(r["lines"], dtype=np.float32).reshape(-1, OWN), np.array(r["lengths"])) for r in rows]
    return train(sample, shares)


def _score(model: Model, keep: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                score, lines, good = (list(c) for c in zip(*[model.score(t) for t in part.column(2).to_pylist()]))
                yield common.batch(SCORE_SCHEMA, part.column(0), part.column(1), score, [int(s >= keep) for s in score], lines, good)

    return run


def classify(docs: DataFrame, model: Model, held_out=None, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted, n_lines, n_good_lines. Null, empty and blank texts count as
    one empty line; repeated rows stay repeated; all texts are read to their end."""
    common.ship(docs.sparkSession)
    held_out = F.lit(False) if held_out is None else held_out
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_score(model, keep), SCORE_SCHEMA)


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """The documents whose score is at least `keep`, with all their columns."""
    common.ship(docs.sparkSession)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series([model.score(t)[0] for t in text], dtype=float)

    return docs.where(score(text_col) >= keep)


def held_out_fold(id_col: str = "doc_id"):
    return F.pmod(common.crc32_of_id(id_col), F.lit(4)) == 2


def op4_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out_fold())
    return classify(docs, fit(docs, labels), held_out_fold())
