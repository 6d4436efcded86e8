"""Pattern packing by non-negative least squares.

Documents become token ids and are cut into pieces of at most `capacity` ids. The histogram of piece lengths, at most
`capacity` numbers whatever the corpus, goes to the driver: patterns of a few lengths that nearly fill a sequence are
enumerated, non-negative least squares fits how often each is used, and the counts are rounded within what is there: whole
parts first, then patterns with a part left, the fullest and then the largest part first. What remains is fitted again, a
few rounds, and best fit over the last histogram places the residual. The plan maps (length, rank among the pieces of that length) to
(sequence, offset) by runs; ranks come from counts of each scan partition, so no task sees all pieces of a length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .tokens import encoder

CAPACITY = 4096
MOST_IN_PATTERN = 8
SECOND_CHOICES = 12
ITERATIONS = 300
ROUNDS = 6
CACHED_RUNS = 150_000  # bounds a worker's memory, not what is encoded
#: Texts that are tokenised at once; a longer one is whole and alone.
CHUNK_BYTES = 1 << 22
LEAST_PART = 1e-3  # parts of a count below this are taken for zero

CHUNKS_SCHEMA = (
    "part int, lengths array<int>, counts array<long>, doc_id array<long>, piece array<int>, start array<long>, length array<int>, ids_crc32 array<long>, local array<long>"
)
PACKED_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
_RANKS = 1 << 44


def enumerate_patterns(lengths: np.ndarray, capacity: int, most: int = MOST_IN_PATTERN, seconds: int = SECOND_CHOICES) -> list[tuple[int, ...]]:
    """Descending length tuples that sum to at most `capacity`: for each first length, spread second lengths, then the
    longest that still fits, up to `most` pieces."""
    ascending = np.unique(lengths).tolist()
    found: dict[tuple[int, ...], None] = {}
    for i, first in enumerate(ascending):
        room = capacity - first
        fit = min(i, bisect_left(ascending, room + 1) - 1)
        if fit < 0:
            found[(first,)] = None
            continue
        for j in dict.fromkeys(np.linspace(fit, 0, seconds).astype(int).tolist()):
            pattern, left, top = [first, ascending[j]], room - ascending[j], j
            while len(pattern) < most:
                top = min(top, bisect_left(ascending, left + 1) - 1)
                if top < 0:
                    break
                pattern.append(ascending[top])
                left -= ascending[top]
            found[tuple(pattern)] = None
    return list(found)


def fit_counts(patterns: list[tuple[int, ...]], histogram: np.ndarray, capacity: int, iterations: int = ITERATIONS) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - histogram|^2 plus a small price on unused room (accelerated projected
    gradient; A has a row for each length)."""
    if not patterns:
        return np.zeros(0)
    column = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    row = np.array([x for p in patterns for x in p])
    target = histogram.astype(np.float64)
    scale = max(1.0, target.max())
    target /= scale
    size = len(target)
    waste = 1.0 - np.bincount(column, weights=row, minlength=len(patterns)) / capacity
    multiply = lambda x: np.bincount(row, weights=x[column], minlength=size)
    transpose = lambda y: np.bincount(column, weights=y[row], minlength=len(patterns))
    v = np.ones(len(patterns))
    for _ in range(12):  # the largest squared singular value
        v = transpose(multiply(v))
        norm = np.linalg.norm(v)
        v /= norm
    step = 1 / (1.05 * norm)
    x = z = np.zeros(len(patterns))
    t = 1.0
    price = 1e-3 * waste
    for _ in range(iterations):
        new = np.maximum(0, z - step * (transpose(multiply(z) - target) + price))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x * scale


class Plan:
    """Runs of placements: `key` = length * 2**44 + first rank; from there on, rank r goes to sequence + r - first."""

    def __init__(self, histogram: np.ndarray, capacity: int):
        least = -(-int(np.arange(len(histogram)) @ histogram) // capacity)
        best = None
        for room in dict.fromkeys((min(capacity // 64, 64), min(capacity // 512, 8), 0)):  # what a pattern may leave empty
            self._pack(histogram, capacity, room)
            if best is None or self.sequences < best["sequences"]:
                best = dict(vars(self))
            if self.sequences <= least:
                break
        vars(self).update(best)
        runs = np.array(self.runs, dtype=np.int64).reshape(-1, 4)
        key = runs[:, 0] * _RANKS + runs[:, 1]
        order = np.argsort(key, kind="stable")
        self.key, self.first, self.sequence, self.offset = key[order], runs[order, 1], runs[order, 2], runs[order, 3]

    def _pack(self, histogram: np.ndarray, capacity: int, room: int) -> None:
        left = histogram.astype(np.int64).copy()
        self.runs: list[tuple[int, int, int, int]] = []  # length, first rank, sequence, offset
        self.used = np.zeros(len(left), dtype=np.int64)
        self.sequences = 0
        self._place(capacity, int(left[capacity]), self.sequences, 0)
        self.sequences += int(left[capacity])
        left[capacity] = 0
        self.fitted_tokens = 0  # what patterns place
        for _ in range(ROUNDS):
            placed = self._fit(left, capacity, room)
            self.fitted_tokens += placed
            if placed < capacity or placed * 20 < int(np.arange(len(left)) @ left):
                break
        self._best_fit(left, capacity)

    def _fit(self, left: np.ndarray, capacity: int, room: int) -> int:
        """Fit pattern counts to what is left, round and place them; the tokens placed."""
        patterns = enumerate_patterns(np.flatnonzero(left), capacity)
        fitted = fit_counts(patterns, left, capacity)
        waste = capacity - np.array([sum(p) for p in patterns], dtype=np.int64)
        near = waste <= room
        whole = np.floor(fitted)
        placed = 0
        steps = [(k, int(whole[k])) for k in np.argsort(-whole, kind="stable") if near[k] and whole[k] >= 1]
        steps += [(k, 1) for k in np.lexsort((whole - fitted, waste)) if near[k] and fitted[k] - whole[k] > LEAST_PART]
        for k, times in steps:
            need = Counter(patterns[k])
            times = min(times, *(int(left[length]) // n for length, n in need.items()))
            if times < 1:
                continue
            at = 0
            for length in patterns[k]:
                self._place(length, times, self.sequences, at)
                left[length] -= times
                at += length
            self.sequences += times
            placed += at * times
        return placed

    def _place(self, length: int, times: int, sequence: int, offset: int) -> None:
        if times:
            self.runs.append((length, int(self.used[length]), sequence, offset))
            self.used[length] += times

    def _best_fit(self, left: np.ndarray, capacity: int) -> None:
        """Best fit decreasing over counts: runs of sequences with equal room are filled together."""
        rooms: list[int] = []
        open_runs: dict[int, list[tuple[int, int]]] = defaultdict(list)

        def keep(room: int, sequence: int, times: int) -> None:
            if room and times:
                if not open_runs[room]:
                    insort(rooms, room)
                open_runs[room].append((sequence, times))

        for length in np.flatnonzero(left)[::-1].tolist():
            count = int(left[length])
            while count:
                i = bisect_left(rooms, length)
                if i < len(rooms):
                    room = rooms[i]
                    sequence, times = open_runs[room].pop()
                    if not open_runs[room]:
                        rooms.pop(i)
                    take = min(count, times)
                    self._place(length, take, sequence, capacity - room)
                    keep(room - length, sequence, take)
                    keep(room, sequence + take, times - take)
                else:
                    each = capacity // length
                    take, every = (count // each, each) if count >= each else (1, count)
                    for k in range(every):
                        self._place(length, take, self.sequences, k * length)
                    keep(capacity - every * length, self.sequences, take)
                    self.sequences += take
                    count -= take * (every - 1)
                count -= take

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, length * _RANKS + rank, side="right") - 1
        return self.sequence[at] + rank - self.first[at], self.offset[at]


def _cut(path: str, special: bool, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, special, CACHED_RUNS)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            docs, texts = batch.column(0), batch.column(1)
            for lo, n in common.chunks(texts, CHUNK_BYTES):
                rows = []
                for doc, raw in zip(docs.slice(lo, n).to_pylist(), enc.raws(texts.slice(lo, n), end)):
                    ids = np.frombuffer(raw, dtype=enc.dtype).astype("<u4")
                    for k, at in enumerate(range(0, len(ids), capacity)):
                        piece = ids[at : at + capacity]
                        rows.append((doc, k, at, len(piece), zlib.crc32(piece), int(seen[len(piece)])))
                        seen[len(piece)] += 1
                yield common.batch(CHUNKS_SCHEMA, [part], [[]], [[]], *([list(c)] for c in zip(*rows)))
        used = np.flatnonzero(seen)
        if len(used):
            yield common.batch(CHUNKS_SCHEMA, [part], [used.tolist()], [seen[used].tolist()], *[[[]]] * 6)

    return run


def _assign(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                base = np.zeros(max(row["lengths"]) + 1, dtype=np.int64)
                base[row["lengths"]] = row["bases"]
                length = np.array(row["length"], dtype=np.int64)
                sequence, offset = plan.find(length, base[length] + np.array(row["local"], dtype=np.int64))
                yield common.batch(PACKED_SCHEMA, row["doc_id"], row["piece"], row["start"], length, row["ids_crc32"], sequence, offset)

    return run


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", special: bool = True) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece of the end id alone. Repeated rows are packed as often as they occur. An empty
    table gives no rows. `special`: the strings of special tokens in a text become those tokens, as the library does by
    default. Pieces of equal length are interchangeable; which goes where follows the scan's order.
    """
    common.ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    chunks, _ = common.save(rows.mapInArrow(common.tidied(_cut(tokenizer_path, special, end_id, capacity)), CHUNKS_SCHEMA), "pieces")
    counted = chunks.where(F.size("lengths") > 0).select("part", F.explode(F.arrays_zip("lengths", "counts")).alias("c")).select("part", F.col("c.lengths").alias("length"), F.col("c.counts").alias("n"))
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        histogram[r["length"]] = r["n"]
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        counted.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .groupBy("part")
        .agg(F.collect_list(F.struct("length", "base")).alias("b"))
        .select("part", F.col("b.length").alias("lengths"), F.col("b.base").alias("bases"))
    )
    pieces = chunks.where(F.size("doc_id") > 0).drop("lengths", "counts")
    return pieces.join(bases, "part").mapInArrow(_assign(Plan(histogram, capacity)), PACKED_SCHEMA)


def op5_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
