"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Every word n-gram of a test item is a seed: which ones an edited copy keeps is not known from how rare they are. A
document that holds a seed is aligned with that item, word by word, around each cluster of its seeds, unless too few of
the item's words are there for any alignment to reach the bound; a local alignment that scores a large enough share of
the item's own score is a leak, be the copy whole, edited or paraphrased in part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, hashing

NGRAM = 3
LEAST_SEEDS = 12
MATCH, MISMATCH, GAP = 2, -1, -1
LEAK = 0.45
#: Test items are handled in blocks of at most so many characters; each block is what one pass broadcasts.
BLOCK_CHARS = 8_000_000

LEAK_SCHEMA = "doc_id long, item_id long, score double, identity double, start long, end long, n_places long"
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> np.ndarray:
    """Hashes of the lower-case words of a text; anything but letters, digits and underscores separates words."""
    return hashing.words(" ".join(_WORD.findall((text or "").lower())).encode("utf-8", "surrogatepass"))[0]


class Items:
    """Words of each item and the table of their n-grams."""

    def __init__(self, rows: list[tuple[int, str | None]], ngram: int = NGRAM):
        self.ngram = ngram
        self.rows = [(i, w) for i, w in ((i, words_of(t)) for i, t in rows) if len(w)]
        grams = [hashing.runs(w, ngram) for _, w in self.rows]
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, dtype=np.int64)
        gram = np.concatenate(grams) if grams else np.zeros(0, dtype=np.uint64)
        order = np.argsort(gram, kind="stable")
        self.gram, self.owner, self.place = gram[order], owner[order], place[order]
        self.distinct = np.unique(gram)

    def keep_rare(self, frequency: np.ndarray, least: int = LEAST_SEEDS) -> None:
        """Keep each item's rarer half of n-grams, `least` of them at least; ties by place. Only for texts that hold items
        whole: an edited copy may keep just the n-grams that are dropped here, so `find_leaks` seeds with all of them."""
        f = frequency[np.searchsorted(self.distinct, self.gram)]
        order = np.lexsort((self.place, f, self.owner))
        size = np.bincount(self.owner, minlength=len(self.rows))
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        rank = np.arange(len(order)) - first[self.owner[order]]
        chosen = np.sort(order[rank < np.maximum(least, (size + 1) // 2)[self.owner[order]]])
        self.gram, self.owner, self.place = self.gram[chosen], self.owner[chosen], self.place[chosen]

    def seeds(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, position in the document that the item's first word would have) of each seed that a document holds."""
        grams = hashing.runs(words, self.ngram)
        if not len(self.gram) or not len(grams):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        a, b = np.searchsorted(self.gram, grams, "left"), np.searchsorted(self.gram, grams, "right")
        hit = np.flatnonzero(b > a)
        at = np.repeat(hit, (b - a)[hit])
        k = np.concatenate([np.arange(a[i], b[i]) for i in hit]) if len(hit) else hit
        return self.owner[k], at - self.place[k]


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """(score, start, end) of the best local alignment of an item with a window, by words; the end is exclusive."""

    def best(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
        ramp = np.arange(len(b) + 1) * -GAP
        row, top, end = np.zeros(len(b) + 1, dtype=np.int64), 0, 0
        for w in a:
            new = np.maximum(np.maximum(row[:-1] + np.where(b == w, MATCH, MISMATCH), row[1:] + GAP), 0)
            row = np.maximum.accumulate(np.concatenate([[0], new]) + ramp) - ramp
            k = int(row.argmax())
            if row[k] > top:
                top, end = int(row[k]), k
        return top, end

    score, end = best(item, window)
    if not score:
        return 0, 0, 0
    _, back = best(item[::-1], window[:end][::-1])
    return score, end - back, end


def leaks_of(words: np.ndarray, items: Items, leak: float = LEAK) -> list[tuple[int, float, float, int, int, int]]:
    """(item id, score, identity, start, end, places) of each item that a document leaks: its best alignment, and in how many
    places apart the document holds it."""
    owner, origin = items.seeds(words)
    found = []
    for k in np.unique(owner):
        item_id, item = items.rows[k]
        at = np.sort(origin[owner == k])
        best, places = None, 0
        for group in np.split(at, np.flatnonzero(np.diff(at) > len(item)) + 1):
            lo, hi = max(0, int(group[0]) - len(item) // 2 - 2), min(len(words), int(group[-1]) + len(item) + len(item) // 2 + 2)
            if np.isin(item, words[lo:hi]).mean() < leak:  # a score is at most MATCH for each word of the item that is there
                continue
            score, start, end = align(item, words[lo:hi])
            share = score / (MATCH * len(item))
            places += share >= leak
            if best is None or share > best[1]:
                best = (item_id, share, float(np.isin(item, words[lo + start : lo + end]).mean()) if score else 0.0, lo + start, lo + end)
        if best and best[1] >= leak:
            found.append((*best, places))
    return found


def _find(rows: list[tuple[int, str | None]], leak: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(rows)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out += [(doc, *x) for x in leaks_of(words_of(text), items, leak)]
            if out:
                yield common.batch(LEAK_SCHEMA, *(list(c) for c in zip(*out)))

    return run


def _item_blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, str | None]]]:
    """The items in blocks of bounded size: ranges of a running length over (id, length) alone."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t")).where(F.col("t").isNotNull())
    total = rows.agg(F.sum(F.length("t")).alias("c")).first()["c"] or 0
    n = -(-total // BLOCK_CHARS)
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield sorted({(r["i"], r["t"]) for r in part.collect()}, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", leak: float = LEAK) -> DataFrame:
    """One row for each document and item that it leaks: doc_id, item_id, score (share of the item's own score, 0 to 1),
    identity (share of the item's words found in the aligned part), start, end (words of the document, end exclusive) of the
    best alignment, n_places (how many places, more than an item's length apart, hold it).

    Null, empty and wordless texts and items leak nothing; items with fewer words than a seed are one seed as a whole, and
    only a text of just these words holds it. Repeated documents give repeated rows; repeated items count once. Two equal
    alignments: the first. An empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    common.ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for block in _item_blocks(benchmark, item_col, item_text_col):
        part = rows.mapInArrow(_find(block, leak), LEAK_SCHEMA)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], LEAK_SCHEMA) if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", leak: float = LEAK) -> DataFrame:
    """The documents that leak no test item, with all their columns."""
    common.ship(docs.sparkSession)
    for block in _item_blocks(benchmark, item_col, item_text_col):
        docs = docs.where(~_leaky(block, leak)(F.col(text_col)))
    return docs


def _leaky(block: list[tuple[int, str | None]], leak: float):
    @F.pandas_udf("boolean")
    def leaky(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        items = Items(block)
        for texts in batches:
            yield pd.Series([bool(leaks_of(words_of(t), items, leak)) for t in texts], dtype=bool)

    return leaky


def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
