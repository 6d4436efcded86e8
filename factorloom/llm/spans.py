"""Substring deduplication by sliding sentence spans.

Every run of consecutive sentences that is just long enough (RUN_SENTENCES sentences and RUN_WORDS words; LONE_WORDS words
also make a run of one sentence) is hashed, growing forward from each sentence and backward from each sentence, so that a
repeated passage is covered up to its last sentence. Runs are joined over the whole corpus; a sentence that lies in a run
which occurred before, in an earlier document or earlier in its own, is removed. Repeats inside one text are found where
the text is read; between texts, a run's origin is the least document that holds it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, hashing

RUN_SENTENCES = 2
RUN_WORDS = 16
LONE_WORDS = 40

RUNS_SCHEMA = "doc_id long, text_hash long, own array<int>, first array<int>, last array<int>, hash array<long>"
CLEAN_SCHEMA = "doc_id long, n_sentences long, n_removed long, removed_starts array<long>, removed_ends array<long>, text string"
_BREAK = re.compile(r"[.!?]++[\"')\]]*+\s*+|\n\s*+")


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of each sentence with the white space after it; together they are the whole text. Marks that no white
    space follows end nothing, but are passed over as a whole, so that long runs of them cost one pass."""
    if not text:
        return []
    cuts = [0, *(k for m in _BREAK.finditer(text) if (k := m.end()) < len(text) and text[k - 1].isspace()), len(text)]
    return list(zip(cuts, cuts[1:]))


def sentence_runs(text: str | None) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(sentences, first and last sentence and hash of each run). Case and white space do not matter; a run's hash is that
    of its words, so it does not depend on where the sentences were cut. The text is hashed in one pass; a sentence's words
    are those that begin before its end."""
    spans = sentence_spans(text)
    none = np.zeros(0, dtype=np.int64)
    if not spans:
        return 0, none, none, none
    n = len(spans)
    if text.isascii():
        h, start, _ = hashing.words(text.encode().lower())
        ends = np.fromiter((b for _, b in spans), dtype=np.int64, count=n)
    else:
        pieces = [text[a:b].lower().encode("utf-8", "surrogatepass") for a, b in spans]
        h, start, _ = hashing.words(b"\n".join(pieces))  # white space that is not ASCII ends a word here only
        ends = np.cumsum(np.fromiter(map(len, pieces), dtype=np.int64, count=n) + 1)
    upto = np.zeros(n + 1, dtype=np.int64)
    upto[1:] = np.searchsorted(start, ends)
    words = upto[1:] - upto[:-1]
    power, inverse = hashing._power(len(h) + 1)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(h * power[: len(h)], dtype=np.uint64)])
    i = np.arange(n)
    grown = np.searchsorted(upto, upto[:-1] + RUN_WORDS, side="left") - 1  # last sentence once there are enough words
    forward = np.where(words >= LONE_WORDS, i, np.maximum(grown, i + RUN_SENTENCES - 1))
    shrunk = np.searchsorted(upto, upto[1:] - RUN_WORDS, side="right") - 1
    backward = np.where(words >= LONE_WORDS, i, np.minimum(shrunk, i - RUN_SENTENCES + 1))
    f, b = forward < n, backward >= 0
    packed = np.unique(np.concatenate([i[f] * n + forward[f], backward[b] * n + i[b]]))
    first, last = packed // n, packed % n
    a, z = upto[first], upto[last + 1]
    value = hashing.mix((sums[z] - sums[a]) * inverse[a] + (z - a).astype(np.uint64))
    return n, first, last, value.view(np.int64)


def _own_runs(text: str | None) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """(sentences in a run that occurred earlier in the text, then first, last and hash of each run's first occurrence)."""
    _, first, last, value = sentence_runs(text)
    at = np.unique(value, return_index=True)[1]
    if len(at) == len(value):
        return [], first, last, value
    again = np.ones(len(value), dtype=bool)
    again[at] = False
    edge = np.zeros(int(last.max()) + 2, dtype=np.int64)
    np.add.at(edge, first[again], 1)
    np.add.at(edge, last[again] + 1, -1)
    at.sort()
    return np.flatnonzero(np.cumsum(edge) > 0).tolist(), first[at], last[at], value[at]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 1000):
            part = batch.slice(lo, 1000)
            yield common.batch(RUNS_SCHEMA, part.column(0), part.column(1), *zip(*map(_own_runs, part.column(2).to_pylist())))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 1000):
            part = batch.slice(lo, 1000)
            out = []
            for doc, text, covered in zip(*(c.to_pylist() for c in part.columns)):
                spans = sentence_spans(text)
                gone = set(covered or ())
                starts = [a for k, (a, _) in enumerate(spans) if k in gone]
                ends = [b for k, (_, b) in enumerate(spans) if k in gone]
                clean = text if not gone else "".join(text[a:b] for k, (a, b) in enumerate(spans) if k not in gone).rstrip()
                out.append((doc, len(spans), len(gone), starts, ends, clean))
            yield common.batch(CLEAN_SCHEMA, *(list(c) for c in zip(*out)))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_sentences, n_removed, removed_starts, removed_ends (code points), text (what is left).

    The first occurrence of a run, by document id (null ids last), then a hash of the text, then its place, stays. Null
    and empty texts have no sentences and come back as they are; a text of white space is one sentence without a run. Rows
    with the same id and text are one document: each is returned with the same result. Runs that end up removed still
    count as earlier occurrences of later ones.
    """
    common.ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    runs, _ = common.save(rows.mapInArrow(_runs, RUNS_SCHEMA), "runs")
    each = runs.select("doc_id", "text_hash", F.explode(F.arrays_zip("first", "last", "hash")).alias("r")).select(
        "doc_id", "text_hash", F.col("r.first").alias("first"), F.col("r.last").alias("last"), F.col("r.hash").alias("hash")
    )
    document = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")
    # one row a hash leaves each task, however often the hash occurs there; the table cuts the join off from this grouping,
    # so that a hash which many documents hold can be split over tasks
    repeated, _ = common.save(each.groupBy("hash").agg(F.min(document).alias("origin"), F.max(document).alias("end")).where("origin <> end").select("hash", "origin"), "repeated")
    later = each.join(repeated, "hash").where(document != F.col("origin")).select("doc_id", "text_hash", F.sequence("first", "last").alias("covered"))
    covered = (
        later.unionByName(runs.where(F.size("own") > 0).select("doc_id", "text_hash", F.col("own").alias("covered")))
        .groupBy("doc_id", "text_hash")
        .agg(F.array_distinct(F.flatten(F.collect_set("covered"))).alias("covered"))
    )
    left = rows.join(covered.withColumnsRenamed({"doc_id": "d", "text_hash": "h"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    return left.select("doc_id", "text", "covered").mapInArrow(_remove, CLEAN_SCHEMA)


def op6_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.table(spark, sf_dir, "documents"))
