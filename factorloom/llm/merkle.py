"""Merkle fingerprints: words in groups, paragraphs, sections, root.

A paragraph is a line with its line end, a section SECTION paragraphs, a leaf LEAF words of a paragraph with the white
space after them; the leaves together are the whole text, so roots are equal exactly where texts are. A fingerprint is
the root, and for each section a mark, its short digest, and the short digests of its leaves by paragraph. Equality needs
the root alone; otherwise two trees are compared from the sections down, and paragraphs and leaves only where branches
differ, which locates edits. A fingerprint grows with its text, by about a fifth of it.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAF = 5
SECTION = 8
SHORT, MARK = 3, 4  # bytes of a leaf and of a section in a fingerprint

FINGERPRINT_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_edited_paragraphs int, edited_section int, edited_paragraph int"
_LEAF = re.compile(r"\s*(?:\S+\s*){1,%d}" % LEAF)


def _digest(x: bytes) -> bytes:
    return hashlib.blake2b(x, digest_size=16).digest()


def leaves(paragraph: str) -> list[str]:
    return _LEAF.findall(paragraph) or ([paragraph] if paragraph else [])


class Tree:
    """Hashes of a text: `root`, `sections`, `paragraphs` and `leaf` digests, each level a list of lists below it."""

    def __init__(self, text: str | None):
        text = text or ""
        self.paragraphs = [[_digest(x.encode("utf-8", "surrogatepass")) for x in leaves(p)] for p in text.splitlines(keepends=True)] if text else []
        nodes = [_digest(b"p" + b"".join(p)) for p in self.paragraphs]
        self.sections = [nodes[i : i + SECTION] for i in range(0, len(nodes), SECTION)]
        self.tops = [_digest(b"s" + b"".join(s)) for s in self.sections]
        self.root = _digest(b"r" + b"".join(self.tops))

    def fingerprint(self) -> str:
        """root:section|section|..., a section as mark:paragraph/paragraph/..., a paragraph as its leaves; all in hex."""
        short = ["".join([x[:SHORT].hex() for x in p]) for p in self.paragraphs]
        parts = [f"{top[:MARK].hex()}:{'/'.join(short[i * SECTION : (i + 1) * SECTION])}" for i, top in enumerate(self.tops)]
        return f"{self.root.hex()}:{'|'.join(parts)}"


def in_order(x: Sequence[str], y: Sequence[str]) -> list[tuple[int, int]]:
    """Pairs of equal places of two sequences that ascend in both: what they begin and end with, and between these the
    longest ascending choice among k-th occurrences of equal values."""
    n, lo = min(len(x), len(y)), 0
    while lo < n and x[lo] == y[lo]:
        lo += 1
    end = 0
    while end < n - lo and x[-1 - end] == y[-1 - end]:
        end += 1
    pairs = [(i, i) for i in range(lo)]
    place: dict[tuple[str, int], int] = {}
    seen: dict[str, int] = {}
    for j in range(lo, len(y) - end):
        k = seen[y[j]] = seen.get(y[j], 0) + 1
        place[y[j], k] = j
    seen = {}
    tails, last, before, found = [], [], [], []  # smallest ends of ascending choices, who they are, links
    for i in range(lo, len(x) - end):
        k = seen[x[i]] = seen.get(x[i], 0) + 1
        j = place.get((x[i], k))
        if j is None:
            continue
        at = bisect_left(tails, j)
        before.append(last[at - 1] if at else -1)
        found.append((i, j))
        tails[at : at + 1], last[at : at + 1] = [j], [len(found) - 1]
    middle = []
    k = last[-1] if last else -1
    while k >= 0:
        middle.append(found[k])
        k = before[k]
    return pairs + middle[::-1] + [(len(x) - e, len(y) - e) for e in range(end, 0, -1)]


def _between(x: Sequence, y: Sequence, pairs: list[tuple[int, int]]) -> Iterator[tuple[Sequence, Sequence]]:
    """What lies between pairs, where it does on both sides."""
    i = j = 0
    for a, b in [*pairs, (len(x), len(y))]:
        if a > i and b > j:
            yield x[i:a], y[j:b]
        i, j = a + 1, b + 1


def likeness(a: str, b: str) -> float:
    """Share of leaves in equal branches of two fingerprints: sections in common order, then paragraphs of sections that
    differ, then leaves of paragraphs that differ; twice their number over all leaves of both. 1 for equal roots, so for two
    empty texts too."""
    if a[:32] == b[:32]:
        return 1.0
    width = 2 * SHORT
    x, y = ([part for part in s[33:].split("|") if part] for s in (a, b))
    mark = 2 * MARK + 1
    leaves_of = lambda parts: sum(len(p) - p.count("/") for p in parts) // width
    bodies = [[p[mark:] for p in s] for s in (x, y)]
    total = leaves_of(bodies[0]) + leaves_of(bodies[1])
    top = in_order(x, y)
    same = leaves_of([bodies[0][i] for i, _ in top])
    for xs, ys in _between(*bodies, top):
        paragraphs = ["/".join(xs).split("/"), "/".join(ys).split("/")]
        inner = in_order(*paragraphs)
        same += leaves_of([paragraphs[0][i] for i, _ in inner])
        for xp, yp in _between(*paragraphs, inner):
            one, other = ([p[i : i + width] for p in ps for i in range(0, len(p), width)] for ps in (xp, yp))
            same += len(in_order(one, other))
    return 2 * same / total if total else 0.0


def differing(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """(section, paragraph in it) of each paragraph of `a` that differs from that of `b` in its place, found from the
    sections down; what `b` has beyond the end of `a` is not listed."""
    if a.root == b.root:
        return []
    found = []
    for i, (section, top) in enumerate(zip(a.sections, a.tops)):
        if i < len(b.tops) and b.tops[i] == top:
            continue
        other = b.sections[i] if i < len(b.sections) else []
        found += [(i, k) for k, p in enumerate(section) if k >= len(other) or other[k] != p]
    return found


def edited(text: str, following: str) -> str:
    """The last floor(n/3) code points replaced by as many of the next text, or all it has."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _tops(ranges: common.Ranges):
    """The greatest (id, tie) of each range in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most: dict[int, tuple[int, int]] = {}
        for batch in batches:
            keys, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            shard = ranges.of(keys, ties)
            order = np.lexsort((ties, keys, shard))
            for i in order[np.flatnonzero(np.diff(shard[order], append=-1))]:
                at = int(shard[i])
                most[at] = max(most.get(at, (common.LOWEST, common.LOWEST)), (int(keys[i]), int(ties[i])))
        yield common.batch("shard int, k long, t long", list(most), [k for k, _ in most.values()], [t for _, t in most.values()])

    return run


def _deal(ranges: common.Ranges, after: dict[tuple[int, int], list[int]]):
    """Rows with their range; a range also gets the row that follows its last one, marked as border, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "border", "doc_id", "tie", "text"]
        sent: set[int] = set()
        first = np.array(sorted(k for k, _ in after), dtype=np.int64)
        for batch in batches:
            keys, ties = batch.column(0).fill_null(common.LOWEST).to_numpy(), batch.column(1).to_numpy()
            own = ranges.of(keys, ties)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(np.zeros(len(own), dtype=bool)), *batch.columns], names)
            for i in np.flatnonzero(np.isin(keys, first)):
                for shard in after.get((int(keys[i]), int(ties[i])), ()):
                    if shard not in sent:
                        sent.add(shard)
                        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([True]), *(c.slice(i, 1) for c in batch.columns)], names)

    return run


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by shard, own rows before border rows, in descending order: each one's next is the row after it."""
    held = None
    out: list[tuple] = []

    def result(row: tuple, after: tuple) -> tuple:
        _, doc, text, tree, print_ = row
        changed = edited(text, after[2])
        other = Tree(changed)
        other_print = other.fingerprint()
        where = differing(tree, other)
        sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
        return doc, len(text), sha, print_, other_print, likeness(print_, other_print), likeness(print_, after[4]), len(where), *(where[0] if where else (None, None))

    def flush() -> pa.RecordBatch:
        return common.batch(FINGERPRINT_SCHEMA, *(list(c) for c in zip(*out)))

    skip = None  # after the first border row, the rest of the shard's border rows are copies of its id
    for batch in batches:
        for shard, border, doc, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if border and skip == shard:
                continue
            tree = Tree(text)
            row = (shard, doc, text or "", tree, tree.fingerprint())
            if held is not None:
                out.append(result(held, row))
            held = None if border else row
            skip = shard if border else None
            if len(out) >= 500:
                yield flush()
                out = []
    if out:
        yield flush()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """One row a document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    n_edited_paragraphs, edited_section, edited_paragraph (how many of its paragraphs differ from the edited text's in their
    place and the first of them, counted from 0; null if none).

    The next document is that of the next smaller id (null ids are the smallest; equal ids by a hash of the text); after
    the last comes the first. A null text is empty; a lone document is its own next. Texts are dealt once, by ranges of
    ids, with one document more for each range and task; the ranges come from a sketch of the ids, and an id that many rows
    share is cut by the hash of the text, rows of one id and text by turns.
    """
    common.ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))
    ranges = common.ranges(rows, "doc_id", "tie", shards or common.parts(docs.sparkSession))
    ids = rows.select(F.coalesce("doc_id", F.lit(common.LOWEST)).alias("k"), F.col("tie").alias("t"))
    tops = ids.mapInArrow(_tops(ranges), "shard int, k long, t long").groupBy("shard").agg(F.max(F.struct("k", "t")).alias("m")).collect()  # a row for each range
    top = {r["shard"]: (r["m"]["k"], r["m"]["t"]) for r in tops}
    order = sorted(top, reverse=True)
    after: dict[tuple[int, int], list[int]] = {}
    for k, s in enumerate(order):
        after.setdefault(top[order[(k + 1) % len(order)]], []).append(s)
    dealt = rows.mapInArrow(_deal(ranges, after), "shard int, border boolean, doc_id long, tie long, text string")
    return (
        dealt.repartitionById(ranges.count, F.col("shard"))
        .sortWithinPartitions("shard", "border", F.col("doc_id").desc_nulls_last(), F.col("tie").desc())
        .select("shard", "border", "doc_id", "text")
        .mapInArrow(_fingerprints, FINGERPRINT_SCHEMA)
    )


def op3_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(common.table(spark, sf_dir, "documents"))
