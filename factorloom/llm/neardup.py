"""MinHash near-duplicates with odd sketches.

1. Each document's distinct word shingles give a MinHash signature; its bands are bucket keys, and its samples folded by
   parity into a bitmap are its odd sketch. Documents with equal shingle sets are one class from here on.
2. Buckets join classes by stars (each member to the bucket's first), never by pairs; the stars' components are clusters,
   and every pair that shares a bucket is inside one cluster.
3. A cluster's classes are compared in blocks of bounded size; a large cluster is dealt out as pairs of blocks, so that no
   task holds more than two. The population count of two odd sketches' XOR estimates how many samples differ and rules
   out pairs; the pairs left are confirmed by exact intersection sizes of the full shingle sets. A block pair returns a
   spanning forest of its confirmed links, not the links.
4. Components of the forests are the result.

A pair at the threshold shares no bucket with a probability below MISS; a sketch rules out such a pair with about the same.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, hashing
from .components import connected_components

ROWS = 6
MISS = 1e-9
SKETCH_SAMPLES = 128
SKETCH_BITS = 512
BLOCK_CLASSES = 256
BLOCK_SHINGLES = 1_000_000

SIGNED_SCHEMA = "doc_id long, text_hash long, n_shingles long, set_key binary, bands array<long>, sketch binary"
LINK_SCHEMA = "a long, b long"


def band_count(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


@lru_cache(8)
def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(977))
    return rng.integers(0, 1 << 63, n, dtype=np.uint64)[:, None], (rng.integers(0, 1 << 62, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]


def signature(shingles: np.ndarray, n: int) -> np.ndarray:
    """n MinHash samples of a non-empty set."""
    flip, times = _family(n)
    out = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), 4096):
        part = shingles[None, i : i + 4096]
        for k in range(0, n, 32):
            np.minimum(out[k : k + 32], ((part ^ flip[k : k + 32]) * times[k : k + 32]).min(axis=1), out=out[k : k + 32])
    return out


def band_keys(samples: np.ndarray, rows: int = ROWS) -> np.ndarray:
    grid = samples[: len(samples) // rows * rows].reshape(-1, rows)
    key = np.arange(len(grid), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(rows):
        key = hashing.mix(key ^ grid[:, k])
    return key.view(np.int64)


def odd_sketch(samples: np.ndarray, bits: int = SKETCH_BITS) -> bytes:
    """Parity bitmap: sample i with value v flips bit hash(i, v)."""
    x = samples[:SKETCH_SAMPLES]
    at = hashing.mix(x + np.arange(len(x), dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) % np.uint64(bits)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def estimated_similarity(apart: np.ndarray, samples: int = SKETCH_SAMPLES, bits: int = SKETCH_BITS) -> np.ndarray:
    """Jaccard similarity from the population count of two sketches' XOR: with d differing samples, 2d flips leave
    bits/2 * (1 - (1 - 2/bits)^(2d)) odd."""
    odd = np.minimum(np.asarray(apart, dtype=np.float64), bits / 2 - 1)
    return 1 - np.log1p(-2 * odd / bits) / np.log1p(-2 / bits) / (2 * samples)


def most_apart(threshold: float, samples: int = SKETCH_SAMPLES, bits: int = SKETCH_BITS) -> int:
    """The population count that a pair at the threshold exceeds with a probability of about 1e-9: six standard
    deviations of the samples that differ, then of the bits."""
    differ = samples * (1 - threshold) + 6 * math.sqrt(samples * threshold * (1 - threshold))
    mean = bits / 2 * (1 - (1 - 2 / bits) ** (2 * differ))
    return math.ceil(mean + 3 * math.sqrt(mean))


def _sign(width: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = max(bands * ROWS, SKETCH_SAMPLES)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                size, key, band, sketch = [], [], [], []
                for text in part.column(2).to_pylist():
                    s = hashing.shingles(text, width)
                    size.append(len(s))
                    if len(s):
                        x = signature(s, n)
                        key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                        band.append(band_keys(x[: bands * ROWS]))
                        sketch.append(odd_sketch(x))
                    else:
                        key.append(None)
                        band.append([])
                        sketch.append(None)
                yield common.batch(SIGNED_SCHEMA, part.column(0), part.column(1), size, key, band, sketch)

    return run


class _Sets:
    """Union-find."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j


def exact_intersections(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[rows] with sets[columns]: products of 0/1 matrices over the elements that more
    than one set has."""
    used = np.unique(np.concatenate([rows, columns]))
    values, at = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True)
    owner = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    shared = np.bincount(at, minlength=len(values)) > 1
    keep = shared[at]
    column = (np.cumsum(shared) - 1)[at[keep]]
    owner = owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    r, c = np.searchsorted(used, rows), np.searchsorted(used, columns)
    out = np.zeros((len(rows), len(columns)), dtype=np.int64)
    for first in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(column, [first, first + 4096])
        m = np.zeros((len(used), 4096), dtype=np.float32)
        m[owner[a:b], column[a:b] - first] = 1
        out += (m[r] @ m[c].T).astype(np.int64)  # at most 4096, so exact
    return out


def forest(sets: list[np.ndarray], sketches: np.ndarray, side: np.ndarray, same: bool, numerator: int, denominator: int) -> list[tuple[int, int]]:
    """Spanning forest of the links between the two sides of a block pair (of all links where `same`)."""
    n = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    limit = most_apart(numerator / denominator)
    left = np.arange(n) if same else np.flatnonzero(side == 0)
    right = np.arange(n) if same else np.flatnonzero(side == 1)
    if not len(left) or not len(right):
        return []
    near = np.zeros((len(left), len(right)), dtype=bool)
    for k, i in enumerate(left):  # odd sketches, then what sizes alone allow
        near[k] = np.bitwise_count(sketches[right] ^ sketches[i]).sum(axis=1) <= limit
    a, b = size[left][:, None], size[right][None, :]
    near &= denominator * np.minimum(a, b) >= numerator * np.maximum(a, b)
    if same:
        near &= np.arange(n)[:, None] < np.arange(n)[None, :]
    keep_l, keep_r = near.any(axis=1), near.any(axis=0)
    if not keep_l.any():
        return []
    left, right, near = left[keep_l], right[keep_r], near[np.ix_(keep_l, keep_r)]
    common_part = exact_intersections(sets, left, right)
    union = size[left][:, None] + size[right][None, :] - common_part
    linked = near & (denominator * common_part >= numerator * union)
    tree, found = _Sets(n), []
    for i, j in zip(*np.nonzero(linked)):
        if tree.join(int(left[i]), int(right[j])):
            found.append((int(left[i]), int(right[j])))
    return found


def _link(width: int, numerator: int, denominator: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node")
        same = bool((group["i"] == group["j"]).iloc[0])
        sets = [hashing.shingles(t, width) for t in group["text"]]
        sketches = np.frombuffer(b"".join(group["sketch"]), dtype=np.uint64).reshape(len(group), -1)
        side = (group["block"] == group["j"]).to_numpy().astype(int)
        node = group["node"].to_numpy()
        links = forest(sets, sketches, side, same, numerator, denominator)
        return pd.DataFrame({"a": [node[i] for i, _ in links], "b": [node[j] for _, j in links]}, dtype=np.int64)

    return run


def near_duplicates(docs: DataFrame, width: int = 5, numerator: int = 80, denominator: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept, then text_hash and group (one value a component, null
    where there are no shingles).

    Words are runs of bytes other than ASCII white space, A-Z lowered; a text with fewer than `width` words is one shingle;
    a null, empty or blank text has none and is linked with nothing. Documents are linked where denominator * intersection
    >= numerator * union; component_id is the smallest id that links reach (its own, if none), kept says that it is its
    own. Rows with the same id and the same set are the same document; each is returned. A null id is never a smallest one
    unless all of its component are null.
    """
    spark = docs.sparkSession
    common.ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    signed, _ = common.save(rows.mapInArrow(common.tidied(_sign(width, band_count(numerator / denominator))), SIGNED_SCHEMA), "signed")
    first = F.min_by(F.struct("doc_id", "text_hash", "n_shingles", "bands", "sketch"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash"))
    one = signed.where("n_shingles > 0").groupBy("set_key").agg(first.alias("f")).select("set_key", "f.*")
    classes, _ = common.save(one.withColumn("node", F.monotonically_increasing_id()), "classes")
    keys = classes.select("node", F.explode("bands").alias("key"))
    stars = keys.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("key", "a")
    edges = keys.join(stars, "key").where("node > a").select("a", F.col("node").alias("b"))
    clusters, _ = common.save(connected_components(edges), "clusters")
    members = clusters.join(classes.select("node", "doc_id", "text_hash", "n_shingles", "sketch"), "node")
    sizes = clusters.join(classes.select("node", "n_shingles"), "node").groupBy("root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK_CLASSES), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int")
    members = members.join(sizes.select("root", blocks.alias("blocks")), "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    texts = members.join(rows, [members.doc_id.eqNullSafe(rows.doc_id), members.text_hash == rows.text_hash]).select("root", "node", "sketch", "blocks", "block", "text").dropDuplicates(["node"])  # rows of one id and text may be many
    pairs = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "sketch", "text"
    )
    links = pairs.groupBy("root", "i", "j").applyInPandas(_link(width, numerator, denominator), LINK_SCHEMA)
    linked, _ = common.save(connected_components(links), "linked")
    ids = classes.select("node", "set_key", F.col("doc_id").alias("least"))
    named = ids.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    component = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("set_key", "component_id", F.col("root").alias("group"))
    return (
        signed.select("doc_id", "text_hash", "n_shingles", "set_key")
        .join(component, "set_key", "left")
        .withColumn("component_id", F.coalesce("component_id", "doc_id"))
        .select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_hash", "group")
    )


def keep_one(docs: DataFrame, width: int = 5, numerator: int = 80, denominator: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one of each component, that of the smallest id (then text hash), with all their columns.
    Documents without words all stay; of rows with equal id and text one stays."""
    found = near_duplicates(docs, width, numerator, denominator, id_col, text_col)
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")
    chosen = found.where("group is not null").groupBy("group").agg(F.min(place).alias("p")).select("p.doc_id", "p.text_hash", F.lit(False).alias("__fl_blank"))
    blank = found.where("group is null").select("doc_id", "text_hash", F.lit(True).alias("__fl_blank")).distinct()
    kept = chosen.unionByName(blank).select(*common.row_key("doc_id", F.col("text_hash")), "__fl_blank")
    rows = docs.withColumns(dict(zip(common.ROW_KEY, common.row_key(id_col, F.xxhash64(text_col))))).join(kept, common.ROW_KEY)
    return rows.withColumn("__fl_row", F.when(F.col("__fl_blank"), F.monotonically_increasing_id()).otherwise(F.lit(0))).dropDuplicates([*common.ROW_KEY, "__fl_row"]).select(*docs.columns)


def op10_odd_sketch_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), width=3, numerator=85).drop("text_hash", "group")
