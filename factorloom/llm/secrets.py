"""Secret scans with corpus-wide ownership frequency.

Credential-shaped spans are found in every text. Each candidate value is hashed, and the corpus tells how many distinct
owners and repositories hold it: values that at least `EXAMPLE_OWNERS` owners share, and values of low variety, are
widely copied examples; the rest are owner-specific and live-looking. The counts also add spans: a bare token that equals
the value of a live-looking credential found elsewhere under a keyword is reported as `reuse`. Such tokens have a letter, a
digit and `LEAST_BARE` characters; they are runs of a value's characters and what '=' and '/' part in these.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The base kinds of the contract and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")  # a run of 32 or more is a whole run: the leftmost match takes all of it
LEAST_ASSIGN, LEAST_ACCESS = 8, 16
WORDS = ("pass", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "reuse")

BARE = re.compile(r"(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z+/_.=-]*[0-9])[A-Za-z0-9+/_.=-]{16,}")  # whole runs with a digit
LEAST_BARE = 16
SEGMENT = re.compile(r"[^=/]+")
DIGIT, LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")
EXAMPLE_OWNERS = 3
LEAST_VARIETY = 6

FOUND_SCHEMA = (
    "uid long, doc_id long, text_hash long, owner long, repository long, n_assign long, n_access long, n_hex long, base_sha256 string, "
    "kinds array<int>, starts array<int>, ends array<int>, hashes array<long>, varied array<boolean>"
)


def value_hash(value: str) -> int:
    """64 signed bits of a value's digest, full stops at its end aside; the values themselves never leave their document."""
    return int.from_bytes(hashlib.blake2b(value.rstrip(".").encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def find(text: str | None) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) of the base spans by start, then kind; then the bare candidates (kind 3)."""
    if not text:
        return []
    base = []
    low = text.lower()
    if any(w in low for w in WORDS):
        base += [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        base += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    base += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    base.sort(key=lambda x: (x[1], x[0]))
    starts, ends = [], []  # what base spans cover, joined
    for _, a, b, _ in base:
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    bare = []
    for m in BARE.finditer(text):
        for a, b in _tokens(m[0], m.start()):
            value, k = text[a:b], bisect_left(starts, b) - 1
            if DIGIT.search(value) and LETTER.search(value) and not (k >= 0 and ends[k] > a):
                bare.append((3, a, b, value))
    return base + bare


def _tokens(run: str, at: int) -> list[tuple[int, int]]:
    """(start, end) of a run that starts at `at`, of what follows its first '=', and of each part between '=' and '/'; no
    full stops at the end, `LEAST_BARE` characters at least."""
    cuts = [(0, len(run)), (run.find("=") + 1, len(run)), *(m.span() for m in SEGMENT.finditer(run))]
    found = {(a, a + len(run[a:b].rstrip("."))) for a, b in cuts}
    return sorted((at + a, at + b) for a, b in found if b - a >= LEAST_BARE)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 2000):
            part = batch.slice(lo, 2000)
            out = []
            for text in part.column(5).to_pylist():
                found = find(text)
                base = [x for x in found if x[0] < 3]
                n = [sum(x[0] == k for x in base) for k in range(3)]
                digest = hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b, _ in base).encode()).hexdigest()
                out.append((*n, digest, *([x[i] for x in found] for i in range(3)), [value_hash(x[3]) for x in found], [len(set(x[3])) >= LEAST_VARIETY for x in found]))
            yield common.batch(FOUND_SCHEMA, *(part.column(i) for i in range(5)), *(list(c) for c in zip(*out)))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str = "source", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """One row a document: doc_id, text_hash, n_assign, n_access, n_hex, base_sha256, spans, then span_kinds, span_starts, span_ends,
    span_live (arrays in the order of `spans`), n_live, n_example, n_reuse.

    A null or empty text has no spans. Repeated rows give repeated rows and count once for their owner. A null owner is an
    owner of its own. Spans come by start, then kind; offsets are code points with the end exclusive.
    """
    common.ship(docs.sparkSession)
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.xxhash64(owner_col).alias("owner"), F.xxhash64(owner_col, repository_col).alias("repository"), F.col(text_col).alias("text")
    )
    found, _ = common.save(rows.mapInArrow(common.tidied(_scan), FOUND_SCHEMA), "secrets")
    spans = found.where(F.size("kinds") > 0).select("uid", "owner", "repository", F.posexplode(F.arrays_zip("kinds", "starts", "ends", "hashes", "varied")).alias("at", "s")).select("uid", "owner", "repository", "s.*")
    owned = (
        spans.groupBy("hashes", "owner", "repository")
        .agg(F.max(F.col("kinds").isin(0, 1)).alias("keyed"), F.max("varied").alias("varied"))
        .groupBy("hashes", "owner")
        .agg(F.count("*").alias("repositories"), F.max("keyed").alias("keyed"), F.max("varied").alias("varied"))
        .groupBy("hashes")
        .agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.max("keyed").alias("keyed"), F.max("varied").alias("varied"))
    )
    judged = (
        spans.select("uid", "kinds", "starts", "ends", "hashes")
        .join(owned.select("hashes", "keyed", ((F.col("owners") < example_owners) & F.col("varied")).alias("live")), "hashes")
        .where((F.col("kinds") < 3) | (F.col("keyed") & F.col("live")))
        .groupBy("uid")
        .agg(F.array_sort(F.collect_list(F.struct("starts", "kinds", "ends", "live"))).alias("s"))
    )
    names = F.array(*map(F.lit, KINDS))
    count = lambda keep: F.coalesce(F.size(F.filter("s", keep)).cast("long"), F.lit(0).cast("long"))
    text_of = F.array_join(F.transform("s", lambda x: F.concat_ws(":", F.get(names, x["kinds"]), x["starts"].cast("string"), x["ends"].cast("string"))), ",")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    return found.select("uid", "doc_id", "text_hash", "n_assign", "n_access", "n_hex", "base_sha256").join(judged, "uid", "left").select(
        "doc_id", "text_hash", "n_assign", "n_access", "n_hex", "base_sha256",
        F.coalesce(text_of, F.lit("")).alias("spans"),
        F.coalesce(F.transform("s", lambda x: F.get(names, x["kinds"])), none("string")).alias("span_kinds"),
        F.coalesce(F.col("s.starts"), none("int")).alias("span_starts"),
        F.coalesce(F.col("s.ends"), none("int")).alias("span_ends"),
        F.coalesce(F.col("s.live"), none("boolean")).alias("span_live"),
        count(lambda x: x["live"]).alias("n_live"),
        count(lambda x: ~x["live"]).alias("n_example"),
        count(lambda x: x["kinds"] == 3).alias("n_reuse"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with each live-looking span replaced by `mark`; all other columns and rows stay as they are, except
    that n_chars, where there is such a column and a text changed, counts the new text."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def cut(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([t if a is None else _without(t, a, b, mark) for t, a, b in zip(text, starts, ends)], dtype=object)

    hit = lambda name: F.transform(F.filter(F.arrays_zip("span_live", name), lambda x: x["span_live"]), lambda x: x[name])
    live = (
        scan(docs, id_col, text_col, **options).where("n_live > 0").select(*common.row_key("doc_id", F.col("text_hash")), hit("span_starts").alias("__fl_starts"), hit("span_ends").alias("__fl_ends")).dropDuplicates(common.ROW_KEY)
    )
    joined = docs.withColumns(dict(zip(common.ROW_KEY, common.row_key(id_col, F.xxhash64(text_col))))).join(live, common.ROW_KEY, "left")
    changed = joined.withColumn(text_col, F.when(F.col("__fl_starts").isNull(), F.col(text_col)).otherwise(cut(text_col, "__fl_starts", "__fl_ends")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = changed.withColumn("n_chars", F.when(F.col("__fl_starts").isNull(), F.col("n_chars")).otherwise(F.length(text_col).cast(kind)))
    return changed.select(*docs.columns)


def _without(text: str, starts, ends, mark: str) -> str:
    out, at = [], 0
    for a, b in sorted(zip(starts, ends)):
        if b > at:
            out += [text[at:a], mark] if a >= at else []
            at = b
    return "".join([*out, text[at:]])


def op7_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents")).drop("text_hash")
