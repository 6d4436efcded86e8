"""Static range asymmetric numeral systems over token ids: one shared frequency table, independent interleaved blocks.

A corpus on disk is a Parquet table `blocks`, one row a block, so that any Spark file system holds it and any block can be
read alone. Columns: shard int, block int (ascending in a shard), first_start long (ids of all documents before it),
doc_ids array<long>, doc_lengths array<long>, n_symbols long, lanes int, states binary (the lanes' final states, little-
endian unsigned 64 bit), words binary (renormalisation words, 32 bit, in reading order), checkpoints binary (step, word
position and states before every CHECK_STEPS-th step), crc32 long (of the ids as little-endian 32 bit). The table
`frequencies` (token int, frequency int; they sum to 2**PRECISION) is shared by all blocks.

Symbol i of a block belongs to lane i mod lanes. A state x lies in [2**31, 2**63); pushing symbol s with frequency f and
cumulative frequency c maps x to (x div f) * 2**PRECISION + x mod f + c, after a 32-bit word is moved out if need be.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import encoder

PRECISION = 20
LOW = 31
CHECK_STEPS = 256
BLOCK_IDS = 1 << 18
#: Texts that are tokenised at once; a longer one is whole and alone.
CHUNK_BYTES = 1 << 23
MAX_LANES = 1024

TOKENS_SCHEMA = "kind int, shard int, doc_id long, tie long, n_ids long, ids binary"
BLOCKS_SCHEMA = (
    "shard int, block int, first_start long, doc_ids array<long>, doc_lengths array<long>, n_symbols long, lanes int, "
    "states binary, words binary, checkpoints binary, crc32 long"
)
READ_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


class FrequencyTable:
    """Frequencies that sum to 2**PRECISION, at least 1 for each token that occurs."""

    def __init__(self, tokens: np.ndarray, frequencies: np.ndarray):
        size = int(tokens.max(initial=-1)) + 1
        self.freq = np.zeros(max(size, 1), dtype=np.uint64)
        self.freq[tokens] = frequencies
        self.cum = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))

    @staticmethod
    def scale(counts: np.ndarray) -> np.ndarray:
        """Counts (> 0) to frequencies by largest remainders; the excess of the lifted ones is taken from the largest."""
        total = 1 << PRECISION
        if not len(counts):
            return counts.astype(np.int64)
        if len(counts) > total // 2:
            raise ValueError("too many distinct ids for this precision")
        exact = counts * (total / counts.sum())
        out = np.maximum(1, np.floor(exact)).astype(np.int64)
        left = total - int(out.sum())
        if left > 0:
            order = np.argsort(-(exact - np.floor(exact)), kind="stable")
            out[order[:left]] += 1
            out[order[0]] += max(0, left - len(order))
        order = np.argsort(-out, kind="stable")
        i = 0
        while (over := int(out.sum()) - total) > 0:
            k = order[i % len(order)]
            take = min(over, max(0, int(out[k]) // 2))
            out[k] -= take
            i += 1
        return out


def lanes_for(n: int) -> int:
    return int(min(MAX_LANES, max(1, 1 << max(0, (n // 128).bit_length() - 1)))) if n else 1


def encode_block(ids: np.ndarray, table: FrequencyTable) -> dict:
    n, lanes = len(ids), lanes_for(len(ids))
    x = np.full(lanes, 1 << LOW, dtype=np.uint64)
    freq, cum = table.freq[ids], table.cum[ids]
    shift, precision = np.uint64(63 - PRECISION), np.uint64(PRECISION)
    out, counts, marks = [], [], []
    for step in range((n + lanes - 1) // lanes - 1, -1, -1):
        a, b = step * lanes, min(n, (step + 1) * lanes)
        f, y = freq[a:b], x[: b - a]
        full = y >= (f << shift)
        moved = y[full]
        out.append(moved.astype("<u4"))
        counts.append(len(moved))
        y[full] = moved >> np.uint64(32)
        q = y // f
        y[:] = (q << precision) + (y - q * f) + cum[a:b]
        if step and step % CHECK_STEPS == 0:
            marks.append((step, x.copy()))
    before = np.concatenate([[0], np.cumsum(counts[::-1])]).astype(np.int64)
    checkpoints = b"".join(np.array([s, before[s]], dtype="<u8").tobytes() + m.astype("<u8").tobytes() for s, m in reversed(marks))
    return {
        "n_symbols": n, "lanes": lanes, "states": x.astype("<u8").tobytes(), "words": np.concatenate(out[::-1]).tobytes() if out else b"",
        "checkpoints": checkpoints, "crc32": zlib.crc32(ids.astype("<u4").tobytes()),
    }


def checkpoints(block: dict) -> list[tuple[int, int, np.ndarray]]:
    """(step, word position, states) of each checkpoint, from which decoding may start."""
    width, raw = 2 + block["lanes"], np.frombuffer(block["checkpoints"], dtype="<u8")
    return [(int(r[0]), int(r[1]), r[2:].astype(np.uint64)) for r in raw.reshape(-1, width)]


def decode_steps(block: dict, table: FrequencyTable, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Symbols of steps start..stop; start is 0 or the step of a checkpoint."""
    n, lanes = block["n_symbols"], block["lanes"]
    steps = (n + lanes - 1) // lanes
    stop = steps if stop is None else min(stop, steps)
    at, x = 0, np.frombuffer(block["states"], dtype="<u8").astype(np.uint64)
    if start:
        at, x = next((p, s) for step, p, s in checkpoints(block) if step == start)
    words = np.frombuffer(block["words"], dtype="<u4")
    mask, precision, low = np.uint64((1 << PRECISION) - 1), np.uint64(PRECISION), np.uint64(1 << LOW)
    out = np.empty(max(0, min(n, stop * lanes) - start * lanes), dtype=np.uint32)
    for step in range(start, stop):
        a, b = step * lanes, min(n, (step + 1) * lanes)
        y = x[: b - a]
        slot = y & mask
        symbol = table.symbol[slot]
        out[a - start * lanes : b - start * lanes] = symbol
        y[:] = table.freq[symbol] * (y >> precision) + slot - table.cum[symbol]
        need = y < low
        k = int(np.count_nonzero(need))
        if k:
            y[need] = (y[need] << np.uint64(32)) | words[at : at + k]
            at += k
    return out


def decode_block(block: dict, table: FrequencyTable) -> np.ndarray:
    """All ids of a block; a wrong checksum raises."""
    ids = decode_steps(block, table)
    if zlib.crc32(ids.astype("<u4").tobytes()) != block["crc32"]:
        raise ValueError(f"block {block.get('shard')}/{block.get('block')}: checksum of the decoded ids differs")
    return ids


@lru_cache(1)
def _zstd():
    import zstandard

    return zstandard.ZstdCompressor(level=1, write_checksum=False), zstandard.ZstdDecompressor()


def _compress(raw: bytes) -> bytes:
    return _zstd()[0].compress(raw)


def _expand(raw: bytes) -> bytes:
    return _zstd()[1].decompress(raw)


def _tokenise(path: str, special: bool, end_id: int, ranges: common.Ranges):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, special)
        counts = np.zeros(max(enc.size, end_id + 1), dtype=np.int64)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        for batch in batches:
            ids, ties, texts = (batch.column(i) for i in range(3))
            for lo, rows in common.chunks(texts, CHUNK_BYTES):
                keys, tie = ids.slice(lo, rows), ties.slice(lo, rows)
                shard = ranges.of(keys.fill_null(common.LOWEST).to_numpy(), tie.to_numpy())
                raws = enc.raws(texts.slice(lo, rows), end)
                counts += np.bincount(np.frombuffer(b"".join(raws), dtype=enc.dtype), minlength=len(counts))
                n = [len(r) // enc.dtype.itemsize for r in raws]
                yield common.batch(TOKENS_SCHEMA, [0] * len(n), shard, keys, tie, n, [_compress(r) for r in raws])
        seen = np.flatnonzero(counts)
        if len(seen):
            packed = np.stack([seen, counts[seen]]).astype("<i8").tobytes()
            yield common.batch(TOKENS_SCHEMA, [1], [-1], [None], [0], [0], [_compress(packed)])

    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            token, n = np.frombuffer(_expand(raw), dtype="<i8").reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(n)], ["token", "n"])


def _blocks(width: int, table: FrequencyTable, base: dict[int, int], block_ids: int):
    dtype = np.dtype("<u2") if width == 2 else np.dtype("<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = {"shard": None, "block": 0, "start": 0}
        docs: list[int | None] = []
        raws: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(raws), dtype=dtype)
            row = {"shard": state["shard"], "block": state["block"], "first_start": state["start"], "doc_ids": docs[:], "doc_lengths": [len(r) // width for r in raws]} | encode_block(ids, table)
            state["block"] += 1
            state["start"] += len(ids)
            docs.clear()
            raws.clear()
            return pa.RecordBatch.from_pylist([row], common.arrow(BLOCKS_SCHEMA))

        for batch in batches:
            shards, ids, packed = (batch.column(i).to_pylist() for i in range(3))
            for shard, doc, z in zip(shards, ids, packed):
                if shard != state["shard"]:
                    if raws:
                        yield flush()
                        size = 0
                    state.update(shard=shard, block=0, start=base[shard])
                raw = _expand(z)
                docs.append(doc)
                raws.append(raw)
                size += len(raw) // width
                if size >= block_ids:
                    yield flush()
                    size = 0
        if raws:
            yield flush()

    return run


def _read(table: FrequencyTable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_block(row, table).astype("<u4")
                ends = np.cumsum(row["doc_lengths"])
                begins = ends - row["doc_lengths"]
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(begins, ends)]
                yield common.batch(READ_SCHEMA, row["doc_ids"], begins + row["first_start"], row["doc_lengths"], crc)

    return run


def _table_of(frequencies: DataFrame) -> FrequencyTable:
    """Bounded by the vocabulary."""
    rows = frequencies.collect()
    return FrequencyTable(np.array([r["token"] for r in rows], dtype=np.int64), np.array([r["frequency"] for r in rows], dtype=np.int64))


def write_corpus(
    docs: DataFrame, out: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS, shards: int | None = None, special: bool = True
) -> None:
    """Tokenise every row's whole text (null: empty), append `end_id`, and write `out`/frequencies and `out`/blocks in
    ascending order of the id (null ids first; equal ids by a hash of the text, then as they come).

    Rows are repeated as often as they occur. An empty table gives empty files. `special`: the strings of special tokens in
    a text become those tokens, as the library does by default. Each range of ids is one task; its bounds come from a sketch
    of the ids, and an id that many rows share is cut by the hash of the text, rows of one id and text by turns. A document is never split between blocks, so a block has at least
    `block_ids` ids and at most that many more than the longest document.
    """
    spark = docs.sparkSession
    common.ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))
    ranges = common.ranges(rows, "doc_id", "tie", shards or common.parts(spark))
    enc = encoder(tokenizer_path, special)
    tokens, path = common.save(rows.mapInArrow(_tokenise(tokenizer_path, special, end_id, ranges), TOKENS_SCHEMA), "tokens", "none")
    counted = tokens.where("kind = 1").select("ids").mapInArrow(_counts, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).orderBy("token").collect()
    token, n = np.array([r["token"] for r in counted], dtype=np.int64), np.array([r["n"] for r in counted], dtype=np.float64)
    frequency = FrequencyTable.scale(n)
    schema = "token int, frequency int"
    spark.createDataFrame([(int(a), int(b)) for a, b in zip(token, frequency)], schema).coalesce(1).write.parquet(f"{out}/frequencies")
    base, at = {}, 0
    for r in tokens.where("kind = 0").groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect():  # a row for each range
        base[r["shard"]] = at
        at += r["n"]
    table = FrequencyTable(token, frequency)
    (
        tokens.where("kind = 0")
        .repartitionById(ranges.count, F.col("shard"))
        .sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "tie")
        .select("shard", "doc_id", "ids")
        .mapInArrow(_blocks(enc.dtype.itemsize, table, base, block_ids), BLOCKS_SCHEMA)
        .write.option("compression", "none")
        .parquet(f"{out}/blocks")
    )
    common.remove(spark, path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Decode the files: doc_id, start, n_tokens, ids_crc32 of each document."""
    common.ship(spark)
    table = _table_of(spark.read.schema("token int, frequency int").parquet(f"{path}/frequencies"))
    return spark.read.schema(BLOCKS_SCHEMA).parquet(f"{path}/blocks").mapInArrow(_read(table), READ_SCHEMA)


def op1_rans_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = common.scratch(spark, "rans")
    write_corpus(common.table(spark, sf_dir, "documents"), out, public_tokenizers.path("byte_bpe_50k.json"))
    return read_corpus(spark, out)
