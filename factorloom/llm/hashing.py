"""Vectorised hashes of words and of runs of words, straight from a text's bytes."""

from __future__ import annotations

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20240))
_odd = lambda n: _rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2)
_RUN = _odd(64)
_POWER = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        for k, base in enumerate((_POWER, pow(_POWER, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def words(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each maximal run of bytes other than ASCII white space; offsets are bytes."""
    b = np.frombuffer(raw, dtype=np.uint8)
    n = len(b)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[b], [True]])))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, dtype=np.uint64), start, end
    power, inverse = _power(n)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((_BYTE[b] + np.uint64(1)) * power[:n], dtype=np.uint64)])
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64)), start, end


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` consecutive words; of the whole sequence where there are fewer."""
    n = len(hashes)
    if not n:
        return hashes
    width, short = min(width, n), n < width
    total = np.zeros(n - width + 1, dtype=np.uint64)
    for k in range(width):
        total += hashes[k : n - width + 1 + k] * _RUN[k]
    return mix(total + np.uint64(width if short else 0))


def lowered(text: str | None) -> bytes:
    """UTF-8 with A-Z in lower case and all else as it is."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles."""
    return np.unique(runs(words(lowered(text))[0], width))
