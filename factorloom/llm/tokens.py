"""Text to token ids with the tokenizers library, each distinct segment between spaces encoded once per worker.

A segment's ids do not depend on its neighbours where the tokenizer's pre-tokenizer cuts at every space; this holds for
byte-level BPE with its standard pattern and for word BPE that drops white space. Other tokenizers, and texts in which a
space follows white space, are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_AFTER_SPACE = re.compile(r"\s ")
#: Runs that the standard patterns keep apart whatever Unicode version they use; apostrophes are left to the library.
_RUNS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]+|[!-&(-/:-@\[-`{-~]+|\n(?=\S)")
_CUT, _LETTER, _DIGIT, _SIGN, _TAIL, _ODD = range(6)
_LONGEST = 256  # longer runs are encoded wherever they occur and not kept


@lru_cache(1)
def _byte_letters() -> dict[int, str]:
    """Byte to the printable letter that byte-level vocabularies use: printable bytes stand for themselves."""
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _segments(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The segments between spaces of all texts: where each text's begin (and the last's end), codes, and what these stand for."""
    parts = pc.split_pattern(texts, " ")
    coded = parts.flatten().dictionary_encode()
    return parts.offsets.to_numpy(), coded.indices.to_numpy().copy(), coded.dictionary.to_pylist()


@lru_cache(1)
def _kinds() -> tuple[bytes, bytes]:
    """Byte to its kind in UTF-8, with letters as in _RUNS, and byte to its lower case."""
    kind, lower = bytearray([_ODD]) * 256, bytearray(range(256))
    for b in range(33, 127):
        c = chr(b)
        kind[b] = _LETTER if c.isalpha() else _DIGIT if c.isdecimal() else _ODD if c == "'" else _SIGN
        lower[b] = ord(c.lower())
    for b in b" \t\n\r":
        kind[b] = _CUT
    kind[0xC3] = _LETTER
    kind[0x80:0xC0] = bytes([_TAIL]) * 64
    return bytes(kind), bytes(lower)


def _lower_runs(texts: pa.Array) -> tuple[np.ndarray, pa.Array, list[str]]:
    """The runs of all texts, none null, in lower case and without white space: where each text's begin (and the last's end),
    codes, and what these stand for. A digit is a run; so is, as it stands, a stretch between white space that holds anything
    but what _RUNS keeps apart."""
    texts = texts.cast(pa.large_binary())
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2].slice(at[0], at[-1] - at[0]).to_pybytes()
    at = at - at[0]
    size = len(raw)
    data = np.frombuffer(raw, dtype=np.uint8)
    kind, lower = (np.frombuffer(bytearray(raw.translate(to)), dtype=np.uint8) for to in _kinds())
    tail = np.flatnonzero(kind == _TAIL)
    if len(tail):  # after C3 these are letters but for the signs of times and division
        second = data[tail]
        letter = (data[tail - 1] == 0xC3) & (second != 0x97) & (second != 0xB7)
        kind[tail] = np.where(letter, _LETTER, _ODD)
        lower[tail] += (32 * (letter & (second < 0x9F))).astype(np.uint8)
    first = np.zeros(size + 1, dtype=bool)
    first[at] = True
    first = first[:size]
    keep = kind != _CUT
    odd = np.flatnonzero(kind == _ODD)
    if len(odd):
        edges = np.append(np.flatnonzero(first | ~keep), size)
        of = np.unique(np.searchsorted(edges, odd, side="right"))
        change = np.zeros(size + 1, dtype=np.int8)
        change[edges[of - 1]] += 1
        change[edges[of]] -= 1
        inside = keep & (np.cumsum(change[:size], dtype=np.int8) > 0)
        kind[inside] = _ODD
        lower[inside] = data[inside]
    begins = first | (kind == _DIGIT)
    begins[1:] |= kind[1:] != kind[:-1]
    begins &= keep
    lower = lower[keep]
    ends = np.append(np.flatnonzero(begins[keep]), len(lower)).astype(np.int32)
    coded = pa.Array.from_buffers(pa.string(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(lower)]).dictionary_encode()
    return np.searchsorted(np.flatnonzero(begins), at), coded.indices, coded.dictionary.to_numpy(zero_copy_only=False).tolist()


class SegmentEncoder:
    """ids(text): the token ids of a whole text as an array. With `special`, the strings of special tokens in a text become
    those tokens, as the library does by default; without, they are ordinary text. `limit` bounds each of the two
    generations of the cache."""

    def __init__(self, path: str, special: bool = False, limit: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = not special
        self.size = self.tok.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        spec = json.loads(self.tok.to_str())
        added = [t for t in self.tok.get_added_tokens_decoder().values() if special or not t.special]
        self.added = [t.content for t in added]  # a text that holds one is encoded whole
        self.mode = "whole" if any(t.normalized for t in added) else self._mode(spec)
        self.limit = limit
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        model = self.tok.model
        if hasattr(model, "_resize_cache"):
            model._resize_cache(0)  # the caches here replace the model's own
        self.tokenize = model.tokenize
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.letters = _byte_letters()

    @staticmethod
    def _mode(spec: dict) -> str:
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if spec.get("post_processor") or spec.get("truncation") or spec.get("padding") or spec["model"].get("type") != "BPE":
            return "whole"
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
            return "spaced"
        steps = [x.get("type") for x in (norm or {}).get("normalizers", [])]
        cuts = pre.get("pretokenizers", [])
        if steps == ["NFC", "Replace", "Lowercase"] and cuts and cuts[0].get("type") == "Split" and cuts[0].get("invert") and cuts[0].get("behavior") == "Removed":
            return "dropped"
        return "whole"

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _model(self, run: str) -> bytes:
        """Ids of one pre-token by the library's BPE model."""
        plain = f"\u0120{run[1:]}" if run[0] == " " else run
        if not run.isascii() or run == "\n":
            letters = self.letters
            plain = "".join([letters[b] for b in run.encode()])
        return array(self.code, [t.id for t in self.tokenize(plain)]).tobytes()

    def _run(self, run: str) -> bytes:
        found = self.runs.get(run)
        if found is None:
            if len(self.runs) >= self.limit:
                self.runs.clear()
            found = self.runs[run] = self._model(run)
        return found

    def _make(self, segment: str) -> bytes:
        runs = _RUNS.findall(segment)
        if not runs or sum(map(len, runs)) != len(segment):
            return self._whole(" " + segment if self.mode == "spaced" else segment)
        if self.mode == "spaced":
            runs[0] = " " + runs[0]
            if runs[0] == " \n":
                return self._whole(" " + segment)
        else:
            runs = [y for x in runs if x != "\n" for y in (x if x[0].isdecimal() else [x.lower()])]
        if len(runs) == 1:
            return self._model(runs[0])
        return b"".join([self._run(x) for x in runs])

    def _miss(self, segment: str) -> bytes:
        found = self.old.get(segment)
        if found is None:
            found = self._make(segment)
        self.young[segment] = found
        return found

    def _uncut(self, text: str) -> bool:
        """Whether a text has to be encoded whole."""
        return self.mode == "whole" or any(x in text for x in self.added) or (self.mode == "spaced" and _AFTER_SPACE.search(text) is not None)

    def raw(self, text: str | None) -> bytes:
        """The ids as little-endian bytes of `dtype`."""
        if not text:
            return b""
        if self._uncut(text):
            return self._whole(text)
        segments = text.split(" ")
        head = b""
        if self.mode == "spaced":
            head = self._whole(segments[0]) if segments[0] else b""
            segments = segments[1:]
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        out = list(map(self.young.get, segments))
        if None in out:
            young, miss = self.young, self._miss
            for i, b in enumerate(out):
                if b is None:
                    s = segments[i]
                    out[i] = young.get(s) or miss(s)
        return head + b"".join(out)

    def _shared(self, run: str) -> bytes:
        """Ids of a run from two generations of runs."""
        found = self.runs.get(run)
        if found is None:
            found = self.runs[run] = self.older.get(run) or self._model(run)
        return found

    def _joined(self, segment: str, space: str) -> bytes:
        """Ids of a segment of a "spaced" text after `space`, which is empty before a text's first one, from those of its runs."""
        if segment.isascii() and segment.isalpha():
            return self._shared(space + segment)
        runs = _RUNS.findall(segment)
        if not runs or sum(map(len, runs)) != len(segment) or (space and runs[0] == "\n"):
            return self._whole(space + segment) if space or segment else b""
        runs[0] = space + runs[0]
        return b"".join([self._shared(x) for x in runs])

    def raws(self, texts: pa.Array, end: bytes = b"") -> list[bytes]:
        """raw() of every text of a column, with `end` appended. Arrow cuts the texts at spaces and finds the distinct segments
        of the column, so that each is looked at once; what is kept from one column to the next are runs, which many segments
        share. Without spaces among the ids the column is cut into runs at once."""
        if self.mode == "dropped":
            return self._raws_of_runs(texts, end)
        if self.mode != "spaced":
            return [self.raw(t) + end for t in texts.to_pylist()]
        out = [end] * len(texts)
        cut = []
        for i, text in enumerate(texts.to_pylist()):
            if text and self._uncut(text):
                out[i] = self._whole(text) + end
            elif text:
                cut.append(i)
        if not cut:
            return out
        if len(self.runs) >= self.limit:
            self.older, self.runs = self.runs, {}
        flat, ends = self._column(texts if len(cut) == len(texts) else texts.take(pa.array(cut, pa.int64())))
        for i, a, b in zip(cut, ends, ends[1:]):
            out[i] = flat[a:b].tobytes() + end
        return out

    def _column(self, texts: pa.Array) -> tuple[memoryview, list[int]]:
        """The ids of all texts of a column, none null or empty, and where each text begins and the last ends."""
        at, code, names = _segments(texts)
        first = code[at[:-1]]  # no space precedes a text's first segment: it gets a code of its own
        inside = np.bincount(code, minlength=len(names)) > np.bincount(first, minlength=len(names))
        code[at[:-1]] = np.arange(len(names), len(names) + len(first))
        found = [self._joined(s, " ") if k else b"" for s, k in zip(names, inside.tolist())]
        found += [self._joined(names[c], "") for c in first.tolist()]
        flat = pa.array(found, pa.large_binary()).take(pa.array(code))
        return memoryview(flat.buffers()[2]), np.frombuffer(flat.buffers()[1], dtype=np.int64)[at].tolist()

    def _stretch(self, run: str) -> bytes:
        """Ids of a run of a "dropped" text that the young generation of runs does not hold."""
        found = self.older.get(run)
        if found is None:
            found = self._model(run) if _RUNS.fullmatch(run) else self._whole(run)
        if len(run) <= _LONGEST:
            self.runs[run] = found
        return found

    def _raws_of_runs(self, texts: pa.Array, end: bytes) -> list[bytes]:
        """raws() of "dropped" texts."""
        whole = np.zeros(len(texts), dtype=bool)
        for x in self.added:
            whole |= pc.match_substring(texts, x).fill_null(False).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(whole), "", texts).fill_null("") if whole.any() or texts.null_count else texts
        out = [end] * len(texts)
        if pc.any(pc.greater(pc.binary_length(plain), 0)).as_py():
            if len(self.runs) >= self.limit:
                self.older, self.runs = self.runs, {}
            at, code, names = _lower_runs(plain)
            found = [f if f is not None else self._stretch(n) for f, n in zip(map(self.runs.get, names), names)]
            flat = pa.array(found, pa.large_binary()).take(code)
            ids, ends = memoryview(flat.buffers()[2] or b""), np.frombuffer(flat.buffers()[1], dtype=np.int64)[at].tolist()
            out = [ids[a:b].tobytes() + end for a, b in zip(ends, ends[1:])]
        for i in np.flatnonzero(whole).tolist():
            out[i] = self._whole(texts[i].as_py()) + end
        return out

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.raw(text), dtype=self.dtype)


@lru_cache(4)
def encoder(path: str, special: bool = False, limit: int = 400_000) -> SegmentEncoder:
    """One encoder for each worker process, vocabulary file, treatment of special tokens and size of caches."""
    return SegmentEncoder(path, special, limit)
