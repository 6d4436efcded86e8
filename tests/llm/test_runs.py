"""Token ids by a vocabulary without spaces: the library's ids, and a run of letters reaches the library's model once a column."""

from __future__ import annotations

import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from factorloom.llm import packing, tokens

WORDS = public_tokenizers.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(WORDS)
TEXTS = ["x plover plover, PLOVER. 31 plover!\nThe plover", "x Plover.\n\nThe, plover! the\tx"] * 50
RUNS = {"x", "plover", ",", ".", "!", "the", "3", "1"}
ODD = [
    None, "", " ", "\n", "a", "÷", "a×b c÷", "ÀÖØÞß àöøþÿ Ÿ Ā", "don't IT'S we'll ' 's '", "!'s x'", "é ́ a\ń", "İI Σσ ﬁ", "a\x0bb\x0cc\x1cd\x85e\xa0f", "\r\n\ta\r", "½ ٣ 12a3", "日本語、text 日本",
    "a\x00b", "\U0001f600\U0001f600 !", "<|endoftext|>", "A <|startoftext|>b", "<|endof text|>", "z" * 300 + " " + "Z" * 300, "",
]


@pytest.fixture
def spied():
    """An encoder and the runs that reach its model."""
    encoder, seen = tokens.SegmentEncoder(WORDS, True), []
    model = encoder.tokenize
    encoder.tokenize = lambda run: (seen.append(run), model(run))[1]
    return encoder, seen


def test_a_run_reaches_the_model_once(spied):
    encoder, seen = spied
    for _ in range(2):
        encoder.raws(pa.array(TEXTS))
    assert len(seen) == len(set(seen)) and set(seen) == RUNS


def test_packing_sends_a_run_to_the_model_once(spied, monkeypatch):
    encoder, seen = spied
    monkeypatch.setattr(packing, "encoder", lambda *_: encoder)
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    monkeypatch.setattr(packing, "CHUNK_BYTES", 1000, raising=False)
    texts = [None, *TEXTS, "<|endoftext|>"]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    rows = [r for b in packing._cut(WORDS, True, 1, 20)([batch]) for r in b.to_pylist()]
    assert len(seen) == len(set(seen)) and set(seen) == RUNS
    want = []
    for doc, text in enumerate(texts):
        ids = np.array([*PLAIN.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want += [(doc, at, len(ids[at : at + 20]), zlib.crc32(ids[at : at + 20])) for at in range(0, len(ids), 20)]
    columns = ("doc_id", "start", "length", "ids_crc32")
    assert [x for r in rows for x in zip(*(r[c] for c in columns))] == want


@pytest.mark.parametrize("special", [True, False])
@pytest.mark.parametrize("limit", [1, 400_000])
def test_odd_columns_encode_like_the_library(special, limit):
    plain, ours = Tokenizer.from_file(WORDS), tokens.SegmentEncoder(WORDS, special, limit)
    plain.encode_special_tokens = not special
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in ODD]
    for kind in (pa.string(), pa.large_string()):
        whole = pa.array(["skipped", *ODD, "skipped"], kind).slice(1, len(ODD))
        assert [np.frombuffer(r, ours.dtype).tolist() for r in ours.raws(whole)] == want
        for i in range(len(ODD)):
            assert [np.frombuffer(r, ours.dtype).tolist() for r in ours.raws(whole.slice(i, 1))] == want[i : i + 1]
    assert not any(len(x) > 256 for x in ours.runs)


@settings(max_examples=400, deadline=None)
@given(texts=st.lists(st.none() | st.text(st.sampled_from("abZ Éé,.!'s9\n\t\r\x0b\x85 ñ日×́Σ") | st.characters(exclude_categories=["Cs"]), max_size=25), max_size=6))
def test_columns_encode_like_the_library(texts):
    ours = tokens.encoder(WORDS, True)
    got = [np.frombuffer(r, ours.dtype).tolist() for r in ours.raws(pa.array(texts, pa.string()))]
    assert got == [PLAIN.encode(t or "", add_special_tokens=False).ids for t in texts]
