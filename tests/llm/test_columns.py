"""Token ids of whole columns: the library's ids, and a run of letters reaches the library's model once a column."""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from factorloom.llm import common, tokens

BYTES, WORDS = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
ODD = [
    None, "", " ", "  a", " a", "a ", "a b ", "a  b", "a \n b", "\nA b", "\n", " \nA b", "a \nB c", "x\n\ny z\n", "don't we'll IT'S", "<|endoftext|> a", "a\x1cb \x85 c", "\xa0 a", "a　 b", "WORD!! it%%% &&& |", "été.\nÀ ça,",
    "tab\tand  more ", "a1b2 3.14", "日本語 text", "\U0001f600 \U0001f600!", "a\x00b c",
]


def ids(encoder: tokens.SegmentEncoder, texts: list[str | None], kind: pa.DataType = pa.string()) -> list[list[int]]:
    code = {2: "H", 4: "I"}[encoder.dtype.itemsize]
    return [memoryview(r).cast(code).tolist() for r in encoder.raws(pa.array(texts, kind))]


@pytest.mark.parametrize("path", [BYTES, WORDS])
@pytest.mark.parametrize("special", [True, False])
@pytest.mark.parametrize("limit", [3, 400_000])
def test_odd_columns_encode_like_the_library(path, special, limit):
    plain, ours = Tokenizer.from_file(path), tokens.SegmentEncoder(path, special, limit)
    plain.encode_special_tokens = not special
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in ODD]
    for kind in (pa.string(), pa.large_string()):
        assert ids(ours, ODD, kind) == want
    assert ids(ours, ODD[::-1]) == want[::-1]
    assert [ids(ours, [t])[0] for t in ODD] == want and ids(ours, []) == []
    assert [ours.ids(t).tolist() for t in ODD] == want  # after columns, single texts keep their ids
    part = pa.array(["skipped", *ODD, "skipped"]).slice(1, len(ODD))
    assert ours.raws(part) == [ours.raw(t) for t in ODD]


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.none() | st.text(st.sampled_from("ab Zé,.!'9\n\t\x85 ñ日") | st.characters(exclude_categories=["Cs"]), max_size=25), max_size=6))
def test_columns_encode_like_the_library(texts):
    plain, ours = Tokenizer.from_file(BYTES), tokens.encoder(BYTES, True)
    assert ids(ours, texts) == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_a_run_reaches_the_model_once():
    ours, seen = tokens.SegmentEncoder(BYTES, True), []
    model = ours.tokenize
    ours.tokenize = lambda run: (seen.append(run), model(run))[1]
    for _ in range(2):
        ours.raws(pa.array(["x plover plover, plover. plover!\nThe plover", "x plover.\nThe, plover! The"] * 50))
    assert len(seen) == len(set(seen)) and set(seen) == {"x", "Ġplover", ",", ".", "!", "Ċ", "The", "ĠThe"}


def test_chunks_cover_all_rows_and_keep_long_texts_whole():
    texts = pa.array(["skipped", "aa", None, "", "bbb", "c" * 50, "é", "d"]).slice(1)
    assert list(common.chunks(texts, 5)) == [(0, 4), (4, 1), (5, 2)]
    assert list(common.chunks(texts, 1000)) == [(0, 7)] and list(common.chunks(texts.slice(0, 0), 5)) == []
