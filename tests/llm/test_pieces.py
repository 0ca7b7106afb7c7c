"""Piecewise encoding against encoding whole texts."""

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelock.llm import pieces

NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
TEXT = st.lists(st.sampled_from(list("aAbé ÉÀ×÷́ \n\t\r.,'sStTrRevV!?#1 2\x85\xa0　\x1c€…漢") + ["<|endoftext|>", "  ", " \n", "'re", "n't"]), max_size=40).map("".join)


def direct(enc, texts):
    return [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]


def piecewise(enc, texts):
    ids, at = enc.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=300, deadline=None)
@given(texts=st.lists(TEXT, max_size=6))
def test_same_ids_as_whole_texts(name, texts):
    enc = pieces.encoder(pieces.tokenizer_path(name))
    assert enc.split
    assert piecewise(enc, texts) == direct(enc, texts)


@pytest.mark.parametrize("name", NAMES)
def test_documents_twice_and_in_slices(name):
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").combine_chunks()
    enc = pieces.PieceEncoder(pieces.tokenizer_path(name))
    expected = direct(enc, texts.to_pylist())
    for _ in range(3):
        got = []
        for a, b in pieces.chunks(texts, 50_000):
            got += piecewise(enc, texts.slice(a, b - a).to_pylist())
        assert got == expected


def test_forgets_when_full(monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_PIECES", 3)
    enc = pieces.PieceEncoder(pieces.tokenizer_path(NAMES[1]))
    for n in range(5):
        texts = ["a b c d e f g", f"x{n} y{n} a b, c."]
        assert piecewise(enc, texts) == direct(enc, texts)
