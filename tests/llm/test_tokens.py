"""The codec against the library, on documents and on drawn texts."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sentencepiece = pytest.importorskip("sentencepiece")

from gaugewright.llm import sentencepiece_codec as codec
from gaugewright.llm.queries import op9, piece_model

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=piece_model())
OWN = codec.Codec(codec.Pieces.load(piece_model()))


def check(text):
    want = LIBRARY.encode(text, add_bos=True, add_eos=True)
    got = OWN.encode(text)
    assert np.frombuffer(got, "<u4").tolist() == want
    assert OWN.decode(got) == LIBRARY.decode(want)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet=" ▁aeintshr\n.é1日🎉", max_size=80)))
def test_any_text(text):
    check(text.encode("utf-8", "ignore").decode())


@pytest.mark.parametrize("text", ["", " ", "  ", "\n", "a" * 3000, " " * 700, " " * 37 + "x", "▁", "x▁ y", "\x00", "Hello world, 1234 numbers", "für größere Straßen"])
def test_edges(text):
    check(text)


def test_documents(spark, folder):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for row in op9(spark, folder).collect():
        ids = LIBRARY.encode(texts[row.doc_id], add_bos=True, add_eos=True)
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()


def test_null_empty_repeated_and_clashing(frame):
    rows = [(1, None, "x", 5), (1, None, "x", 5), (None, "", "y", 6), (2, "a" * 50_000, "z", 7)]
    out = codec.encode_decode(frame(rows, "doc_id bigint, text string, ids string, n_tokens int"), piece_model()).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.decoded) for r in out)[:3] == [(0, 2, ""), (1, 2, ""), (1, 2, "")]
    assert codec.encode_decode(frame([], "doc_id bigint, text string"), piece_model()).count() == 0
