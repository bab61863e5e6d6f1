"""The byte-pair codec against the library: all characters, drawn texts, documents, and what must not change at forced boundaries."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

tokenizers = pytest.importorskip("tokenizers")

from gaugewright.llm import byte_bpe_codec as codec
from gaugewright.llm.queries import byte_vocabulary, op12

LIBRARY = tokenizers.Tokenizer.from_file(byte_vocabulary())
OWN = codec.Vocabulary.load(byte_vocabulary()).codec()


def check(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    got = OWN.encode(text)
    assert np.frombuffer(got, "<u4").tolist() == want
    assert OWN.decode(got) == LIBRARY.decode(want, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet=" 'aeintshrlvdmé.1\n\t日🎉", max_size=80)))
def test_any_text(text):
    check(text.encode("utf-8", "ignore").decode())


@pytest.mark.parametrize(
    "text",
    [
        "", " ", "   ", "a  b", "\r\n\r\n x", "a" * 4000, " " * 3000 + "x", "é" * 999, "don't we'll 'stuff I'M", "ab" * 3000 + "日本" * 500, "\x00\x85\xa0",
        "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext|", "x՘y \U000323b0", "12345678901 1/2 ½",
    ],
)
def test_edges(text):
    check(text)


def test_characters_of_all_planes():
    for start in [*range(0, 0xD800, 64), *range(0xE000, 0x33500, 64), 0x3D000, 0xE0000, 0x10FFC0]:
        check("".join(f"a{chr(c)}1{chr(c)}  {chr(c)}!{chr(c)}" for c in range(start, start + 64)))


def test_names_of_special_tokens_as_text():
    assert np.frombuffer(OWN.encode("<|endoftext|>"), "<u4").tolist() == [50256]
    as_text = np.frombuffer(OWN.encode("<|endoftext|>", special_as_text=True), "<u4").tolist()
    assert 50256 not in as_text and OWN.decode(OWN.encode("<|endoftext|>", special_as_text=True)) == "<|endoftext|>"


def test_no_token_crosses_a_cut_and_both_ways_of_merging_agree():
    for word in ["Straßenbahnhaltestelle", "xqzjkv" * 9, "naïveté日本語", "aaaaaaaabbbb"]:
        own = word.encode()
        for at in OWN.cuts(own):
            assert not any(own[at - 1 : at + 1] in token for token in OWN.vocabulary.tokens.values())
        single = [OWN.single[b] for b in own]
        assert OWN._plain(list(single)) == OWN._queued(list(single)) == LIBRARY.encode(word, add_special_tokens=False).ids


def test_documents(spark, folder):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op12(spark, folder).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = LIBRARY.encode(texts[row.doc_id], add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()


def test_null_empty_repeated_and_clashing(frame):
    rows = [(1, None, "x", 5), (1, None, "x", 5), (None, "", "y", 6), (2, "ab " * 50_000, "z", 7)]
    out = codec.encode_decode(frame(rows, "doc_id bigint, text string, ids string, n_tokens int"), byte_vocabulary()).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.decoded) for r in out)[:3] == [(0, 0, ""), (1, 0, ""), (1, 0, "")]
    assert max(r.decoded for r in out) == "ab " * 50_000
    assert codec.encode_decode(frame([], "doc_id bigint, text string"), byte_vocabulary()).count() == 0


def test_other_vocabularies_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        codec.Vocabulary.load(public_tokenizers.path("word_bpe_49k.json"))
