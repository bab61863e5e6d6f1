"""Removal of repeated bytes against a set of all windows."""

import random

import numpy as np
import pytest

from gaugewright.llm import repeated_bytes
from gaugewright.llm.suffix_array import intervals, maximal_repeats, sorted_suffixes


def brute(texts, length=100):
    seen, out = set(), []
    for text in texts:
        removed = np.zeros(len(text), bool)
        for start in range(len(text) - length + 1):
            window = text[start : start + length]
            if window in seen:
                removed[start : start + length] = True
            seen.add(window)
        out.append(removed)
    return out


def drawn(seed):
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcdé") for _ in range(draw.randint(1, 6))) for _ in range(30)]
    passages = [" ".join(draw.choice(words) for _ in range(draw.randint(10, 80))) for _ in range(6)]
    docs = []
    for _ in range(40):
        kind = draw.random()
        if kind < 0.15 and docs:
            docs.append(draw.choice(docs))
        elif kind < 0.3 and docs:
            text = list(draw.choice(docs))
            for _ in range(draw.randint(1, 4)):
                if text:
                    text[draw.randrange(len(text))] = draw.choice("xyz")
            docs.append("".join(text))
        elif kind < 0.4:
            docs.append(draw.choice(["ab", "a", " x", "abc "]) * draw.randint(1, 300))
        else:
            docs.append(" ".join(draw.choice(passages) if draw.random() < 0.5 else " ".join(draw.choices(words, k=draw.randint(0, 30))) for _ in range(draw.randint(1, 4))))
    return docs


@pytest.mark.parametrize("seed,piece", [(1, 1 << 20), (2, 1 << 20), (3, 300)])
def test_same_bytes_as_all_windows(spark, monkeypatch, seed, piece):
    monkeypatch.setattr(repeated_bytes, "PIECE", piece)
    texts = drawn(seed)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: r for r in repeated_bytes.remove_repeats(frame).collect()}
    raw = [t.encode() for t in texts]
    for number, (text, removed) in enumerate(zip(raw, brute(raw))):
        row = got[number]
        kept = bytes(b for b, gone in zip(text, removed) if not gone)
        spans = int((removed & ~np.concatenate([[False], removed[:-1]])).sum()) if len(text) else 0
        assert (row.n_bytes, row.n_removed, row.n_spans, bytes(row.kept)) == (len(text), int(removed.sum()), spans, kept)


def test_nulls_ties_and_clashing_columns(frame):
    long = "".join(random.Random(4).choices("abcdefgh", k=260))
    rows = [(None, long, "a"), (5, long, "b"), (5, long, "b"), (6, None, "c"), (7, "", "d"), (8, "short", "e")]
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in repeated_bytes.remove_repeats(frame(rows, "doc_id bigint, text string, kept string")).collect())
    assert got == [(False, 0, 260, 0, 0), (True, 5, 260, 260, 1), (True, 5, 260, 260, 1), (True, 6, 0, 0, 0), (True, 7, 0, 0, 0), (True, 8, 5, 0, 0)]
    assert repeated_bytes.remove_repeats(frame([], "doc_id bigint, text string")).count() == 0


def test_intervals_and_maximal_repeats():
    text = np.frombuffer(b"banana$", np.uint8)
    rows = np.array([np.concatenate([text[k:], np.zeros(k, np.uint8)]) for k in range(6)])
    order, lcp = sorted_suffixes(rows)
    assert order.tolist() == [5, 3, 1, 0, 4, 2] and lcp.tolist() == [0, 1, 3, 0, 0, 2]
    assert sorted(intervals(lcp, 1)) == [(1, 0, 2), (2, 4, 5), (3, 1, 2)]
    before = np.array([-1, *text[:5].astype(int)])
    found = {(bytes(rows[m[0]][:n]), tuple(sorted(m.tolist()))) for n, m in maximal_repeats(rows, np.array([7, 6, 5, 4, 3, 2]), before, 1)}
    assert found == {(b"a", (1, 3, 5)), (b"ana", (1, 3))}
