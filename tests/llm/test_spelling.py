"""Spelling variants against comparing every two words, and the bound of every word against all its edits."""

import random
import zlib

import pytest

from gaugewright.llm import spelling_variants as sv


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(counts, ratio=5, min_size=6, min_n=5):
    kept = {w: n for w, n in counts.items() if len(w) >= min_size and n >= min_n}
    out = {}
    for w, n in kept.items():
        others = [x for x in kept if x != w and near(w, x)]
        best = min(((-kept[x], x) for x in others), default=None)
        form = best[1] if best and -best[0] >= ratio * n else None
        out[w] = (form, n, len(others), -best[0] if form else None)
    rows = []
    for w, (form, n, n_near, form_n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, n, n_near, form_n))
    return sorted(rows, key=lambda r: r[0])


def drawn(seed, letters, n):
    draw = random.Random(seed)
    words = {}
    for _ in range(n):
        w = "".join(draw.choices(letters, k=draw.randint(5, 11)))
        for _ in range(3):
            words[w] = draw.choice([1, 5, 6, 30, 150, 700, 700])
            k = draw.randrange(len(w) + 1)
            w = draw.choice([w[:k] + draw.choice(letters) + w[k:], w[:k] + w[k + 1 :], w[:k] + draw.choice(letters) + w[k + 1 :]])
    return words


@pytest.mark.parametrize("seed,letters,common", [(1, "ab", 4), (2, "abcdeé", 4), (3, "abcdefghijklmnopß", 32), (4, "ÀÿaA", 8)])
def test_same_as_all_pairs(frame, monkeypatch, seed, letters, common):
    monkeypatch.setattr(sv, "LEAST_COMMON", common)
    counts = drawn(seed, letters, 250)
    got = sv.variants(frame(list(counts.items()), "word string, n bigint"))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[0]) == plain(counts)


@pytest.mark.parametrize("seed,longest", [(1, 3), (2, 4), (3, 5), (4, 6)])
def test_bound_holds_for_every_edit(seed, longest):
    """After any one edit a word keeps all its grams but as many as its bound says, at their place or one beside it."""
    draw = random.Random(seed)
    common = {}
    for q in range(2, longest + 1):
        for _ in range(40 * q):
            g = "".join(draw.choices("abc", k=q))
            if q == 2 or g[:-1] in common:
                common[g] = 100
    grams = sv.Dictionary(common, longest)
    lost = 0
    for _ in range(150):
        w = "".join(draw.choices("abc", k=draw.randint(6, 12)))
        own = grams.grams(w)
        bound = grams.touched(w, own)
        for k in range(len(w) + 1):
            edits = [w[:k] + c + w[k:] for c in "abcx"]
            if k < len(w):
                edits += [w[:k] + w[k + 1 :]] + [w[:k] + c + w[k + 1 :] for c in "abcx"]
            for other in edits:
                shift, theirs = len(other) - len(w), {(other[a:b], a) for a, b in grams.grams(other)}
                kept = sum(any((w[a:b], a + s) in theirs for s in {0, shift}) for a, b in own)
                assert kept >= len(own) - bound
                lost = max(lost, len(own) - kept)
                if other != w:
                    shared = {(kind, g) for kind, g, _ in grams.index(w)} & {(kind, g) for kind, g, _ in grams.index(other)}
                    assert shared
    assert lost > 0


def test_words_of_texts(frame):
    docs = [(k, "Straße ÉCOLE don't x2y " * (k % 3) + "naïve-Naïve") for k in range(400)] + [(None, "Word"), (7, None), (8, "")]
    counts = {}
    for k, text in docs:
        run = ""
        for c in (text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
            elif run:
                h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
                w = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run
                counts[w] = counts.get(w, 0) + 1
                run = ""
    got = {r.word: r.n for r in sv.misspelt_words(frame(docs, "doc_id bigint, text string")).collect()}
    assert got == counts and "Éco" not in got and any(len(w) == 5 and w != "naïve" for w in got)


def test_edges(frame):
    rows = [("abcdef", 3, "x"), ("abcdef", 4, "y"), (None, 9, "z"), ("abcdeg", 40, None), ("tooshort"[:5], 99, "x"), ("a" * 5000, 6, "x"), ("a" * 4999, 60, "x")]
    got = {r.word: tuple(r)[1:] for r in sv.variants(frame(rows, "word string, n bigint, form string")).collect()}
    assert got["abcdef"] == ("abcdeg", "abcdeg", 7, 1, 40) and got["abcdeg"] == (None, "abcdeg", 40, 1, None)
    assert got["a" * 5000][:2] == ("a" * 4999,) * 2 and len(got) == 4
    assert sv.variants(frame([], "word string, n bigint")).count() == 0
    assert sv.misspelt_words(frame([], "doc_id string, text string")).count() == 0
    with pytest.raises(ValueError):
        sv.variants(frame(rows, "word string, n bigint, form string"), min_size=3)


def test_chains_lead_to_the_last_form(frame):
    words = ["house" + "s" * k for k in range(1, 8)]
    rows = [(w, 5 * 6 ** (7 - k)) for k, w in enumerate(words)]
    got = {r.word: r.root for r in sv.variants(frame(rows, "word string, n bigint")).collect()}
    assert set(got.values()) == {words[0]} and len(got) == 7


def test_dictionary_keeps_its_size(frame, monkeypatch):
    monkeypatch.setattr(sv, "LEAST_COMMON", 2)
    counts = drawn(5, "abcd", 200)
    words = frame([(w, 9) for w in counts], "word string, n bigint")
    few, many = sv.dictionary(words, 30), sv.dictionary(words, 100_000)
    assert 0 < len(few.common) <= 30 < len(many.common) and all(g[:-1] in many.common for g in many.common if len(g) > 2)
    small = sv.variants(words, size=30).collect()
    assert sorted(map(tuple, small), key=lambda r: r[0]) == plain({w: 9 for w in counts})
