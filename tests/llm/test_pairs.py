"""Vectors, n-gram joins, containment and lines against brute force."""

import math
import random

import numpy as np
import pytest

from gaugewright.llm import containment, embedding_forest, jaccard_join, line_spread
from gaugewright.llm.components import components


def reach(pairs, nodes):
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            best = min(low[a], low[b])
            changed |= low[a] != best or low[b] != best
            low[a] = low[b] = best
    return low


def test_components(frame):
    draw = random.Random(3)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(400, 460)] + [(7, 7)]
    low = reach(edges, {x for e in edges for x in e})
    got = {r.node: r.component for r in components(frame(edges, "a bigint, b bigint")).collect()}
    assert got == {n: c for n, c in low.items() if n in got} and all(n in got for a, b in edges if a != b for n in (a, b))
    assert components(frame([], "a bigint, b bigint")).count() == 0


def vectors(seed, n=700):
    draw = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        if k > 10 and draw.random() < 0.5:
            base = np.array(rows[draw.integers(len(rows))][1])
            v = base if draw.random() < 0.3 else base + draw.normal(size=24) * np.linalg.norm(base) * draw.choice([0.01, 0.035, 0.04, 0.06]) * 1.0
        else:
            v = draw.normal(size=24)
        rows.append((k, [float(np.float32(x)) for x in v], int(draw.integers(2))))
    return rows


@pytest.mark.parametrize("leaf,block", [(64, 1024), (32, 16), (10_000, 50)])
def test_vectors(frame, monkeypatch, leaf, block):
    monkeypatch.setattr(embedding_forest, "LEAF", leaf)
    monkeypatch.setattr(embedding_forest, "BLOCK", block)
    rows = vectors(leaf)
    odd = [(900, None, 1), (901, [0.0] * 24, 1), (902, [math.nan] * 24, 1), (903, [None] * 24, 1), (904, rows[0][1], None), (905, [], 1), (906, [1e300] * 24, 0), (907, [1e300] * 24, 0), (908, [math.inf] * 24, 0)]
    unit = {k: np.array(v) / np.linalg.norm(v) for k, v, _ in rows}
    label = {k: x for k, _, x in rows}
    pairs = [(a, b) for a in unit for b in unit if a < b and label[a] == label[b] and unit[a] @ unit[b] >= 0.98] + [(906, 907)]
    low = reach(pairs, [*unit, *range(900, 909)])
    links = {k: 0 for k in low}
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    got = {r.vec_id: r for r in embedding_forest.near_duplicate_vectors(frame(rows + odd, "vec_id bigint, embedding array<double>, label int")).collect()}
    assert len(pairs) > 200 and set(got) == set(low)
    assert {k: (r.n_links, r.component_id, r.kept) for k, r in got.items()} == {k: (links[k], low[k], low[k] == k) for k in low}


def test_no_vectors(frame):
    assert embedding_forest.near_duplicate_vectors(frame([], "vec_id bigint, embedding array<float>, label int")).count() == 0


def grams(text):
    words = "".join(c.lower() if c.isalnum() else " " for c in text or "").split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def texts(seed, n=160):
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    out = []
    for _ in range(n):
        if out and draw.random() < 0.6:
            own = draw.choice(out).split()
            for _ in range(draw.randint(0, 4)):
                if own:
                    own[draw.randrange(len(own))] = draw.choice(words)
            out.append(" ".join(own))
        else:
            out.append(" ".join(draw.choice(words) for _ in range(draw.choice([2, 4, 5, 9, 60, 120, 121]))))
    return out


@pytest.mark.parametrize("block", [192, 8])
def test_jaccard_join(frame, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "COLUMNS", 64)
    rows = [*enumerate(texts(block)), (500, None), (501, ""), (502, " .,"), (503, "ONE, two"), (504, "one two!")]
    sets = {k: grams(t) for k, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    low = reach(pairs, sets)
    links = {k: sum(k in p for p in pairs) for k in sets}
    extra = [(k, t, k) for k, t in rows] + [(None, "one two", 1), (3, dict(rows)[3], 9)]
    got = jaccard_join.near_duplicates(frame(extra, "doc_id bigint, text string, n int")).collect()
    assert len(got) == len(sets) and (503, 504) in pairs
    for r in got:
        same = [k for k in sets if sets[k] == sets[r.doc_id]] if sets[r.doc_id] else [r.doc_id]
        assert (r.class_id, r.n_links, r.group_id, r.kept) == (min(same), links[r.doc_id], low[r.doc_id], low[r.doc_id] == r.doc_id)
    assert jaccard_join.near_duplicates(frame([], "doc_id bigint, text string")).count() == 0


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.9999), (0.5, 0.99), (0.9, 0.999)):
        bands, rows = jaccard_join.choose_bands(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall


def test_containment(frame):
    draw = random.Random(8)
    words = [f"v{k}" for k in range(300)]
    items = [(k, " ".join(draw.choice(words) for _ in range(draw.choice([1, 3, 5, 6, 9, 20, 40, 63, 64])))) for k in range(40)] + [(90, None), (91, ""), (92, "..."), (None, "a b c d e f")]
    docs = []
    for k in range(80):
        own = [draw.choice(words) for _ in range(draw.choice([0, 3, 50, 400]))]
        for _ in range(draw.randint(0, 2)):
            part = (draw.choice(items[:40])[1]).split()
            for _ in range(draw.randint(0, 2)):
                part[draw.randrange(len(part))] = draw.choice(words)
            at = draw.randint(0, len(own))
            own[at:at] = part
        docs.append((k, " ".join(own).upper(), 1))
    docs += [(200, None, 1), (None, docs[0][1], 1), (0, docs[0][1], 2), (201, items[0][1], 3)]
    want = {}
    for d, text, _ in docs:
        for i, body in items:
            a, b = grams(body), grams(text)
            if d is not None and i is not None and a and len(a & b) >= 0.8 * len(a) - 1e-12:
                want[d, i] = (len(a), len(a & b))
    got = containment.contained_items(frame(docs, "doc_id bigint, text string, item_id int"), frame(items, "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id): (r.n_shingles, r.n_found) for r in got} == want and len(got) == len(want) > 30
    empty = frame([], "doc_id bigint, text string")
    assert containment.contained_items(empty, frame(items, "item_id bigint, text string")).count() == 0
    assert containment.contained_items(frame([(1, "a b")], "doc_id bigint, text string"), frame([], "item_id bigint, text string")).count() == 0


def test_line_spread(frame):
    rows = []
    for k in range(60):
        body = [f"own line {k}", "everywhere" if k % 2 else " everywhere ", "", "rare" if k in (3, 4) else f"x{k}", "near" if k < 9 else "far" if k < 12 else "y"]
        rows.append((k, "\n".join(body), f"site{k % 20}" if k != 5 else None, 9))
    rows += [(100, None, "site1", 9), (101, "", "site1", 9), (None, "everywhere\nowned", "site2", 9), (102, "\n".join(["everywhere", "z"] * 5000), "site3", 9), (102, "\n".join(["everywhere", "z"] * 5000), "site3", 9)]
    places, first = {}, {}
    for k, text, site, _ in rows:
        for pos, line in enumerate((text or "").split("\n")):
            if line.strip(" "):
                places.setdefault(line.strip(" "), set()).update([site] if site else [])
                key = (-1 if k is None else k, pos)
                first[line.strip(" ")] = min(first.get(line.strip(" "), key), key)
    gone = {line for line, sites in places.items() if len(sites) >= 10}
    assert gone == {"everywhere", "y"}
    want = []
    for k, text, site, _ in rows:
        lines = (text or "").split("\n")
        kept = [x for pos, x in enumerate(lines) if x.strip(" ") not in gone or first[x.strip(" ")] == (-1 if k is None else k, pos)]
        want.append((-1 if k is None else k, None if text is None else "\n".join(kept), 0 if text is None else len(lines), len(lines) - len(kept)))
    got = line_spread.remove_spread_lines(frame(rows, "doc_id bigint, text string, source string, n_lines int"))
    assert got.columns == ["doc_id", "text", "source", "n_lines", "n_removed"]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()) == sorted(want, key=lambda x: (x[0], x[1] or "")) or sorted(map(str, want)) == sorted(str((-1 if r.doc_id is None else r.doc_id, r.text, r.n_lines, r.n_removed)) for r in got.collect())
    assert line_spread.remove_spread_lines(frame([], "doc_id bigint, text string, source string")).count() == 0


def test_line_spread_counts_near_the_threshold(frame):
    rows = [(k * 100 + s, f"line {k}", f"site{s}") for k in range(5, 16) for s in range(k)]
    got = line_spread.spread_lines(frame(rows, "doc_id bigint, text string, source string")).count()
    assert got == sum(k >= 10 for k in range(5, 16))
