"""Held-out accuracy and plain re-computation of the trained operators, and their edge cases."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugewright.llm import html_extraction, html_tree, interpolated_lm, language_id, toxicity
from gaugewright.llm.queries import op4, op5, op6, op7
from gaugewright.llm.text import fold

SMALL = "/root/testdata/sf0.01"


def test_fold(frame):
    import zlib

    rows = frame([(k,) for k in range(50)] + [(None,)], "doc_id bigint").select("doc_id", fold("doc_id", 7).alias("f")).collect()
    assert all(r.f == (0 if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % 7) for r in rows)


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    found = op5(spark, SMALL).join(docs, "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.97 * len(found) and all(0 <= r.score <= 1 for r in found)


def test_language_edges(frame):
    docs = frame([(1, "der hund und die katze " * 20, "de"), (2, "the dog and the cat " * 20, "en"), (3, None, "fr"), (4, "x", None)], "id int, text string, lang string")
    model = language_id.train(docs)
    assert model.languages == ["de", "en"]
    asked = frame([(1, None, "a", 1.0), (2, "", "a", 1.0), (3, "123 !?", "a", 1.0), (4, "der hund", "a", 1.0), (5, "THE dog", "a", 1.0), (6, "the cat " * 30_000, "a", 1.0)], "id int, text string, lang_pred string, score double")
    got = {r.id: (r.lang_pred, r.score) for r in language_id.identify(asked, model).collect()}
    assert [got[k][0] for k in range(1, 7)] == ["und", "und", "und", "de", "en", "en"] and got[1][1] == 0
    nothing = language_id.train(docs.limit(0))
    assert language_id.identify(asked, nothing).select("lang_pred").distinct().collect() == [("und",)]
    assert language_id.identify(asked.limit(0), model).count() == 0


def test_filter_returns_all_languages_of_a_gram(frame):
    docs = frame([(1, "hallo welt", "de"), (2, "hallo mundo", "es")], "id int, text string, lang string")
    model = language_id.train(docs)
    hashes, _, _ = language_id.grams(["hallo"], model.order)
    assert (model.lookup(hashes) == 3).sum() >= 3


def test_an_ngram_of_twelve_languages_is_in_all(frame):
    own = ["zug", "pfad", "moth", "quiz", "vlak", "bryn", "kjos", "wxyz", "gnu", "fjord", "lodz", "cwm"]
    docs = frame([(k, "shared word " + f"{w} " * 3, f"l{k:02}") for k, w in enumerate(own)], "id int, text string, lang string")
    model = language_id.train(docs)
    hashes, _, _ = language_id.grams(["shared"], model.order)
    assert len(model.languages) == 12 and (model.lookup(hashes) == (1 << 12) - 1).sum() >= 4
    asked = frame([(k, f"{w} {w}") for k, w in enumerate(own)], "id int, text string")
    assert {r.id: r.lang_pred for r in language_id.identify(asked, model).collect()} == {k: f"l{k:02}" for k in range(12)}


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = op4(spark, folder).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r.score for r in rows if r.toxic == 0], [r.score for r in rows if r.toxic == 1]
    assert np.mean([b > g for b in bad for g in good]) >= 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_toxicity_edges(frame):
    rows = [(k, "you idiot fool" if k % 2 else "what a lovely day", k % 2) for k in range(60)] + [(None, None, 1), (70, "", 0), (71, "x", None)]
    model = toxicity.train(frame(rows, "doc_id bigint, text string, toxic int"))
    asked = frame([(1, None, 1), (2, "", 2), (3, "idiot " * 30_000, 3), (4, "a lovely day", 4), (4, "a lovely day", 4)], "doc_id bigint, text string, score int")
    got = sorted((r.doc_id, r.predicted) for r in toxicity.score(asked, model).collect())
    assert got[2:] == [(3, 1), (4, 0), (4, 0)] and len(got) == 5
    empty = toxicity.train(frame([], "doc_id bigint, text string, toxic int"))
    assert [r.score for r in toxicity.score(asked, empty).collect()] == [0.5] * 5
    assert toxicity.score(asked.limit(0), model).count() == 0


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return low.encode().split() + ["END"]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_model_scores_by_hand(spark, frame, monkeypatch, order):
    monkeypatch.setattr(interpolated_lm, "BLOCK_TOKENS", 300)
    texts = ["the cat sat on the mat", "The cat ran\tfar", "", None, "a b c d " * 40, "x", "the dog\x0bsat"] * 6
    rows = [(k, t, k % 5 != 0, 1.0) for k, t in enumerate(texts)]
    docs = frame(rows, "doc_id bigint, text string, learns boolean, score double")
    got = {r.doc_id: r for r in interpolated_lm.score(docs, F.col("learns"), order).collect()}
    counts = Counter(w for _, t, learns, _ in rows if learns for w in words_of(t))
    n, v = sum(counts.values()), len(counts)
    for k, t, _, _ in rows:
        own = words_of(t)
        assert (got[k].n_tokens, got[k].n_known, got[k].train_tokens) == (len(own), sum(counts[w] > 0 for w in own), n)
        assert got[k].base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own))
        assert -1000 < got[k].score < 0
    assert interpolated_lm.score(docs.limit(0), F.col("learns")).count() == 0
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in interpolated_lm.score(docs, F.lit(None).cast("boolean")).collect())


def test_trigram_scores_do_not_depend_on_the_blocks(spark, monkeypatch):
    """The query's model reads two words of context, and an n-gram's count is the same in whatever blocks it stands."""
    import random

    draw = random.Random(3)
    docs = [(k, " ".join(draw.choices("abcdefghijkl", k=draw.randint(1, 60))), k % 7 != 2) for k in range(400)]
    docs += [(k + 400, "x y z y x z " * 5, k % 3 == 0) for k in range(30)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, learns boolean")
    by_size = {}
    for size, parts in ((200, 5), (10**9, 1)):
        monkeypatch.setattr(interpolated_lm, "BLOCK_TOKENS", size)
        by_size[size] = {r.doc_id: r for r in interpolated_lm.score(frame.repartition(parts), F.col("learns")).collect()}
    bigrams = {r.doc_id: r.score for r in interpolated_lm.score(frame, F.col("learns"), 2).collect()}
    few, one = by_size[200], by_size[10**9]
    assert len(few) == len(one) == 430
    assert all(few[k].score == pytest.approx(one[k].score) and few[k].n_known == one[k].n_known for k in one)
    # y after z is certain only by the word before z
    assert sum(one[k].score for k in range(400, 430)) > sum(bigrams[k] for k in range(400, 430)) + 10


def test_sorted_numbers_come_back():
    draw = np.random.default_rng(5)
    for most, n in ((1, 1), (1 << 20, 1000), (50, 400), (1 << 63, 7), (1 << 40, 1)):
        values = np.sort(draw.integers(0, most, n, dtype=np.uint64))
        assert interpolated_lm.unpack_sorted(interpolated_lm.pack_sorted(values)).tolist() == values.tolist()


def test_ngrams_are_sorted_not_hashed(monkeypatch):
    """op6: ``np.unique`` over the n-grams of a block took most of the time."""
    draw = np.random.default_rng(5)
    hashes = draw.integers(0, 1 << 64, 500, dtype=np.uint64, endpoint=False)
    same_start = np.array([7, 3, 7, 1, 0, 3, 2**64 - 1, 6, 7], np.uint64)
    for values in (hashes[draw.integers(0, 500, 4000)], same_start, same_start[:1], same_start[:0]):
        known, places = np.unique(values, return_inverse=True)
        assert interpolated_lm.distinct(values).tolist() == known.tolist()
        assert [x.tolist() for x in interpolated_lm.numbered(values)] == [known.tolist(), places.tolist()]
    monkeypatch.setattr(np, "unique", None)
    tokens, sizes = interpolated_lm.token_hashes(["a b a c", "a b"])
    r = interpolated_lm.request(tokens, sizes, 2, 4, np.array([True] * 5 + [False] * 3))
    assert r.counts[r.places[0]].tolist() == [2, 1, 2, 1, 1, 2, 1, 1] and (r.hashes[r.places[0]] == tokens).all()


def test_model_is_a_distribution():
    """The mixture over all tokens and the unknown sums to 1, for every history."""
    texts = ["a b a c", "a b", "b a b c c"]
    tokens, sizes = interpolated_lm.token_hashes(texts)
    order, v = 3, len(set(tokens.tolist()))
    weights = interpolated_lm.Weights(len(tokens), v, [np.full(interpolated_lm.BUCKETS, x) for x in (0.9, 0.6, 0.4)])
    for share in weights.by_order[1:]:
        share[0] = 0
    own = interpolated_lm.request(tokens, sizes, order, 4, np.ones(len(tokens), bool))
    table = dict(zip(own.hashes.tolist(), own.counts.tolist()))
    for history in ([], ["a"], ["a", "b"], ["z"], ["c", "z"]):
        total = 0.0
        for word in ["a", "b", "c", None, "zz"]:
            text = " ".join(history + ([word] if word else []))
            t, s = interpolated_lm.token_hashes([text])
            r = interpolated_lm.request(t, s, order, 4, np.ones(len(t), bool))
            counts = np.array([table.get(h, 0) for h in r.hashes.tolist()], float)
            if interpolated_lm.END not in r.hashes:
                raise AssertionError
            e, b = interpolated_lm._estimates(r, counts, order, weights.tokens, t, s)
            total += interpolated_lm._mixed(e, b, weights, order)[len(history)]
        assert total == pytest.approx(1.0)


def test_model_beats_the_base_on_held_out_text(spark):
    rows = op6(spark, SMALL).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]


def test_em_finds_the_mixing_weight():
    cells = [(3, 1.0, 700), (3, -30.0, 300)]
    assert interpolated_lm.learn_weights(cells)[3] == pytest.approx((0.7 * 10 - 1) / 9, abs=1e-2)


def test_buckets_without_held_out_tokens_have_a_weight():
    weights = interpolated_lm.learn_weights([(0, 1.0, 5), (3, 1.0, 700), (3, -30.0, 300), (6, 0.5, 10), (6, -30.0, 90)])
    assert weights[0] == 0 and weights[1] == weights[2] == weights[3] == weights[4] == weights[5] > weights[6] == weights[39] > 0
    assert interpolated_lm.learn_weights([])[1:].tolist() == [interpolated_lm.PRIOR] * (interpolated_lm.BUCKETS - 1)


def test_scores_without_held_out_rows_are_the_mixture(frame):
    texts = ["the cat sat on the mat", "the cat ran", "a cat sat on a mat", ""]
    got = sorted(r.score for r in interpolated_lm.score(frame([(None, t) for t in texts], "doc_id bigint, text string"), F.lit(True)).collect())
    counts = Counter()
    for t in texts:
        own = ["BEGIN", *words_of(t)]
        counts.update(tuple(own[a:b]) for a in range(len(own)) for b in range(a + 1, min(a + 3, len(own)) + 1))
    n, v = sum(len(words_of(t)) for t in texts), len({w for t in texts for w in words_of(t)})
    want = []
    for t in texts:
        own, total = ["BEGIN", *words_of(t)], 0.0
        for k in range(1, len(own)):
            p = 1 / (v + 1)
            p = 0.5 * counts[(own[k],)] / n + 0.5 * p
            for size in (1, 2):
                if k >= size:
                    p = 0.5 * counts[tuple(own[k - size : k + 1])] / counts[tuple(own[k - size : k])] + 0.5 * p
            total += math.log10(p)
        want.append(total)
    assert got == pytest.approx(sorted(want))


def brute_marginals(model, forest):
    n = len(forest.parents)
    own = np.bincount(forest.owners, model.weights[forest.features], n)
    total, hits = 0.0, np.zeros(n)
    for code in range(1 << n):
        state = [(code >> k) & 1 for k in range(n)]
        z = math.exp(sum(own[k] * state[k] for k in range(n)) + sum(model.edges[state[p], state[k]] for k, p in enumerate(forest.parents) if p >= 0))
        total += z
        hits += z * np.array(state)
    return hits / total


def test_sum_product_is_exact():
    model = html_extraction.fit([])
    pages = [html_tree.parse("<div class=ad>x<p>y <a href=q>z</a></div><article><p>Some words.<p>More.</article>"), html_tree.parse("<p>a")]
    forest = html_extraction.build(pages, model.vocabulary)
    assert np.allclose(model.sum_product(forest)[0], brute_marginals(model, forest))


@pytest.mark.parametrize(
    "source,blocks",
    [
        ("", []), ("a &lt; b &amp;amp; c&nbsp;d", ["a < b &amp; c d"]), ("<p>one<p>two<br>three", ["one", "two three"]), ("<p><b>a<br><p>b</p>c", ["a", "b", "c"]),
        ("<script>if (a</p>) '<p>x</p>'</script>y<style>p{}</style>", ["y"]), ("x<!-- <p>no</p> -->y", ["xy"]), ("cut <p off", ["cut"]), ("a<p title='>'>b", ["a", "b"]),
        ("<ul><li>1<li>2<ul><li>3</ul><li>4</ul>", ["1", "2", "3", "4"]), ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]), ("1 < 2 and <3", ["1 < 2 and <3"]),
    ],
)
def test_parser(source, blocks):
    assert [t for _, t, _ in html_tree.parse(source).blocks] == blocks


def test_pages(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = op7(spark, SMALL).collect()
    import re

    right = judged = 0
    for r in rows:
        found = re.match(r"[a-z]+://[^/]+/[a-z]+/(\d+)", r.url)
        if found and int(found[1]) in docs:
            judged += 1
            want = {" ".join(x.split()) for x in docs[int(found[1])].split("\n")}
            lines = r.text.split("\n")
            right += sum(x in want for x in lines) >= 0.6 * len(lines) - 1 and "example" not in r.text
        assert r.n_chars == len(r.text)
    assert judged > 100 and right >= 0.9 * judged


def test_parts_that_are_no_main_text(spark):
    model = html_extraction.fit([])
    source = (
        "<header><h1>Site</h1></header><nav><a href=/>Home</a></nav><div class='cookie-notice'>We use cookies.</div><main><article><h1>Title</h1><p>First &eacute;   paragraph of the story, with text.</p>"
        "<form><input>Sign up<button>Go</button></form><p>Second paragraph of the story.</p></article></main><aside>Related things</aside>"
        "<div id=comments><p>I disagree with all of this.</p></div><footer>Copyright</footer>"
    )
    assert model.extract([source, None, ""]) == ["Title\nFirst é paragraph of the story, with text.\nSecond paragraph of the story.", "", ""]


def test_page_edges(frame):
    model = html_extraction.fit([])
    rows = [(1, None, "t"), (2, "", "t"), (3, "<p>x" * 20_000, "t"), (3, "<p>x", "t"), (None, "<div>" * 3000 + "deep", "t")]
    out = html_extraction.extract(frame(rows, "page_id bigint, html string, text string"), model)
    got = {(r.page_id, r.n_chars) for r in out.collect()}
    assert out.columns == ["page_id", "text", "n_chars"] and {(1, 0), (2, 0)} <= got and out.count() == 5
    assert html_extraction.extract(frame([], "page_id bigint, html string"), model).count() == 0
