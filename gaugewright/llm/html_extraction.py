"""Main text of web pages by a tree-structured graphical model.

The nodes are the elements of a page that have text below them, and its text blocks; each is
content or not. Every node has a potential from its features, every edge between parent and child
one for the two states. On a tree, one sum-product pass upward and one downward give the exact
marginals. The weights are learned from labelled pages by gradient ascent on the likelihood, which needs
just these marginals. They start from, and are drawn to, a prior that knows the usual names of page parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .html_tree import Page, parse
from .text import slices

#: Weights are fitted on this many labelled pages at most.
SAMPLE_PAGES = 400
STEPS, RATE, PENALTY = 60, 0.3, 0.02

#: Names by which pages call parts that are not, or are, their main text.
ASIDE_TAGS = "nav header footer aside form menu dialog fieldset".split()
ASIDE_NAMES = (
    "nav navbar navigation menu header footer sidebar side aside ad ads advert adverts advertisement banner sponsor sponsored promo promoted cookie cookies consent gdpr notice "
    "notification alert popup modal overlay comment comments reply replies discussion respond share sharing social related recommended recommendations more subscribe newsletter signup "
    "login search breadcrumb breadcrumbs pagination pager tags widget toolbar masthead copyright skip"
).split()
MAIN_TAGS = "article main".split()
MAIN_NAMES = "article content main post entry body story text".split()
PRIOR = {
    **{f"tag:{t}": -5.0 for t in ASIDE_TAGS}, **{f"name:{n}": -5.0 for n in ASIDE_NAMES}, **{f"tag:{t}": 2.0 for t in MAIN_TAGS}, **{f"name:{n}": 0.5 for n in MAIN_NAMES},
    "bias": 0.3, "block": 1.5, "links:4": -1.5, "links:3": -0.7,
}
#: Log potentials [parent][child]: content under a part that is none is rare.
EDGE_PRIOR = np.array([[0.0, -6.0], [0.0, 0.0]])


@dataclass
class Forest:
    """The trees of several pages in one: parents come before children."""

    parents: np.ndarray
    depths: np.ndarray
    features: np.ndarray
    owners: np.ndarray
    blocks: list[np.ndarray]


def _bucket(n: int) -> int:
    return min(12, max(0, n).bit_length())


def node_features(page: Page) -> tuple[list[int], list[list[str]], list[int]]:
    """Parents, features and the numbers of the blocks' nodes, for the elements with text below and the blocks."""
    n = len(page.tags)
    chars, linked = [0] * n, [0] * n
    for element, text, in_links in page.blocks:
        chars[element] += len(text)
        linked[element] += min(in_links, len(text))
    for k in range(n - 1, 0, -1):
        chars[page.parents[k]] += chars[k]
        linked[page.parents[k]] += linked[k]
    number, parents, features = {}, [], []
    for k in range(n):
        if chars[k]:
            number[k] = len(parents)
            parents.append(number[page.parents[k]] if k else -1)
            features.append(["bias", f"tag:{page.tags[k]}", f"size:{_bucket(chars[k])}", f"links:{4 * linked[k] // chars[k]}", *{f"name:{w}" for w in page.names[k]}])
    of_blocks = []
    for element, text, in_links in page.blocks:
        of_blocks.append(len(parents))
        parents.append(number[element])
        words = text.count(" ") + 1
        features.append(["block", f"block:{page.tags[element]}", f"words:{_bucket(words)}", f"blocklinks:{4 * min(in_links, len(text)) // len(text)}", f"end:{text[-1] in '.!?:;'}"])
    return parents, features, of_blocks


def build(pages: list[Page], vocabulary: dict[str, int], learn: bool = False) -> Forest:
    parents: list[int] = []
    depths: list[int] = []
    flat: list[int] = []
    owners: list[int] = []
    blocks = []
    for page in pages:
        start = len(parents)
        own, features, of_blocks = node_features(page)
        for k, p in enumerate(own):
            parents.append(start + p if p >= 0 else -1)
            depths.append(depths[start + p] + 1 if p >= 0 else 0)
            for f in features[k]:
                at = vocabulary.setdefault(f, len(vocabulary)) if learn else vocabulary.get(f, -1)
                if at >= 0:
                    flat.append(at)
                    owners.append(start + k)
        blocks.append(np.array(of_blocks, np.int64) + start)
    return Forest(np.array(parents, np.int64), np.array(depths, np.int64), np.array(flat, np.int64), np.array(owners, np.int64), blocks)


@dataclass
class ContentModel:
    """Feature weights (for the state content) and edge potentials."""

    vocabulary: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    edges: np.ndarray = field(default_factory=lambda: EDGE_PRIOR.copy())

    def sum_product(self, forest: Forest) -> tuple[np.ndarray, np.ndarray]:
        """The marginal of content per node, and per node the joint marginals [parent state, own state] (roots: zeros)."""
        n = len(forest.parents)
        own = np.zeros((n, 2))
        if n:
            own[:, 1] = np.bincount(forest.owners, self.weights[forest.features], n)
        by_depth = np.argsort(forest.depths, kind="stable")
        cuts = np.searchsorted(forest.depths[by_depth], np.arange(forest.depths.max(initial=0) + 2))
        levels = [by_depth[a:b] for a, b in zip(cuts, cuts[1:])]
        up, message = own.copy(), np.zeros((n, 2))
        for level in reversed(levels[1:]):
            message[level] = np.logaddexp(self.edges[None, :, 0] + up[level, 0:1], self.edges[None, :, 1] + up[level, 1:2])
            np.add.at(up, forest.parents[level], message[level])
        full, joint = up.copy(), np.zeros((n, 2, 2))
        for level in levels[1:]:
            parents = forest.parents[level]
            without = full[parents] - message[level]
            without -= without.max(1, keepdims=True)
            both = without[:, :, None] + self.edges[None] + up[level][:, None, :]
            both -= both.max((1, 2), keepdims=True)
            both = np.exp(both)
            joint[level] = both / both.sum((1, 2), keepdims=True)
            full[level] = up[level] + np.logaddexp(without[:, 0:1] + self.edges[0], without[:, 1:2] + self.edges[1])
        return 1 / (1 + np.exp(np.clip(full[:, 0] - full[:, 1], -500, 500))), joint

    def extract(self, sources: list[str | None]) -> list[str]:
        pages = [parse(s or "") for s in sources]
        forest = build(pages, self.vocabulary)
        content = self.sum_product(forest)[0] >= 0.5 if len(forest.parents) else np.zeros(0, bool)
        return ["\n".join(text for (_, text, _), node in zip(page.blocks, nodes) if content[node]) for page, nodes in zip(pages, forest.blocks)]


def _plain(text: str) -> str:
    return " ".join(text.split())


def block_labels(page: Page, article: str) -> np.ndarray:
    """Whether each block stands in the article: as a line of it, as its beginning, or as a long part."""
    lines, whole = {_plain(x) for x in article.split("\n")}, _plain(article)
    return np.array([t in lines or (len(t) >= 20 and whole.startswith(t)) or (len(t) >= 40 and t in whole) for _, t, _ in page.blocks], bool)


def fit(sample: list[tuple[str, str]]) -> ContentModel:
    """Learns from pages and their articles. Pages of which less than a fifth of the text is found in the article are left out; without pages the prior stands."""
    model = ContentModel({f: k for k, f in enumerate(PRIOR)})
    pages, truths = [], []
    for source, article in sample:
        page = parse(source)
        labels = block_labels(page, article)
        chars = np.array([len(t) for _, t, _ in page.blocks])
        if labels.any() and chars[labels].sum() >= 0.2 * chars.sum():
            pages.append(page)
            truths.append(labels)
    forest = build(pages, model.vocabulary, learn=True)
    model.weights = prior = np.zeros(len(model.vocabulary))
    for f, w in PRIOR.items():
        prior[model.vocabulary[f]] = w
    if not pages:
        return model
    # an element is content if at least half of the text below it is
    n = len(forest.parents)
    inside, total = np.zeros(n), np.zeros(n)
    for page, nodes, labels in zip(pages, forest.blocks, truths):
        sizes = np.array([len(t) for _, t, _ in page.blocks])
        inside[nodes], total[nodes] = sizes * labels, sizes
    for level in range(int(forest.depths.max()), 0, -1):
        nodes = np.flatnonzero(forest.depths == level)
        np.add.at(inside, forest.parents[nodes], inside[nodes])
        np.add.at(total, forest.parents[nodes], total[nodes])
    state = (inside * 2 >= total).astype(np.int64)
    child = np.flatnonzero(forest.parents >= 0)
    seen = np.zeros((2, 2))
    np.add.at(seen, (state[forest.parents[child]], state[child]), 1)
    weights, squares, edge_squares = prior.copy(), np.full(len(prior), 1e-6), np.full((2, 2), 1e-6)
    for _ in range(STEPS):
        model.weights = weights
        marginal, joint = model.sum_product(forest)
        slope = np.bincount(forest.features, (state - marginal)[forest.owners], len(weights)) / len(pages) - PENALTY * (weights - prior)
        edge_slope = (seen - joint.sum(0)) / len(pages) - PENALTY * (model.edges - EDGE_PRIOR)
        squares += slope**2
        edge_squares += edge_slope**2
        weights = weights + RATE * slope / np.sqrt(squares)
        model.edges = model.edges + RATE * edge_slope / np.sqrt(edge_squares)
    model.weights = weights
    return model


def train(pages: DataFrame, articles: DataFrame, page_column: str = "html", link: str = "article_id", id_column: str = "article_id", text_column: str = "text") -> ContentModel:
    """Learns from a bounded sample of ``pages`` (page_column, link) whose article is among ``articles`` (id_column, text_column).

    The sample is the SAMPLE_PAGES pages with the smallest hash of their html and a link that is not null.
    """
    linked = pages.where(F.col(page_column).isNotNull() & F.col(link).isNotNull()).select(F.col(link).alias("link"), F.xxhash64(page_column).alias("hash"))
    chosen = F.broadcast(linked.orderBy("hash", "link").limit(SAMPLE_PAGES).distinct())
    sources = pages.select(F.col(link).alias("link"), F.col(page_column).alias("html")).withColumn("hash", F.xxhash64("html")).join(chosen, ["link", "hash"], "left_semi")
    texts = articles.select(F.col(id_column).alias("link"), F.col(text_column).alias("text")).join(chosen, "link", "left_semi")
    rows = sources.join(texts, "link").orderBy("hash", "link").limit(SAMPLE_PAGES).collect()
    return fit([(r["html"], r["text"] or "") for r in rows])


def extract(pages: DataFrame, model: ContentModel, html_column: str = "html") -> DataFrame:
    """``pages`` without the html, with ``text`` and ``n_chars``.

    ``text`` holds the blocks whose marginal is 0.5 or more, in page order, one per line; white space
    inside a block is one space. A null or empty page, and one without content, has an empty text.
    Columns named ``text`` or ``n_chars`` are replaced; other columns, nulls and repeated rows are
    carried along. An empty table gives an empty table.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)
    plain = pages.select(*[c for c in pages.columns if c not in ("text", "n_chars") and c != html_column], F.col(html_column).cast("string").alias(html_column))
    names = plain.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            texts = shared.value.extract(batch.column(len(names)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*names, "text"])

    schema = StructType([*plain.schema.fields[:-1], StructField("text", StringType())])
    return plain.mapInArrow(run, schema).withColumn("n_chars", F.char_length("text").cast("bigint"))
