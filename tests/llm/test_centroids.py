"""Centroid clustering against plain clustering."""

import hashlib
import random

import numpy as np
import pytest

from gaugewright.llm import centroid_search
from gaugewright.llm.queries import op11


def plain(rows, k, rounds, seed=2, scale=256):
    """Every vector against every centroid, in whole numbers."""
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows]
    named = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centroids = [list(v) for _, v in named[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            members = [v for (_, v), o in zip(kept, own) if o == j]
            if members:
                centroids[j] = [sum(x) // len(members) for x in zip(*members)]
    return sorted((i is not None, i or 0, *reversed(nearest(v))) for i, v in kept), centroids


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_plain_clustering(frame, seed):
    draw = random.Random(seed)
    rows = [(i, [float(np.float32(draw.gauss(i % 7, 0.6))) for _ in range(8)]) for i in range(300)] + [(None, [0.5] * 8)] * 2 + [(5, [1.0] * 8)]
    found = centroid_search.cluster(frame(rows, "vec_id bigint, embedding array<float>"), k=12, rounds=3, dimensions=8)
    want, centroids = plain(rows, 12, 3)
    assert sorted((r.vec_id is not None, r.vec_id or 0, r.cluster, r.distance) for r in found.assigned.collect()) == want
    assert found.centroids.tolist() == centroids == [r.centroid for r in found.table().orderBy("cluster").collect()]


def test_search_is_exact_and_rules_centroids_out():
    draw = np.random.default_rng(4)
    for d, most in ((64, 300), (3, 2), (64, centroid_search.MOST - 1), (1, 5)):
        centroids, vectors = (draw.integers(-most, most + 1, (n, d)) for n in (40, 500))
        vectors[:40] = centroids
        centroids[7] = centroids[3]
        found, best, measured = centroid_search.Search.over(centroids).nearest(vectors)
        plainly = ((vectors[:, None].astype(object) - centroids[None].astype(object)) ** 2).sum(2)
        assert best.tolist() == plainly.min(1).tolist() and found.tolist() == plainly.argmin(1).tolist()
    blobs = draw.normal(0, 400, (40, 1)) + draw.normal(0, 30, (40, 64))
    near = blobs[draw.integers(0, 40, 2000)] + draw.normal(0, 10, (2000, 64))
    _, _, measured = centroid_search.Search.over(blobs.astype(np.int64)).nearest(near.astype(np.int64))
    assert measured < 0.2 * 2000 * 40


def test_what_is_left_out_and_edges(frame):
    good = [0.1] * 64
    rows = [(1, good, 7), (1, good, 7), (2, None, 7), (3, good[:-1], 7), (4, [*good[:-1], None], 7), (5, [*good[:-1], float("nan")], 7), (6, [*good[:-1], float("inf")], 7), (None, good, 7)]
    found = centroid_search.cluster(frame(rows, "vec_id bigint, embedding array<double>, cluster int"))
    assert sorted((r.vec_id or 0, r.cluster, r.distance) for r in centroid_search.with_inertia(found).collect()) == [(0, 0, 0), (1, 0, 0), (1, 0, 0)]
    empty = centroid_search.cluster(frame([], "vec_id bigint, embedding array<float>"))
    assert centroid_search.with_inertia(empty).count() == 0 and empty.table().count() == 0
    with pytest.raises(Exception, match="64-bit"):
        centroid_search.cluster(frame([(1, [1e30] * 64)], "vec_id bigint, embedding array<double>")).assigned.collect()


def test_query_names_its_columns(spark, folder):
    assert op11(spark, folder).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
