"""Near-duplicate vectors by a forest of random-projection trees with spill overlap.

A tree splits the vectors of a label level by level: each level has a random direction, and the
split lies near the middle of the projections (a random quantile between 0.4 and 0.6, learned from a
bounded sample). A vector closer to a split than the spill width goes to both sides, so that
similar vectors seldom part; many trees make it unlikely that they part in all of them. The depth follows from the
number of vectors, so that leaves stay small. Within leaves all pairs are compared, in blocks of bounded
size; a pair that meets in several leaves counts in the first of them only. Links are united to components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from .compare import block_tasks, key_of, per_task, smallest_reached
from .components import components
from .words import small

COSINE = 0.98
TREES = 5
LEAF = 128
#: Spill on each side of a split, in standard deviations of the projected difference of a pair at the threshold.
SPILL = 0.8
SAMPLE = 20_000
BLOCK = 1024
SEED = 11


@dataclass
class Forest:
    """Directions by (dimension, tree, level), and split points and depth by (label, dimension)."""

    directions: dict[int, np.ndarray]
    splits: dict[tuple[int, int], np.ndarray]
    depths: dict[tuple[int, int], int]
    spill: dict[int, float]

    def leaves(self, label: int, vector: np.ndarray) -> list[int]:
        """The leaves of a unit vector: tree and path in one number."""
        group = (label, len(vector))
        if group not in self.depths:
            return [t << 48 | 1 for t in range(TREES)]
        offsets = self.directions[len(vector)] @ vector - self.splits[group]
        width, out = self.spill[len(vector)], []
        for tree in range(TREES):
            paths = [1]
            for level in range(self.depths[group]):
                offset = offsets[tree, level]
                sides = (0, 1) if abs(offset) <= width else (int(offset > 0),)
                paths = [p << 1 | s for p in paths for s in sides]
            out += [tree << 48 | p for p in paths]
        return out


def fit(vectors: DataFrame) -> Forest:
    """Learns depths from the counts of all vectors, and split points from a sample of SAMPLE vectors in all (smallest hashes)."""
    counts = {(r["label"], r["dim"]): r["n"] for r in vectors.groupBy("label", "dim").agg(F.count("*").alias("n")).collect()}
    depths = {g: max(0, math.ceil(math.log2(n / LEAF))) for g, n in counts.items() if n > LEAF}
    deepest = max(depths.values(), default=0)
    draw = np.random.default_rng(SEED)
    directions, spill = {}, {}
    for dim in sorted({g[1] for g in depths}):
        d = draw.normal(size=(TREES, deepest, dim))
        directions[dim] = d / np.linalg.norm(d, axis=2, keepdims=True)
        spill[dim] = SPILL * math.sqrt(2 - 2 * COSINE) / math.sqrt(dim)
    chosen = vectors.select("label", "dim", "rep").orderBy(F.xxhash64("rep")).limit(SAMPLE)
    rows = vectors.join(F.broadcast(chosen.select("rep")), "rep").select("label", "dim", "unit").collect()
    by_group: dict[tuple[int, int], list] = {}
    for r in rows:
        by_group.setdefault((r["label"], r["dim"]), []).append(r["unit"])
    splits = {}
    for group in depths:
        quantiles = draw.uniform(0.4, 0.6, (TREES, deepest))
        own = by_group.get(group)
        if own:
            projected = np.sort(directions[group[1]] @ np.array(own).T, axis=2)
            at = np.minimum((quantiles * projected.shape[2]).astype(int), projected.shape[2] - 1)
            splits[group] = np.take_along_axis(projected, at[:, :, None], 2)[:, :, 0]
        else:
            splits[group] = np.zeros((TREES, deepest))
    return Forest(directions, splits, depths, spill)


def _compare(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for task in per_task(batches):
            if len(task) < 2:
                continue
            unit = np.array(task["unit"].tolist(), np.float64)
            side, ids, weight = task["side"].to_numpy(), task["rep"].to_numpy(), task["weight"].to_numpy()
            leaf = task["leaf"].iat[0]
            alike = unit @ unit.T >= threshold
            alike &= side[:, None] != side[None, :] if side[0] >= 0 else ~np.eye(len(unit), dtype=bool)
            near = np.flatnonzero(alike.any(1))
            if not len(near):
                continue
            # leaves as bits: the first common leaf of two members must be this one
            alike = alike[np.ix_(near, near)]
            own = task["leaves"].to_numpy()[near]
            known = np.unique(np.concatenate(own))
            earlier = known[known < leaf]
            if len(earlier):
                member = np.zeros((len(near), len(earlier)), np.float32)
                for k, x in enumerate(own):
                    x = np.asarray(x)
                    member[k, np.searchsorted(earlier, x[x < leaf])] = 1
                alike &= (member @ member.T) == 0
            ids, weight = ids[near], weight[near]
            linked = np.flatnonzero(alike.any(1))
            if len(linked):
                yield pd.DataFrame({"rep": ids[linked], "low": smallest_reached(alike, ids)[linked], "n_links": (alike[linked] @ weight).astype(np.int64)})

    return run


def near_duplicate_vectors(
    vectors: DataFrame, threshold: float = COSINE, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label"
) -> DataFrame:
    """(id_column, n_links, component_id, kept), one row per vector.

    Vectors are compared if their labels are equal and not null and they have as many dimensions,
    by cosine in double precision. A null or empty vector, one of length zero, and one that holds a null or
    non-finite component link with nothing. ``n_links`` counts the other vectors at ``threshold`` or
    above (by different ids), ``component_id`` is the smallest id that links reach, itself included. Rows with
    the same id and vector and label count as one for links but keep their rows; rows with a null id have no links and
    a null component. Other columns are ignored. An empty table gives an empty result.
    """
    raw = vectors.select(F.col(id_column).alias("id"), F.col(label_column).alias("label"), F.col(vector_column).cast("array<double>").alias("v"))
    largest = F.aggregate("v", F.lit(0.0), lambda t, x: F.greatest(t, F.abs(x)))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite & (largest > 0)
    scaled = F.transform("v", lambda x: x / F.col("largest"))  # no square of a component can overflow or vanish
    good = raw.where(usable).withColumn("largest", largest).select("id", "label", scaled.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x))
    good = good.withColumn("norm", norm).select("id", "label", F.transform("v", lambda x: x / F.col("norm") + 0.0).alias("unit"))
    # equal vectors are compared once, whatever their number
    keyed = good.withColumn("k1", F.xxhash64("unit")).withColumn("k2", F.xxhash64(F.lit(5), F.col("unit")))
    reps = materialize(
        keyed.groupBy("label", "k1", "k2").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("weight"), F.first("unit").alias("unit"))
        .withColumn("dim", F.size("unit"))
    )
    forest = vectors.sparkSession.sparkContext.broadcast(fit(reps))  # bounded by labels x trees x levels
    key = vectors.schema[id_column].dataType.simpleString()
    label_type = vectors.schema[label_column].dataType.simpleString()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["leaves"] = [np.array(forest.value.leaves(a, np.asarray(v)), np.int64) for a, v in zip(batch["label"], batch["unit"])]
            yield batch[["label", "dim", "rep", "weight", "unit", "leaves"]]

    placed = reps.select("label", "dim", "rep", "weight", "unit").mapInPandas(place, f"label {label_type}, dim int, rep {key}, weight bigint, unit array<double>, leaves array<bigint>")
    placed = materialize(placed)
    entries = placed.select("label", "dim", "rep", F.explode("leaves").alias("leaf"))
    sizes = entries.groupBy("label", "dim", "leaf").agg(F.count("*").alias("members")).where("members > 1")
    tasks = block_tasks(entries, sizes, ["label", "dim", "leaf"], "rep", BLOCK)
    tasks = tasks.select(key_of(F.col("task")).alias("task_key"), "label", "rep", "leaf", "side")
    ready = tasks.join(placed.select("label", "rep", "weight", "unit", "leaves"), ["label", "rep"])
    n = max(8, math.ceil(sizes.agg(F.sum("members")).first()[0] or 0) // 20_000)
    ready = ready.repartition(n, "task_key").sortWithinPartitions("task_key").select("task_key", "rep", "leaf", "side", "weight", "unit", "leaves")
    found = materialize(ready.mapInPandas(_compare(threshold), f"rep {key}, low {key}, n_links bigint"))
    linked = components(found.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    links = found.groupBy("rep").agg(F.sum("n_links").alias("outside"))
    classes = reps.select("label", "k1", "k2", "rep", "weight").join(links, "rep", "left").join(linked.withColumnRenamed("node", "rep"), "rep", "left")
    member = keyed.select("id", "label", "k1", "k2").join(classes, ["label", "k1", "k2"])
    by_id = member.groupBy("id").agg(F.sum(F.coalesce("outside", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.min(F.coalesce("component", "rep")).alias("component_id"))
    component = F.coalesce(F.col("component_id"), F.col("id"))
    return raw.select("id").join(by_id, "id", "left").select(
        F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.cast("bigint").alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"),
    )
