"""Near duplicates by n-gram Jaccard similarity: MinHash bands, a shuffle on band hashes, and exact checks.

1. Every document's set of word n-grams is hashed; documents with equal sets are a class.
2. Classes get MinHash signatures. The number of bands and of rows in a band follows from the
   threshold and the recall asked for. Classes that share a band are candidates of each other.
3. Candidates that hang together form a group. The full sets of a group's classes meet once, in
   blocks of bounded size, and every pair of classes of like size is verified exactly.
4. A class's links are the documents of the classes it is similar to, and its fellow members.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from .compare import block_tasks, key_of, per_task, smallest_reached
from .components import components
from .text import mix, slices
from .words import SHINGLE, shingle_hashes, small, words

THRESHOLD, RECALL = 0.8, 0.9999
MOST_HASHES = 160
BLOCK = 192
COLUMNS = 2048


def choose_bands(threshold: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows per band, so the fewest false candidates, that find a pair at the threshold with the recall asked for within ``most`` hashes."""
    best = (max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold))), 1)
    for rows in range(2, 33):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def band_hashes(grams: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Per set (grams[starts[k]:starts[k+1]], none empty) the hashes of its bands."""
    multipliers = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    base = mix(grams)
    out = np.zeros((len(starts), bands), np.uint64)
    for k, m in enumerate(multipliers):
        low = np.minimum.reduceat((base * m) >> np.uint64(16), starts)
        band = k // rows
        out[:, band] = mix(out[:, band] * np.uint64(31) + low + np.uint64(k + 1))
    return out.view(np.int64)


def _gram_sets(docs: DataFrame, size: int) -> DataFrame:
    """(id, version, grams) of (id, text)."""
    return docs.select("id", F.xxhash64("text").alias("version"), words(F.col("text")).alias("found")).select("id", "version", shingle_hashes(F.col("found"), size).alias("grams"))


def signatures(docs: DataFrame, size: int, bands: int, rows: int, id_column: str, text_column: str) -> DataFrame:
    """(id, version, n, k1, k2, bands): per row the hash of its text, the number of its n-grams, two hashes of the set, and its bands."""
    key = docs.schema[id_column].dataType.simpleString()
    sets = _gram_sets(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")), size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            lists = batch.column(2)
            flat, offsets = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
            offsets = offsets - offsets[0]
            owner = np.repeat(np.arange(len(lists)), np.diff(offsets))
            order = np.lexsort((flat, owner))
            flat, owner = flat[order], owner[order]
            first = np.ones(len(flat), bool)
            first[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
            flat, owner = flat[first], owner[first]
            counts = np.bincount(owner, minlength=len(lists))
            full = np.flatnonzero(counts)
            found = np.zeros((len(lists), bands), np.int64)
            keys = np.zeros((2, len(lists)), np.int64)
            if len(full):
                starts = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
                found[full] = band_hashes(flat, starts, bands, rows)
                for k in range(2):
                    keys[k, full] = np.add.reduceat(mix(flat ^ np.uint64(0xA5A5A5A5 + k)), starts).view(np.int64)
            empty = counts == 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(keys[0], mask=empty), pa.array(keys[1], mask=empty),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1) * bands, pa.int32()), pa.array(found.ravel())),
                ],
                names=["id", "version", "n", "k1", "k2", "bands"],
            )

    return sets.mapInArrow(run, f"id {key}, version bigint, n bigint, k1 bigint, k2 bigint, bands array<bigint>")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets share; each set is sorted and has no element twice."""
    n = len(sets)
    both = np.zeros((n, n), np.float32)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    column = np.cumsum(np.concatenate([[0], (flat[1:] != flat[:-1]).astype(np.int64)]))
    many = np.diff(np.concatenate([starts, [len(flat)]])) > 1
    chosen = many[column]
    column, owner = (np.cumsum(many) - 1)[column[chosen]], owner[chosen]
    width = int(many.sum())
    for a in range(0, width, COLUMNS):
        lo, hi = np.searchsorted(column, [a, a + COLUMNS])
        part = np.zeros((n, min(COLUMNS, width - a)), np.float32)
        part[owner[lo:hi], column[lo:hi] - a] = 1
        both += part @ part.T
    return both


def _verify(threshold: float, key: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for task in per_task(batches):
            if len(task) < 2:
                continue
            sets = [np.unique(np.asarray(x).view(np.uint64)) for x in task["grams"]]
            counts, side, weight = np.array([len(s) for s in sets], np.float64), task["side"].to_numpy(), task["weight"].to_numpy()
            ids = task["id"].to_numpy()
            shared = shared_counts(sets).astype(np.float64)
            alike = shared >= threshold * (counts[:, None] + counts[None, :] - shared) - 1e-9
            np.fill_diagonal(alike, False)
            if side[0] >= 0:
                alike &= side[:, None] != side[None, :]
            upper = task["offset"].to_numpy() == 1  # two classes of one bin are compared in the cell of that bin only
            alike &= ~(upper[:, None] & upper[None, :])
            linked = np.flatnonzero(alike.any(1))
            if len(linked):
                yield pd.DataFrame({"id": ids[linked], "low": smallest_reached(alike, ids)[linked], "n_links": (alike[linked] @ weight).astype(np.int64)})

    return run


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, recall: float = RECALL, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id_column, class_id, n_links, group_id, kept), a row per document.

    ``class_id`` is the smallest id with the same n-gram set, ``n_links`` the number of other
    documents with a Jaccard similarity of at least ``threshold``, ``group_id`` the smallest id
    that links reach, and ``kept`` whether that is the document itself. A text of fewer than
    ``size`` words has one n-gram, all its words. Null, empty and wordless texts link with nothing.
    Rows with the same id are one document and give one row; of different texts the one with the
    smallest hash counts. Rows with a null id are left out. Other columns are ignored. An empty table gives an empty result. A pair at the threshold is
    a candidate with probability ``recall`` at least; similarity above it makes that more likely.
    """
    bands, rows = choose_bands(threshold, recall)
    named = docs.where(F.col(id_column).isNotNull())
    key = named.schema[id_column].dataType.simpleString()
    signed = signatures(named, size, bands, rows, id_column, text_column)
    one = signed.groupBy("id").agg(F.min_by(F.struct("version", "n", "k1", "k2", "bands"), "version").alias("s"))
    found = materialize(one.select("id", "s.*"))
    own = F.when(F.col("n") == 0, F.col("id"))  # documents without n-grams are classes of their own
    keyed = found.select("id", "version", "n", "k1", "k2", "bands", own.alias("alone"))
    classes = materialize(
        keyed.where("alone is null").groupBy("n", "k1", "k2").agg(F.min(F.struct("id", "version")).alias("first"), F.count("*").alias("weight"), F.first("bands").alias("bands"))
        .select("n", "k1", "k2", F.col("first.id").alias("class_id"), F.col("first.version").alias("version"), "weight", "bands")
    )
    entries = classes.select("class_id", F.posexplode("bands").alias("band", "hash"))
    buckets = entries.groupBy("band", "hash").agg(F.min("class_id").alias("low"), F.count("*").alias("members")).where("members > 1")
    edges = entries.join(buckets, ["band", "hash"]).where(F.col("class_id") != F.col("low")).select(F.col("low").alias("a"), F.col("class_id").alias("b"))
    groups = materialize(components(edges).join(classes.select(F.col("class_id").alias("node"), "version", "n", "weight"), "node"))
    # similar sets differ in size by 1 / threshold at most: classes are binned by size, and a bin meets itself and the next
    step = math.log(1 / threshold)
    binned = groups.select(F.col("node").alias("id"), F.col("component").alias("group"), "weight", F.floor(F.log(F.col("n").cast("double")) / step + 1e-9).cast("int").alias("bin"))
    totals = binned.groupBy("group").agg(F.count("*").alias("total"))
    binned = binned.join(totals, "group")
    whole = binned.where(F.col("total") <= BLOCK).select("id", "group", "weight", F.lit(0).alias("bin"), F.lit(0).alias("with"))
    cut = binned.where(F.col("total") > BLOCK)
    cut = cut.select("id", "group", "weight", F.explode(F.array("bin", F.col("bin") - 1)).alias("with"), "bin")
    cells = materialize(whole.unionByName(cut))
    sizes = cells.groupBy("group", "with").agg(F.count("*").alias("members")).where("members > 1")
    tasks = block_tasks(cells, sizes, ["group", "with"], "id", BLOCK).select("id", "weight", "bin", "side", "with", key_of(F.col("task")).alias("task_key"))
    wanted = small(groups.select(F.col("node").alias("id"), "version"))
    texts = named.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).withColumn("version", F.xxhash64("text"))
    texts = texts.join(wanted, (texts["id"] == wanted["id"]) & (texts["version"] == wanted["version"]), "left_semi").select("id", "text")
    sets = _gram_sets(texts, size).dropDuplicates(["id"]).select("id", "grams")
    ready = tasks.join(sets, "id").repartition("task_key").sortWithinPartitions("task_key")
    checked = materialize(ready.select("task_key", "id", "weight", "side", "grams", (F.col("bin") - F.col("with")).alias("offset")).mapInPandas(_verify(threshold, key), f"id {key}, low {key}, n_links bigint"))
    linked = components(checked.select(F.col("id").alias("a"), F.col("low").alias("b"))).withColumnRenamed("node", "class_id").withColumnRenamed("component", "group_id")
    links = checked.groupBy(F.col("id").alias("class_id")).agg(F.sum("n_links").alias("outside"))
    named_classes = classes.select("n", "k1", "k2", "class_id", "weight").join(links, "class_id", "left").join(linked, "class_id", "left")
    member = keyed.select("id", "n", "k1", "k2").join(named_classes, ["n", "k1", "k2"], "left")
    class_id = F.coalesce("class_id", "id")
    group_id = F.coalesce("group_id", class_id)
    return member.select(
        F.col("id").alias(id_column), class_id.alias("class_id"), (F.coalesce("outside", F.lit(0)) + F.coalesce(F.col("weight") - 1, F.lit(0))).cast("bigint").alias("n_links"),
        group_id.alias("group_id"), (group_id == F.col("id")).alias("kept"),
    )
