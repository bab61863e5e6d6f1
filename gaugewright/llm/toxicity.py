"""Toxicity: a linear classifier over character n-grams, their features scaled by naive Bayes log-count ratios.

The ratio of an n-gram compares the shares of toxic and of other training texts that have it; it is
counted over all labelled rows. The classifier's weights are fitted on a bounded sample of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import code_points, mix, slices

ORDERS = (3, 4, 5)
BITS = 19
SMOOTHING = 3.0
#: Features whose shares in the two labels differ by fewer standard errors are left out.
LEAST_ERRORS = 4.5
#: The weights are fitted on this many rows of each label at most.
SAMPLE_PER_LABEL = 3000
EPOCHS, RATE, PENALTY = 400, 0.5, 3e-4
#: Share of the toxic label in the weights of the fit, between its usual share and a half.
TOXIC_SHARE = 0.25


def features(text: str) -> np.ndarray:
    """The hashed character n-grams of a text, each once. Case is folded and white space runs count as one space."""
    codes = code_points(" " + " ".join(text.lower().split()) + " ").astype(np.uint64)
    found = []
    for order in ORDERS:
        n = len(codes) - order + 1
        if n > 0:
            hashed = np.full(n, order, np.uint64)
            for k in range(order):
                hashed = hashed * np.uint64(0x100000001B3) + codes[k : n + k]
            found.append(mix(hashed) >> np.uint64(64 - BITS))
    if not found:
        return np.zeros(0, np.int64)
    hit = np.zeros(1 << BITS, bool) if sum(map(len, found)) > 50_000 else None
    if hit is None:
        return np.unique(np.concatenate(found)).astype(np.int64)
    for part in found:
        hit[part] = True
    return np.flatnonzero(hit)


@dataclass
class ToxicityModel:
    """A weight per hashed n-gram, already times its ratio, and the intercept."""

    weights: np.ndarray
    intercept: float

    def score(self, text: str | None) -> float:
        z = self.intercept + float(self.weights[features(text or "")].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def log_count_ratios(rows: DataFrame) -> np.ndarray:
    """The ratio of each hashed n-gram over all rows (text, label); 0 where the labels hardly differ."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << BITS), np.int32)
        rows = np.zeros(2, np.int64)
        for batch in slices(batches):
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[label, features(text or "")] += 1
                rows[label] += 1
        at = np.flatnonzero(counts.any(0))
        if rows.any():
            at = np.concatenate([[-1], at])
            own = np.concatenate([rows[:, None], counts[:, at[1:]]], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(own[0], pa.int64()), pa.array(own[1], pa.int64())], names=["at", "clean", "toxic"])

    summed = rows.mapInArrow(count, "at int, clean bigint, toxic bigint").groupBy("at").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    table = summed.toArrow()  # at most 2 ** BITS rows of small numbers
    at, clean, toxic = (table[c].to_numpy() for c in ("at", "clean", "toxic"))
    if not len(at):
        return np.zeros(1 << BITS)
    total = at == -1
    n_clean, n_toxic = max(1, clean[total].sum()), max(1, toxic[total].sum())
    out = np.zeros(1 << BITS)
    small = SMOOTHING / n_toxic
    toxic, clean, at = toxic[~total], clean[~total], at[~total]
    ratios = np.log((toxic / n_toxic + small) / (clean / n_clean + small))
    share = (toxic + clean + 1) / (n_toxic + n_clean + 2)
    errors = (toxic / n_toxic - clean / n_clean) / np.sqrt(share * (1 - share) * (1 / n_toxic + 1 / n_clean))
    out[at] = np.where(np.abs(errors) >= LEAST_ERRORS, ratios, 0.0)
    return out


def fit(sample: list[tuple[np.ndarray, int]], ratios: np.ndarray) -> ToxicityModel:
    """Logistic regression on the scaled features of a sample."""
    labels = np.array([label for _, label in sample], np.float64)
    if not len(labels) or labels.min() == labels.max():
        return ToxicityModel(np.zeros(1 << BITS), 0.0 if not len(labels) else (4.0 if labels[0] else -4.0))
    kept = [f[ratios[f] != 0] for f, _ in sample]
    used, columns = np.unique(np.concatenate(kept), return_inverse=True)
    rows = np.repeat(np.arange(len(kept)), [len(k) for k in kept])
    values = ratios[used][columns]
    share = np.where(labels == 1, TOXIC_SHARE / labels.sum(), (1 - TOXIC_SHARE) / (len(labels) - labels.sum()))
    weights, intercept = np.zeros(len(used)), 0.0
    squares, square = np.full(len(used), 1e-8), 1e-8
    for _ in range(EPOCHS):
        z = intercept + np.bincount(rows, weights[columns] * values, len(labels))
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels) * share
        slope = np.bincount(columns, error[rows] * values, len(used)) + PENALTY * weights
        squares += slope**2
        square += error.sum() ** 2
        weights -= RATE * slope / np.sqrt(squares) * 0.1
        intercept -= RATE * error.sum() / np.sqrt(square) * 0.1
    out = np.zeros(1 << BITS)
    out[used] = weights * ratios[used]
    return ToxicityModel(out, float(intercept))


def train(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> ToxicityModel:
    """Learns from all rows whose label is 0 or 1: ratios from all, weights from a bounded sample.

    The sample is the SAMPLE_PER_LABEL rows of each label with the smallest hash of the id.
    A null text counts as empty; rows with a null id count in the ratios only. Without rows of both labels the score is constant.
    """
    rows = docs.where(F.col(label_column).isin(0, 1)).select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"), F.col(label_column).cast("int").alias("label"))
    ratios = log_count_ratios(rows.select("text", "label"))
    shared = docs.sparkSession.sparkContext.broadcast(ratios != 0)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = []
            for text in batch.column(0).to_pylist():
                own = features(text)
                found.append(own[shared.value[own]].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column(1)], names=["found", "label"])

    sample = []
    for label in (0, 1):
        ids = rows.where(F.col("label") == label).select("id").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_PER_LABEL).distinct()
        chosen = rows.where(F.col("label") == label).join(F.broadcast(ids), "id", "left_semi").select("text", "label")
        table = chosen.mapInArrow(reduce, "found array<int>, label int").toArrow()
        sample += [(np.array(f, np.int64), label) for f in table["found"].to_pylist()]
    return fit(sample, ratios)


def score(docs: DataFrame, model: ToxicityModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id_column, score, predicted) per row: the probability of the toxic label, and whether it is 0.5 or more.

    Only the text is looked at. Null and empty texts get the score of the intercept. Repeated rows
    and null ids are kept one by one. Other columns are ignored. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS numbers
    key = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = [shared.value.score(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    out = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, f"id {key}, score double")
    return out.select(F.col("id").alias(id_column), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
