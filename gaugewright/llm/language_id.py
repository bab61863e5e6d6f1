"""Language identification with one bit-sliced Bloom filter over character n-grams.

Each slot of the filter is a bit mask of languages, so one lookup of an n-gram (the AND of its
slots) gives all languages that contain it. A text's n-grams are looked up, bits are counted per
language, the counts are corrected for the false positives that the filling of each language's bits
makes likely, and the largest corrected count decides.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..plans.materialize import materialize
from .text import code_points, mix, slices

ORDER = 4
HASHES = 3
#: An n-gram belongs to a language if it makes up this share of the language's n-grams at least, and
#: its rate there is this part of its highest rate in any language at least; so one that is common to all is in all.
LEAST_RATE, LEAST_PART = 1e-6, 0.1
MOST_LANGUAGES = 64
UNKNOWN = "und"
GAP = np.zeros(3, np.uint32)


@functools.cache
def letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 for all that is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def grams(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each n-gram, its text's number, whether each text has a letter). Runs of non-letters count as one space."""
    parts: list[np.ndarray] = []
    sizes = []
    for text in texts:
        codes = letters()[code_points(text)]
        kept = (codes != 0) | np.concatenate([[True], codes[:-1] != 0]) if len(codes) else np.zeros(0, bool)
        codes = codes[kept]
        parts += [GAP[:1], codes, GAP]
        sizes.append(len(codes) + 4)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    flat, owner = np.concatenate(parts), np.repeat(np.arange(len(texts)), sizes)
    has = np.bincount(owner[flat != 0], minlength=len(texts)) > 0
    n = len(flat) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), has
    hashed, good = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(order):
        hashed = hashed * np.uint64(0x100000001B3) + flat[k : n + k] + np.uint64(1)
        if k:
            good &= (flat[k : n + k] != 0) | (flat[k - 1 : n + k - 1] != 0)
    return mix(hashed[good]), owner[:n][good], has


@dataclass
class LanguageFilter:
    """The filter, its languages, and the share of slots that each language fills."""

    languages: list[str]
    masks: np.ndarray
    order: int

    def __post_init__(self) -> None:
        bits = np.arange(len(self.languages), dtype=np.uint64)
        fill = np.array([float((self.masks >> b & np.uint64(1)).mean()) for b in bits])
        self.false_rate = fill**HASHES

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), np.uint64(0xFFFFFFFFFFFFFFFF))
        for at in slots(hashes, len(self.masks)):
            out &= self.masks[at]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language and the corrected share of n-grams it contains, per text. Ties go to the first language by name."""
        hashes, owner, has = grams([t or "" for t in texts], self.order)
        found, n = self.lookup(hashes), np.bincount(owner, minlength=len(texts))
        shares = np.zeros((len(texts), len(self.languages)))
        for k in range(len(self.languages)):
            hits = np.bincount(owner[(found >> np.uint64(k) & np.uint64(1)) != 0], minlength=len(texts))
            rate = self.false_rate[k]
            shares[:, k] = np.clip((hits - n * rate) / np.maximum(n, 1) / max(1e-9, 1 - rate), 0, 1)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = shares.argmax(1)
        names = [self.languages[b] if h else UNKNOWN for b, h in zip(best, has)]
        return names, np.where(has, shares[np.arange(len(texts)), best], 0.0)


def slots(hashes: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The places of n-grams in a filter of a power of two of slots."""
    step, mask = (hashes >> np.uint64(32)) | np.uint64(1), np.uint64(size - 1)
    for k in range(HASHES):
        yield (hashes + step * np.uint64(k)) & mask


def train(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", order: int = ORDER) -> LanguageFilter:
    """Learns from all rows with a text and a language.

    All n-grams are counted per language, in tasks first. A language keeps those above fixed rates,
    so that it never has more than 1 / LEAST_RATE, whatever the corpus; only those reach the driver.
    """
    rows = docs.where(F.col(text_column).isNotNull() & F.col(lang_column).isNotNull()).select(F.col(lang_column).cast("string").alias("lang"), F.col(text_column).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        hashes, counts, langs = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)

        def write() -> pa.RecordBatch:
            by_number = list(names)
            return pa.RecordBatch.from_arrays([pa.array([by_number[k] for k in langs], pa.string()), pa.array(hashes.view(np.int64)), pa.array(counts)], names=["lang", "gram", "n"])

        for batch in slices(batches):
            own, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found, owner, _ = grams(texts, order)
            code = np.array([names.setdefault(x, len(names)) for x in own], np.int32)[owner]
            for lang in np.unique(code):
                new, n = np.unique(found[code == lang], return_counts=True)
                hashes, counts, langs = np.concatenate([hashes, new]), np.concatenate([counts, n]), np.concatenate([langs, np.full(len(new), lang, np.int32)])
            order_ = np.lexsort((hashes, langs))
            hashes, counts, langs = hashes[order_], counts[order_], langs[order_]
            if len(hashes):
                first = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (langs[1:] != langs[:-1])]))
                hashes, counts, langs = hashes[first], np.add.reduceat(counts, first), langs[first]
            if len(hashes) > 2_000_000:
                yield write()
                hashes, counts, langs = hashes[:0], counts[:0], langs[:0]
        if len(hashes):
            yield write()

    counted = materialize(rows.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not languages:
        return LanguageFilter([], np.zeros(1, np.uint64), order)
    rate: Column = F.lit(None).cast("double")
    number: Column = F.lit(None).cast("int")
    for k, lang in enumerate(languages):
        rate = F.when(F.col("lang") == lang, F.col("n") / float(totals[lang])).otherwise(rate)
        number = F.when(F.col("lang") == lang, k).otherwise(number)
    rated = counted.select("gram", number.alias("k"), rate.alias("rate"))
    highest = rated.groupBy("gram").agg(F.max("rate").alias("highest"))
    members = rated.where(F.col("rate") >= LEAST_RATE).join(highest, "gram").where(F.col("rate") >= F.col("highest") * LEAST_PART)
    table = members.groupBy("gram").agg(F.sum(F.pow(F.lit(2.0), F.col("k") % 32).cast("bigint") * (F.col("k") < 32).cast("int")).alias("low"), F.sum(F.pow(F.lit(2.0), F.col("k") % 32).cast("bigint") * (F.col("k") >= 32).cast("int")).alias("high")).toArrow()
    hashes = table["gram"].to_numpy().view(np.uint64)
    bits = table["low"].to_numpy().astype(np.uint64) | table["high"].to_numpy().astype(np.uint64) << np.uint64(32)
    size = 1 << max(10, math.ceil(math.log2(max(1, len(hashes)) * 8)))
    masks = np.zeros(size, np.uint64)
    for at in slots(hashes, size):
        np.bitwise_or.at(masks, at, bits)
    return LanguageFilter(languages, masks, order)


def identify(docs: DataFrame, model: LanguageFilter, text_column: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``.

    ``lang_pred`` is ``und``, with score 0, for a null text and a text without a letter, and for
    every text if nothing was learned. The score is the corrected share of the text's n-grams that
    the language contains. Columns of these names are replaced; all other columns, nulls and
    repeated rows are carried along as they are. An empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: see train

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text_column)
        for batch in slices(batches):
            lang, score = shared.value.predict(batch.column(at).cast(pa.string()).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    plain = docs.drop("lang_pred", "score")
    names = plain.columns
    schema = StructType([*plain.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return plain.mapInArrow(predict, schema)
