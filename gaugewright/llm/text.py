"""Small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

ROWS_AT_ONCE = 256


def fold(id_column: str | Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo the number of folds. A null id is in fold 0."""
    key = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds, F.lit(0)).cast("int")


def slices(batches: Iterator[pa.RecordBatch], most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches into slices of few rows and few bytes (one row at least), so that long texts don't pile up in a worker."""
    for batch in batches:
        at, mean = 0, max(1, batch.nbytes // max(1, batch.num_rows))
        step = int(max(1, min(ROWS_AT_ONCE, most_bytes // mean)))
        while at < batch.num_rows:
            yield batch.slice(at, step)
            at += step


def code_points(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers so that all their bits depend on all bits (a bijection)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x
