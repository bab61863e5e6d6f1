"""Words, word shingles and their hashes as Spark expressions, and joins with a side of checked size.

The shingle expressions refer to the words once per shingle: give them a column that an earlier ``select`` made, not ``words(...)`` itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
NOT_WORD = r"[^\p{L}\p{N}]+"
#: Largest number of narrow rows (a few numbers each) that is broadcast.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits. Null and wordless texts give an empty array."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), NOT_WORD, " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def shingle_starts(found: Column, size: int) -> Column:
    return F.sequence(F.lit(0), F.greatest(F.size(found) - size, F.lit(0)))


def shingle_hashes(found: Column, size: int = SHINGLE) -> Column:
    """64-bit hashes of all runs of ``size`` words; a shorter text with words has one, of all its words."""
    return (
        F.when(F.size(found) == 0, F.array().cast("array<bigint>"))
        .when(F.size(found) < size, F.array(F.xxhash64(found)))
        .otherwise(F.transform(shingle_starts(found, size), lambda i: F.xxhash64(*[F.get(found, i + k) for k in range(size)])))
    )


def shingles(found: Column, size: int = SHINGLE) -> Column:
    """The same runs as texts, each once."""
    return F.when(F.size(found) == 0, F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.transform(shingle_starts(found, size), lambda i: F.array_join(F.slice(found, i + 1, size), " ")))
    )


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table of narrow rows, to be broadcast if it has at most ``rows`` rows; else joins shuffle it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def each(df: DataFrame, key: str, array: str, name: str) -> DataFrame:
    """(key, name): the elements of an array that holds no nulls.

    An inner ``explode`` would let the optimizer test the array's size before the array is made, and
    so work the words out again for every shingle.
    """
    return df.select(key, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())
