"""The most intervals open at once, by a sweep over their ends.

An interval adds one at its start and takes one away at its end. Changes at one time are added up
first, then dealt out by ranges of key and time. A running total within each range, on top of the
total of all ranges before it, is the number open after each change, so that one key with very many
intervals is not swept in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .quantiles import RANGE, in_ranges


def open_at_once(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, time, open): how many intervals of a key are open from each time on until the next one.

    An interval holds its start and not its end; one without an end stays open, one without a start or that ends before it starts counts nothing.
    """
    whole = intervals.filter(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) > F.col(start))))
    begins = whole.select(*keys, F.col(start).alias("time"), F.lit(1).alias("change"))
    ends = whole.filter(F.col(end).isNotNull()).select(*keys, F.col(end).alias("time"), F.lit(-1).alias("change"))
    changes = begins.unionByName(ends).groupBy(*keys, "time").agg(F.sum("change").alias("change"))
    ranged = in_ranges(changes, *keys, "time")
    # one row per key and range
    totals = ranged.groupBy(*keys, RANGE).agg(F.sum("change").alias("n"))
    joint = [*keys, RANGE]
    so_far = F.sum("n").over(Window.partitionBy(*keys).orderBy(RANGE)) - F.col("n")
    before = totals.select(*[F.col(k).alias(f"at_{k}") for k in joint], so_far.alias("before"))
    inside = F.sum("change").over(Window.partitionBy(*joint).orderBy("time"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"at_{k}")) for k in joint])
    joined = ranged.withColumn("inside", inside).join(before, same)
    return joined.select(*keys, "time", (F.col("before") + F.col("inside")).cast("bigint").alias("open"))


def peaks(intervals: DataFrame, keys: list[str], start: str, end: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """(keys, peak, peak_at): the most intervals open at once within ``[since, until)``, and the first time that was so.

    Keys of which no interval is open in the period have no row.
    """
    clipped = intervals
    if since is not None:
        low = F.lit(since).cast(intervals.schema[start].dataType)
        clipped = clipped.filter(F.col(end).isNull() | (F.col(end) > low)).withColumn(start, F.when(F.col(start).isNotNull(), F.greatest(F.col(start), low)))
    if until is not None:
        clipped = clipped.filter(F.col(start) < F.lit(until).cast(intervals.schema[start].dataType))
    open_ = open_at_once(clipped, keys, start, end)
    if until is not None:
        open_ = open_.filter(F.col("time") < F.lit(until).cast(intervals.schema[start].dataType))
    best = open_.groupBy(*keys).agg(F.max("open").alias("peak"), F.min_by("time", F.struct(-F.col("open"), F.col("time"))).alias("peak_at"))
    return best.filter("peak > 0")
