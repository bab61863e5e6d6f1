"""Exact order statistics of histograms of any size, with one shuffle.

The values of a histogram are dealt out by ranges of key and value and stored, each row with the
number of its range. A range's total is one row per key, so running totals over the ranges say which
range holds a wanted rank and how many values come before it. The rank is then found within that one
range. Whatever the distribution, it takes the job that stores the ranges and the one that reads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.materialize import materialize

RANGE = "value_range"


def in_ranges(values: DataFrame, *order: str) -> DataFrame:
    """A stored copy of a histogram, dealt out by ranges of ``order``, with the number of each row's range.

    Rows that are equal in ``order`` are in one range. AQE is not asked to merge ranges: their number sets their size.
    """
    ranges = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(values.repartitionByRange(ranges, *order).withColumn(RANGE, F.spark_partition_id()))


def order_statistics(ranged: DataFrame, targets: list[tuple[int, int]]) -> DataFrame:
    """(key, rank, value): the value at each (key, rank from 0) target of a (key, value, count, value_range) histogram stored by ``in_ranges``.

    Nulls, ranks beyond the last value and keys without values have no row. Targets are a few per column.
    """
    wanted = F.broadcast(ranged.sparkSession.createDataFrame(sorted(set(targets)), "key int, rank bigint"))
    # one row per key and range
    totals = ranged.groupBy("key", RANGE).agg(F.sum("count").alias("n"))
    before = F.sum("n").over(Window.partitionBy("key").orderBy(RANGE)) - F.col("n")
    holding = totals.withColumn("before", before).join(wanted, "key").filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n")))
    inside = ranged.join(F.broadcast(holding.select("key", RANGE, "rank", "before")), ["key", RANGE])  # a row per target
    # whole numbers beyond 2^53 can be one double
    once = inside.groupBy("key", "rank", "before", "value").agg(F.sum("count").alias("count"))
    upto = F.col("before") + F.sum("count").over(Window.partitionBy("key", "rank").orderBy("value"))
    found = once.withColumn("upto", upto).filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("count")))
    return found.select("key", "rank", "value")
