"""Trend points and quality counts of a stream, per tumbling window.

Both are windowed aggregates under a watermark: state is one row per open window and series, late
rows beyond the watermark are dropped, and a window is emitted once when it closes; ``run_to_end`` adds the
windows that are open when the input ends. The same
functions run on batch tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import TimestampNTZType

from ..functions.text import percent, rounded
from ..operators.quality import issue_tests
from ..plans.materialize import shared_folder

SERIES = ["server", "metric"]


def instants(df: DataFrame, time: str) -> DataFrame:
    """Watermarks need an instant: times without a zone are taken as UTC."""
    instant = F.col(time).cast("timestamp")
    if isinstance(df.schema[time].dataType, TimestampNTZType):
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        instant = F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, F.col(time)))
    return df.withColumn(time, instant)


def windowed(df: DataFrame, time: str, width: str, watermark: str) -> DataFrame:
    """Add a tumbling ``window``."""
    stamped = instants(df, time)
    return stamped.withWatermark(time, watermark).withColumn("window", F.window(time, width))


def stream_trend(
    samples: DataFrame, width: str = "5 minutes", watermark: str = "10 minutes", keys: list[str] | None = None
) -> DataFrame:
    """Samples, mean, smallest and largest value per window and series."""
    keys = keys or SERIES
    return (
        windowed(samples, "ts", width, watermark)
        .groupBy("window", *keys)
        .agg(
            F.count(F.lit(1)).alias("samples"),
            rounded(F.avg("value"), 1).alias("value"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
        )
        .select(F.col("window.start").alias("window_start"), *keys, "samples", "value", "min", "max")
    )


def stream_quality(df: DataFrame, time: str, width: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """Quality issues per window and column: blank identifiers, outer white space, numbers mixed with text."""
    tests = issue_tests(df)
    counts = [F.count(F.lit(1)).alias("total")]
    for k, t in enumerate(tests):
        counts += [F.expr(f"count_if({t.offends})").alias(f"n_{k}"), F.expr(f"coalesce({t.unless}, false)").alias(f"x_{k}")]
    issues = F.array(
        *[
            F.struct(
                F.lit(df.columns[t.position]).alias("column_name"), F.lit(t.issue).alias("issue_type"),
                F.col(f"n_{k}").alias("affected_count"), F.col(f"x_{k}").alias("excluded"),
            )
            for k, t in enumerate(tests)
        ]
    )
    return (
        windowed(df, time, width, watermark)
        .groupBy("window")
        .agg(*counts)
        .select(F.col("window.start").alias("window_start"), "total", F.inline(issues))
        .filter("affected_count > 0 AND NOT excluded")
        .select(
            "window_start", "column_name", "issue_type", "affected_count",
            percent(F.col("affected_count"), F.col("total")).alias("affected_percentage"),
        )
    )


def start(result: DataFrame, path: str, checkpoint: str | None = None, once: bool = False) -> StreamingQuery:
    """Append closed windows to parquet; progress is kept in ``checkpoint`` so a restart goes on where it stopped."""
    place = checkpoint or f"{shared_folder(result.sparkSession)}/stream-{uuid.uuid4().hex}"
    writer = result.writeStream.format("parquet").outputMode("append").option("checkpointLocation", place)
    return (writer.trigger(availableNow=True) if once else writer).start(path)


def run_available(result: DataFrame, path: str | None = None) -> DataFrame:
    """Process what the source holds now and return the windows that closed."""
    spark: SparkSession = result.sparkSession
    out = path or f"{shared_folder(spark)}/windows-{uuid.uuid4().hex}"
    start(result, out, once=True).awaitTermination()
    return spark.read.schema(result.schema).parquet(out)


def run_to_end(result: DataFrame, batch: DataFrame, path: str | None = None) -> DataFrame:
    """Process a stream that has ended: its closed windows, and from ``batch`` those still open at its end.

    ``batch`` is the same result over the same input read as a table. A window is taken from one side only.
    """
    closed = run_available(result, path)
    left = batch.join(closed.select("window_start").distinct(), "window_start", "left_anti")
    return closed.unionByName(left.select(*closed.columns))
