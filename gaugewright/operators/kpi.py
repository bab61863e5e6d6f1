"""Key figures, one row per server. Figures that cannot be computed are NULL and Unavailable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.fixed_values import RANGE_MINUTES
from ..functions.status import is_user_table, status_band
from ..functions.text import footprint_text, ratio, rounded, short_count
from .peaks import peaks
from .storage import total_bytes
from .snapshots import current, on_current
from .trends import metric_trend


def _three_bands(value: Column) -> Column:
    return (
        F.when(value.isNull(), F.lit("Unavailable"))
        .when(value < 60.0, F.lit("Normal"))
        .when(value < 80.0, F.lit("Elevated"))
        .otherwise(F.lit("Critical"))
    )


@on_current
def cpu_kpi(statements: DataFrame, n: int = 10) -> DataFrame:
    """A CPU figure from the time of each server's n slowest statements: seconds / 10, within 0.5 and 100."""
    order = Window.partitionBy("server").orderBy(F.desc("total_ms"), "database_name", "query_id")
    # The rank filter limits each task to n rows per server before the shuffle.
    slowest = (
        statements.select("server", "database_name", "query_id", "total_ms")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n)
    )
    seconds = slowest.groupBy("server").agg(F.sum(F.col("total_ms").cast("decimal(28,4)")).cast("double").alias("ms"))
    value = F.when(
        F.col("ms") > 0, rounded(F.least(F.lit(100.0), F.greatest(F.lit(0.5), F.col("ms") / 1000.0 / 10.0)), 1)
    ).otherwise(F.lit(0.0))
    return seconds.select("server", value.alias("value")).withColumn("status", _three_bands(F.col("value")))


def iops_kpi(samples: DataFrame, range_name: str, as_of: str, metrics: list[str]) -> DataFrame:
    """Operations per second per server from I/O samples: current, average and peak bucket."""
    seconds = RANGE_MINUTES[range_name] * 60 / 12
    trend = metric_trend(samples.filter(F.col("metric").isin(metrics)), range_name, as_of, ["server"], "total")
    per_second = [rounded(F.col(c) / F.lit(float(seconds)), 4).alias(n) for c, n in (("current", "value"), ("peak", "peak"))]
    average = F.aggregate(
        F.transform("values", lambda v: F.coalesce(v, F.lit(0.0))), F.lit(0.0), lambda a, v: a + v
    ) / F.lit(12.0 * seconds)
    return trend.select("server", *per_second, rounded(average, 4).alias("avg")).withColumn(
        "status", status_band("iops", F.col("value"))
    )


@on_current
def connections_kpi(counters: DataFrame, used: str = "threads_connected", limit: str = "max_connections") -> DataFrame:
    """Connections in use, the limit, and their ratio."""

    def counter(name: str) -> Column:
        return F.sum(F.when(F.col("metric") == name, F.col("value"))).cast("bigint")

    sums = counters.filter(F.col("metric").isin(used, limit)).groupBy("server").agg(
        counter(used).alias("used"), counter(limit).alias("max_connections")
    )
    return sums.withColumn("used_pct", rounded(ratio(F.col("used"), F.col("max_connections")) * 100.0, 1)).withColumn(
        "status", status_band("connection_pct", F.col("used_pct"))
    )


def counter_increase(samples: DataFrame, bucket_minutes: int = 60) -> DataFrame:
    """Increase of each cumulative counter over the samples given; a drop is a restart from zero.

    Differences are taken within time buckets and then between the buckets' ends, so no task
    holds more than one bucket of a series.
    """
    series = ["server", "metric"]
    bucket = F.window(F.col("ts").cast("timestamp"), f"{bucket_minutes} minutes")["start"]

    def step(value: Column, before: Column) -> Column:
        return F.when(before.isNull(), F.lit(0.0)).when(value >= before, value - before).otherwise(value)

    inside = Window.partitionBy(*series, "bucket").orderBy("ts", "value")
    steps = samples.withColumn("bucket", bucket).withColumn("before", F.lag("value").over(inside))
    buckets = steps.groupBy(*series, "bucket").agg(
        F.sum(step(F.col("value"), F.col("before"))).alias("inner"),
        F.min_by("value", F.struct("ts", "value")).alias("first"),
        F.max_by("value", F.struct("ts", "value")).alias("last"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )
    # One row per bucket of a series.
    between = Window.partitionBy(*series).orderBy("bucket")
    return (
        buckets.withColumn("outer", step(F.col("first"), F.lag("last").over(between)))
        .groupBy(*series)
        .agg(
            F.sum(F.col("inner") + F.col("outer")).alias("increase"),
            F.timestamp_diff("SECOND", F.min("first_ts"), F.max("last_ts")).alias("seconds"),
        )
    )


def qps_kpi(samples: DataFrame, metric: str, range_name: str) -> DataFrame:
    """Queries per second from the increase of a query counter, and the number that makes in the range."""
    rates = counter_increase(samples.filter(F.col("metric") == metric))
    qps = rounded(F.col("increase") / F.greatest(F.lit(1), F.col("seconds")), 1)
    return rates.select("server", qps.alias("qps")).withColumn(
        "total_queries", short_count(F.floor(F.col("qps") * F.lit(RANGE_MINUTES[range_name] * 60)))
    )


@on_current
def storage_kpi(tables: DataFrame) -> DataFrame:
    """Bytes, tables and a size text per server."""
    sums = (
        tables.filter(is_user_table(tables))
        .groupBy("server")
        .agg(F.sum(total_bytes()).cast("bigint").alias("total_bytes"), F.count(F.lit(1)).alias("table_count"))
    )
    return sums.withColumn("size_text", footprint_text(F.col("total_bytes")))


@on_current
def storage_total(tables: DataFrame, database: str | None = None) -> DataFrame:
    """Bytes over everything, or over one database only."""
    kept = tables.filter(is_user_table(tables))
    if database:
        kept = kept.filter(F.lower("database_name") == database.lower())
    sums = kept.agg(F.coalesce(F.sum(total_bytes()), F.lit(0)).cast("bigint").alias("total_bytes"))
    return sums.withColumn("size_text", footprint_text(F.col("total_bytes")))


def storage_growth(snapshots: DataFrame, time: str = "snapshot_ts") -> DataFrame:
    """Bytes per database and snapshot with the difference to the snapshot before."""
    keys = ["server", "database_name"]
    before = F.lag("bytes").over(Window.partitionBy(*keys).orderBy(time))  # one row per snapshot
    return snapshots.select(*keys, time, "bytes", "table_count", (F.col("bytes") - before).alias("growth_bytes"))


def blocked_kpi(locks: DataFrame, most: DataFrame | None = None) -> DataFrame:
    """Waiting locks per server now, and at most over the period where ``most`` (server, peak) has it."""
    now = current(locks).groupBy("server").agg(F.count_if(F.upper("lock_status") == "WAITING").alias("blocked"))
    if most is not None:
        now = now.join(most.select("server", F.col("peak").alias("__peak")), "server", "left")
        peak = F.greatest("blocked", F.col("__peak").cast("bigint"))
    else:
        peak = F.col("blocked")
    text = F.when(F.col("blocked") == 0, F.lit("No Blocking")).otherwise(F.concat(F.col("blocked"), F.lit(" Sessions Blocked")))
    return now.select("server", "blocked", peak.alias("peak"), text.alias("status_text")).withColumn(
        "status", status_band("blocking", F.col("blocked"))
    )


def blocked_over_period(locks: DataFrame, waits: DataFrame, since: str, until: str) -> DataFrame:
    """``blocked_kpi`` with the most sessions that waited at once in ``[since, until)`` and the first time they did.

    ``waits`` has a row per wait (server, start_ts, end_ts); one that goes on has no end.
    """
    most = peaks(waits, ["server"], "start_ts", "end_ts", since, until)
    return blocked_kpi(locks, most).join(most.select("server", "peak_at"), "server", "left")


@on_current
def deadlock_kpi(counters: DataFrame, metric: str = "deadlocks") -> DataFrame:
    """Deadlocks per server; any at all is critical."""
    sums = counters.groupBy("server").agg(
        F.coalesce(F.sum(F.when(F.col("metric") == metric, F.col("value"))), F.lit(0)).cast("bigint").alias("deadlocks")
    )
    none = F.col("deadlocks") == 0
    return sums.withColumns(
        {
            "status": F.when(none, F.lit("Normal")).otherwise(F.lit("Critical")),
            "status_text": F.when(none, F.lit("Zero Contention")).otherwise(
                F.concat(F.col("deadlocks"), F.lit(" Deadlock Event(s)"))
            ),
        }
    )
