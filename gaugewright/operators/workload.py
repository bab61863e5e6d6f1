"""Statements, I/O, waits, caches and temporary space over telemetry snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.fixed_values import (
    BENIGN_WAITS,
    BENIGN_WAITS_LONG,
    IDLE_WAIT_CLASS,
    IDLE_WAIT_PREFIX,
    LOAD_PROFILE_COUNTERS,
)
from ..functions.status import wait_category
from ..functions.text import cut, ratio, rounded
from .lists import DATABASE
from .snapshots import on_current

STATEMENT = [*DATABASE, "query_id"]
COUNTERS = ["calls", "rows_examined", "rows_sent", "reads", "writes"]


def share_of_total(top: DataFrame, value: str, alias: str = "share_pct") -> DataFrame:
    """Percent of the sum over the rows given. For results already cut to a few rows."""
    total = F.sum(value).over(Window.partitionBy(F.lit(1)))
    return top.withColumn(alias, rounded(F.coalesce(ratio(F.col(value), total), F.lit(0.0)) * 100.0, 1))


def _top_statements(statements: DataFrame, measure: Column, n: int, least: float = 0.0) -> DataFrame:
    """The n statements with the highest measure, summed per digest.

    Only numbers are shuffled; the texts of the n winners are fetched afterwards.
    """
    sums = statements.groupBy(*STATEMENT).agg(
        *[F.sum(c).cast("bigint").alias(c) for c in COUNTERS], F.sum("total_ms").alias("total_ms")
    )
    top = (
        sums.withColumn("measure", measure)
        .filter(F.col("measure") >= least)
        .orderBy(F.desc("measure"), *STATEMENT)
        .limit(n)
    )
    texts = (
        statements.join(top.select(*STATEMENT), STATEMENT)
        .groupBy(*STATEMENT)
        .agg(F.min("query_text").alias("query_text"))
    )
    return top.join(texts, STATEMENT)


@on_current
def slow_statements(statements: DataFrame, n: int = 50, least_ms: float = 10.0) -> DataFrame:
    """Statements by total time."""
    seconds = F.col("total_ms") / 1000.0
    return _top_statements(statements, F.col("total_ms"), n, least_ms).select(
        *STATEMENT, "query_text", cut(F.col("query_text"), 60).alias("query_label"), "calls",
        rounded(seconds, 4).alias("total_seconds"),
        rounded(ratio(seconds, F.col("calls")), 6).alias("avg_seconds"),
        "rows_examined", "rows_sent",
    )


@on_current
def top_cpu_statements(statements: DataFrame, n: int = 10) -> DataFrame:
    """Statements by time, with their share of the n returned."""
    top = _top_statements(statements, F.col("total_ms"), n)
    return share_of_total(top, "total_ms", "cpu_pct").select(
        *STATEMENT, "query_text", "calls", rounded(F.col("total_ms"), 2).alias("cpu_ms"),
        rounded(ratio(F.col("total_ms"), F.col("calls")), 2).alias("mean_ms"), "cpu_pct",
    )


def _first_per_server(rows: DataFrame, order: list) -> DataFrame:
    """One row per server; the rank filter limits each task to one row a server before the shuffle."""
    place = F.row_number().over(Window.partitionBy("server").orderBy(*order))
    return rows.withColumn("__place", place).filter("__place = 1").drop("__place")


@on_current
def top_statement_per_server(statements: DataFrame) -> DataFrame:
    """(server, query_text, cpu_ms) of each server's statement with the most time."""
    slim = statements.select("server", "database_name", "query_id", "query_text", rounded(F.col("total_ms"), 2).alias("cpu_ms"), "total_ms")
    return _first_per_server(slim, [F.desc("total_ms"), "database_name", "query_id"]).select("server", "query_text", "cpu_ms")


@on_current
def top_wait_per_server(waits: DataFrame) -> DataFrame:
    """(server, wait_event) of the event each server waited on longest, idle ones aside."""
    is_idle = F.coalesce(F.col("wait_class") == IDLE_WAIT_CLASS, F.lit(False))
    sums = waits.filter(~is_idle).groupBy("server", "wait_event").agg(F.sum(F.col("wait_ms").cast("decimal(28,4)")).alias("ms"))
    return _first_per_server(sums, [F.desc("ms"), "wait_event"]).select("server", "wait_event")


@on_current
def high_examined_statements(statements: DataFrame, n: int = 50) -> DataFrame:
    """Statements by rows examined."""
    return _top_statements(statements, F.col("rows_examined"), n).select(
        *STATEMENT, "query_text", cut(F.col("query_text"), 60).alias("query_label"), "calls", "rows_examined",
        rounded(ratio(F.col("rows_examined"), F.col("calls")), 2).alias("avg_rows_examined"),
    )


@on_current
def frequent_statements(statements: DataFrame, n: int = 50) -> DataFrame:
    """Statements by calls."""
    return _top_statements(statements, F.col("calls"), n).select(
        *STATEMENT, "query_text", cut(F.col("query_text"), 60).alias("query_label"), "calls"
    )


def _io_entities(io: DataFrame, n: int) -> DataFrame:
    keys = [*DATABASE, "schema_name", "object_name"]
    operations = F.sum(F.col("reads") + F.col("writes")).cast("bigint").alias("io_operations")
    return (
        io.groupBy(*keys).agg(operations)
        .filter("io_operations > 0")
        .orderBy(F.desc("io_operations"), *keys)
        .limit(n)
        .select(*DATABASE, F.concat_ws(".", "schema_name", "object_name").alias("entity"), "io_operations")
    )


@on_current
def top_io(statements: DataFrame, io: DataFrame, n: int = 10) -> DataFrame:
    """Statements by reads plus writes; tables where no statement reports any."""
    by_statement = _top_statements(statements, F.col("reads") + F.col("writes"), n, 1).select(
        *DATABASE, F.col("query_text").alias("entity"), F.col("measure").cast("bigint").alias("io_operations"),
        F.lit("statement").alias("source"),
    )
    by_table = _io_entities(io, n).withColumn("source", F.lit("table"))
    # 2n rows at most.
    both = by_statement.unionByName(by_table).withColumn(
        "first_source", F.min("source").over(Window.partitionBy(F.lit(1)))
    )
    return share_of_total(both.filter("source = first_source").drop("first_source"), "io_operations", "io_pct")


@on_current
def table_io_activity(io: DataFrame, n: int = 100) -> DataFrame:
    """Operation counts per table, busiest first."""
    keys = [*DATABASE, "schema_name", "object_name"]
    sums = io.groupBy(*keys).agg(
        *[F.sum(c).cast("bigint").alias(c) for c in ("reads", "writes", "inserts", "updates", "deletes")]
    )
    return sums.orderBy(F.desc(F.col("reads") + F.col("writes")), *keys).limit(n)


@on_current
def table_wait_time(io: DataFrame, n: int = 50) -> DataFrame:
    """Operations and wait time per table, longest wait first."""
    keys = [*DATABASE, "schema_name", "object_name"]
    sums = io.groupBy(*keys).agg(
        F.sum(F.col("reads") + F.col("writes")).cast("bigint").alias("operations"),
        rounded(F.sum(F.col("wait_ms").cast("decimal(28,4)")).cast("double"), 4).alias("wait_ms"),
    )
    return sums.orderBy(F.desc("wait_ms"), *keys).limit(n)


@on_current
def top_wait_events(waits: DataFrame, n: int = 10, long_list: bool = False) -> DataFrame:
    """Wait events by time, idle and benign ones aside, with their share of the n returned. Empty means no waits."""
    event = F.col("wait_event")
    benign = BENIGN_WAITS_LONG if long_list else BENIGN_WAITS
    is_idle = F.coalesce(F.col("wait_class") == IDLE_WAIT_CLASS, F.lit(False))  # not every source has classes
    held_up = ~event.isin(benign) & ~event.startswith(IDLE_WAIT_PREFIX) & ~is_idle
    top = (
        waits.filter(held_up)
        .groupBy("wait_event")
        .agg(
            F.sum("wait_count").cast("bigint").alias("wait_count"),
            rounded(F.sum(F.col("wait_ms").cast("decimal(28,4)")).cast("double"), 2).alias("wait_ms"),
        )
        .filter("wait_ms > 0")
        .orderBy(F.desc("wait_ms"), "wait_event")
        .limit(n)
    )
    return share_of_total(top, "wait_ms", "wait_pct").withColumn("wait_category", wait_category(event))


@on_current
def waiting_sessions(sessions: DataFrame, n: int = 10) -> DataFrame:
    """Wait events by number of active sessions in them, for sources that report sessions instead of time."""
    top = (
        sessions.filter((F.col("state") == "active") & F.col("wait_event").isNotNull())
        .groupBy(F.coalesce("wait_class", F.lit("Other")).alias("wait_category"), "wait_event")
        .agg(F.count(F.lit(1)).alias("wait_count"))
        .orderBy(F.desc("wait_count"), "wait_category", "wait_event")
        .limit(n)
    )
    return share_of_total(top, "wait_count", "wait_pct")


def _counter(name: str) -> Column:
    return F.sum(F.when(F.col("metric") == name, F.col("value")))


@on_current
def cache_efficiency(counters: DataFrame, hits: str = "blocks_hit", reads: str = "blocks_read") -> DataFrame:
    """Cache hit and miss share per server. No reads at all gives NULL and Unavailable, not a made-up figure."""
    sums = (
        counters.filter(F.col("metric").isin(hits, reads))
        .groupBy("server")
        .agg(_counter(hits).cast("bigint").alias("hit_count"), _counter(reads).cast("bigint").alias("miss_count"))
    )
    found = F.coalesce("hit_count", F.lit(0))
    hit = rounded(ratio(found, found + F.coalesce("miss_count", F.lit(0))) * 100.0, 1)
    status = (
        F.when(F.col("hit_pct") >= 95.0, F.lit("Healthy"))
        .when(F.col("hit_pct") >= 85.0, F.lit("Elevated"))
        .when(F.col("hit_pct").isNotNull(), F.lit("Needs Attention"))
        .otherwise(F.lit("Unavailable"))
    )
    return sums.withColumn("hit_pct", hit).select(
        "server", "hit_count", "miss_count", "hit_pct",
        rounded(F.lit(100.0) - F.col("hit_pct"), 1).alias("miss_pct"), status.alias("status"),
    )


ACTIVITY = ["commits", "rollbacks", "blocks_read", "blocks_hit", "deadlocks"]


@on_current
def activity_profile(counters: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """Counters per database, side by side."""
    names = metrics or ACTIVITY
    return (
        counters.filter(F.col("metric").isin(names))
        .groupBy(*DATABASE)
        .agg(*[F.coalesce(_counter(m), F.lit(0)).cast("bigint").alias(m.replace(" ", "_")) for m in names])
    )


def load_profile(counters: DataFrame) -> DataFrame:
    """The allow-listed load counters per database."""
    return activity_profile(counters, LOAD_PROFILE_COUNTERS)


@on_current
def temp_usage(temp: DataFrame) -> DataFrame:
    """Temporary bytes and files per database, where there are any."""
    return (
        temp.groupBy(*DATABASE)
        .agg(F.sum("bytes").cast("bigint").alias("temp_bytes"), F.sum("files").cast("bigint").alias("temp_files"))
        .filter("temp_bytes > 0 OR temp_files > 0")
    )
