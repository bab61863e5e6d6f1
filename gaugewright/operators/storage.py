"""Storage and inventory reports over table snapshots.

Reports are sets: only those with a limit are ordered, since a total order over a fleet's tables
is a shuffle nobody but a screen needs. Every limit breaks ties by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.status import is_user_table
from ..functions.text import in_unit, ratio, rounded
from .lists import DATABASE, TABLE
from .snapshots import on_current


def user_tables(tables: DataFrame) -> DataFrame:
    """Tables outside the servers' own schemas."""
    return tables.filter(is_user_table(tables))


def _bytes(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast("bigint")


def total_bytes() -> Column:
    return _bytes("data_bytes") + _bytes("index_bytes")


def _sum(c: Column, name: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(name)


@on_current
def database_sizes(databases: DataFrame, tables: DataFrame) -> DataFrame:
    """Tables and bytes per database, empty databases included, with a TOTAL row.

    Tables are summed per database before the join.
    """
    sums = (
        user_tables(tables)
        .groupBy(*DATABASE)
        .agg(
            F.count(F.lit(1)).alias("table_count"),
            _sum(_bytes("data_bytes"), "data_bytes"),
            _sum(_bytes("index_bytes"), "index_bytes"),
        )
    )
    per_database = databases.select(*DATABASE).distinct().join(sums, DATABASE, "left")
    totalled = per_database.groupingSets([DATABASE, []], *DATABASE).agg(
        F.grouping_id().alias("level"),
        _sum(F.col("table_count"), "table_count"),
        _sum(F.col("data_bytes"), "data_bytes"),
        _sum(F.col("index_bytes"), "index_bytes"),
    )
    is_total = F.col("level") > 0
    size = F.col("data_bytes") + F.col("index_bytes")
    return totalled.select(
        F.when(is_total, F.lit("TOTAL")).otherwise(F.col("server")).alias("server"),
        F.when(is_total, F.lit("TOTAL")).otherwise(F.col("database_name")).alias("database_name"),
        "table_count", "data_bytes", "index_bytes", size.alias("total_bytes"),
        in_unit(size, 2).alias("total_mb"), in_unit(size, 3).alias("total_gb"),
    )


@on_current
def table_storage(tables: DataFrame) -> DataFrame:
    """Data, index and total size of each table."""
    size = total_bytes()
    return user_tables(tables).select(
        *TABLE,
        F.coalesce("row_count", F.lit(0)).cast("bigint").alias("row_count"),
        in_unit(_bytes("data_bytes"), 2).alias("data_mb"),
        in_unit(_bytes("index_bytes"), 2).alias("index_mb"),
        in_unit(size, 2).alias("total_mb"),
        in_unit(size, 3, 4).alias("total_gb"),
    )


@on_current
def data_vs_index(tables: DataFrame) -> DataFrame:
    """Data, index and total bytes over everything, and index per data."""
    sums = user_tables(tables).agg(_sum(_bytes("data_bytes"), "data_bytes"), _sum(_bytes("index_bytes"), "index_bytes"))
    size = F.col("data_bytes") + F.col("index_bytes")
    return sums.select(
        "data_bytes", "index_bytes", size.alias("total_bytes"),
        in_unit(F.col("data_bytes"), 2).alias("data_mb"), in_unit(F.col("index_bytes"), 2).alias("index_mb"),
        in_unit(size, 3, 4).alias("total_gb"), in_unit(size, 4, 6).alias("total_tb"),
        rounded(ratio(F.col("index_bytes"), F.col("data_bytes")), 4).alias("index_per_data"),
    )


SIZE_ORDERS = {"bytes": total_bytes, "rows": lambda: F.coalesce("row_count", F.lit(0))}


@on_current
def top_largest(tables: DataFrame, n: int = 100, order_by: str = "bytes", per_database: bool = False) -> DataFrame:
    """The n largest tables by bytes or rows, of the fleet or of each database."""
    sized = user_tables(tables).select(
        *TABLE,
        F.coalesce("row_count", F.lit(0)).cast("bigint").alias("row_count"),
        total_bytes().alias("total_bytes"),
        SIZE_ORDERS[order_by]().cast("bigint").alias("__order"),
    )
    order = [F.desc("__order"), F.desc("total_bytes"), *TABLE]
    if per_database:
        # A group limit runs before the shuffle: n rows per task and database.
        ranked = sized.withColumn("rank", F.row_number().over(Window.partitionBy(*DATABASE).orderBy(*order)))
        return ranked.filter(F.col("rank") <= n).drop("__order")
    return sized.orderBy(*order).limit(n).drop("__order")


@on_current
def largest_per_server(tables: DataFrame) -> DataFrame:
    """(server, table_name, total_bytes) of each server's largest table."""
    sized = user_tables(tables).select(*TABLE, total_bytes().alias("total_bytes"))
    place = F.row_number().over(Window.partitionBy("server").orderBy(F.desc("total_bytes"), *TABLE))
    return sized.withColumn("__place", place).filter("__place = 1").select("server", "table_name", "total_bytes")


@on_current
def row_counts(tables: DataFrame, limit: int = 1000) -> DataFrame:
    """Row estimates of the ``limit`` largest tables by rows."""
    if limit < 1:
        raise ValueError("the limit has to be 1 or more")
    rows = F.coalesce("row_count", F.lit(0)).cast("bigint").alias("row_count")
    return user_tables(tables).select(*TABLE, rows).orderBy(F.desc("row_count"), *TABLE).limit(limit)


@on_current
def storage_by_group(tables: DataFrame, key: str = "engine", default: str = "default") -> DataFrame:
    """Tables and bytes per storage class; tables without one count to the default class."""
    return (
        user_tables(tables)
        .groupBy(F.coalesce(F.col(key), F.lit(default)).alias("storage_class"))
        .agg(F.count(F.lit(1)).alias("table_count"), _sum(total_bytes(), "total_bytes"))
    )


@on_current
def non_default_engine(tables: DataFrame, default: str) -> DataFrame:
    """Base tables stored by another engine than the default."""
    return (
        user_tables(tables)
        .filter((F.col("engine") != default) & (F.col("table_type") == "BASE TABLE"))
        .select(*TABLE, "engine", total_bytes().alias("total_bytes"))
    )


@on_current
def capacity_used(volumes: DataFrame) -> DataFrame:
    """Used and free bytes and the used share of each volume (NULL for volumes without capacity)."""
    return volumes.select(
        "server", "name", "total_bytes", "used_bytes",
        (F.col("total_bytes") - F.col("used_bytes")).alias("free_bytes"),
        rounded(ratio(F.col("used_bytes"), F.col("total_bytes")) * 100.0, 2).alias("used_pct"),
    )


@on_current
def partition_counts(partitions: DataFrame) -> DataFrame:
    """Partitions and rows per partitioned table."""
    return (
        partitions.filter(is_user_table(partitions))
        .groupBy(*TABLE)
        .agg(
            F.count(F.lit(1)).alias("partition_count"),
            _sum(F.col("row_count"), "row_count"),
            _sum(total_bytes(), "total_bytes"),
        )
    )


@on_current
def partition_detail(partitions: DataFrame) -> DataFrame:
    """Partitions with their position, rows and size."""
    return partitions.filter(is_user_table(partitions)).select(
        *TABLE, "partition_name", "position", "row_count", total_bytes().alias("total_bytes")
    )


@on_current
def large_unpartitioned(tables: DataFrame, partitions: DataFrame, n: int = 100) -> DataFrame:
    """The largest tables without partitions, matched on server, database, schema and name."""
    return (
        user_tables(tables)
        .join(partitions.select(*TABLE).distinct(), TABLE, "left_anti")
        .select(*TABLE, total_bytes().alias("total_bytes"))
        .orderBy(F.desc("total_bytes"), *TABLE)
        .limit(n)
    )


@on_current
def fragmentation(tables: DataFrame) -> DataFrame:
    """Free space as a share of a table's space, and dead rows as a share of its rows."""
    free = ratio(F.col("free_bytes"), F.col("data_bytes") + F.col("free_bytes"))
    dead = ratio(F.col("dead_tuples"), F.col("live_tuples") + F.col("dead_tuples"))
    return user_tables(tables).select(
        *TABLE,
        rounded(F.coalesce(free, F.lit(0.0)) * 100.0, 2).alias("free_pct"),
        rounded(dead * 100.0, 2).alias("dead_pct"),
    )


@on_current
def fragmented_indexes(indexes: DataFrame, pages: int = 1000, pct: float = 30.0) -> DataFrame:
    """Indexes of some size whose pages are out of order."""
    return (
        indexes.filter((F.col("page_count") >= pages) & (F.col("fragmentation_pct") >= pct))
        .select(*TABLE, "index_name", "fragmentation_pct", "page_count")
        .distinct()
    )


def _io_per_table(io: DataFrame) -> DataFrame:
    """I/O counters summed per table, before any join."""
    return io.groupBy(*DATABASE, "schema_name", F.col("object_name").alias("table_name")).agg(
        *[_sum(F.col(c), c) for c in ("reads", "writes", "inserts", "updates", "deletes")]
    )


@on_current
def archival_candidates(tables: DataFrame, io: DataFrame, rows: int = 10_000, changes: int = 100) -> DataFrame:
    """Tables with many rows and few changes."""
    dml = F.coalesce(F.col("inserts") + F.col("updates") + F.col("deletes"), F.lit(0))
    return (
        user_tables(tables)
        .select(*TABLE, F.coalesce("row_count", F.lit(0)).cast("bigint").alias("row_count"))
        .filter(F.col("row_count") > rows)
        .join(_io_per_table(io), TABLE, "left")
        .select(*TABLE, "row_count", dml.cast("bigint").alias("changes"))
        .filter(F.col("changes") <= changes)
    )


@on_current
def limited_usage(tables: DataFrame, io: DataFrame) -> DataFrame:
    """Tables nobody read or wrote."""
    used = _io_per_table(io).filter((F.col("reads") > 0) | (F.col("writes") > 0))
    return user_tables(tables).select(*TABLE, total_bytes().alias("total_bytes")).join(used.select(*TABLE), TABLE, "left_anti")


@on_current
def hot_tables(io: DataFrame, n: int = 10, by: str = "operations") -> DataFrame:
    """The busiest tables by reads plus writes, or by writes."""
    operations = (F.col("reads") + F.col("writes")).alias("operations")
    return (
        _io_per_table(io)
        .select(*TABLE, "reads", "writes", operations)
        .filter(F.col("operations") > 0)
        .orderBy(F.desc(by), *TABLE)
        .limit(n)
    )


@on_current
def stale_statistics(tables: DataFrame) -> DataFrame:
    """When statistics were last taken: the analysis time, else the last change, else Never."""
    last = F.coalesce("last_analyzed", "update_time")
    return user_tables(tables).select(
        *TABLE, last.alias("statistics_time"),
        F.coalesce(F.date_format(last, "yyyy-MM-dd"), F.lit("Never")).alias("statistics_label"),
    )


@on_current
def modified_since_statistics(tables: DataFrame, io: DataFrame, n: int = 100) -> DataFrame:
    """The largest tables with changes since their statistics were taken."""
    changes = F.col("inserts") + F.col("updates") + F.col("deletes")
    changed = _io_per_table(io).select(*TABLE, changes.alias("modification_counter")).filter("modification_counter > 0")
    return (
        user_tables(tables)
        .select(*TABLE, F.coalesce("row_count", F.lit(0)).cast("bigint").alias("row_count"))
        .join(changed, TABLE)
        .orderBy(F.desc("row_count"), F.desc("modification_counter"), *TABLE)
        .limit(n)
    )


@on_current
def object_inventory(tables: DataFrame) -> DataFrame:
    """Tables per schema with their first creation and last change."""
    return (
        user_tables(tables)
        .groupBy(*DATABASE, "schema_name")
        .agg(
            F.count(F.lit(1)).alias("table_count"),
            F.min("create_time").alias("first_created"),
            F.max("update_time").alias("last_updated"),
        )
    )


@on_current
def list_namespaces(tables: DataFrame) -> DataFrame:
    """Schemas that are not the servers' own."""
    return user_tables(tables).select(*DATABASE, "schema_name").distinct()


@on_current
def list_tables(tables: DataFrame) -> DataFrame:
    """Base tables that are not the servers' own."""
    return user_tables(tables).filter(F.col("table_type") == "BASE TABLE").select(*TABLE)
