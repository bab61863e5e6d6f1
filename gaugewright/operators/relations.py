"""Foreign keys, keys and indexes over catalogue snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lists import DATABASE, TABLE, joined, ordered_set
from .snapshots import on_current
from .storage import user_tables

CHILD = [*DATABASE, "child_schema", "child_table"]
PARENT = [*DATABASE, "parent_schema", "parent_table"]


def _related(fk: DataFrame, side: list[str], other: list[str], count: str) -> DataFrame:
    """Distinct tables and constraints are counted apart: an aggregate of two distinct counts copies every row and forgets how the rows lie."""
    tables = fk.select(*side, *other[-2:]).distinct().groupBy(*side).agg(F.count(F.lit(1)).alias(count))
    names = fk.select(*side, "constraint_name").distinct().groupBy(*side).agg(F.count("constraint_name").alias("fk_count"))
    both = tables.unionByName(names, allowMissingColumns=True).groupBy(*side)
    return both.agg(F.sum(count).alias(count), F.sum("fk_count").alias("fk_count"))


@on_current
def parent_tables(fk: DataFrame) -> DataFrame:
    """Tables others refer to: number of distinct child tables and of constraints. ``related_tables`` has the names."""
    return _related(fk, PARENT, CHILD, "child_count")


@on_current
def child_tables(fk: DataFrame) -> DataFrame:
    """Tables that refer to others: number of distinct parent tables and of constraints. ``related_tables`` has the names."""
    return _related(fk, CHILD, PARENT, "parent_count")


@on_current
def related_tables(fk: DataFrame) -> DataFrame:
    """The names behind the counts: a row per child table and parent table."""
    return fk.select(*CHILD, "parent_schema", "parent_table").distinct()


@on_current
def independent_tables(tables: DataFrame, fk: DataFrame) -> DataFrame:
    """Tables on neither side of a foreign key."""
    sides = [fk.select(*[F.col(c).alias(n) for c, n in zip(side, TABLE)]) for side in (CHILD, PARENT)]
    return user_tables(tables).select(*TABLE).join(sides[0].union(sides[1]).distinct(), TABLE, "left_anti")


@on_current
def foreign_keys(fk: DataFrame) -> DataFrame:
    """Column pairs of each constraint with their position."""
    return fk.select(
        *CHILD, "constraint_name", "position", "child_column", "parent_schema", "parent_table", "parent_column"
    ).distinct()


@on_current
def fk_graph(fk: DataFrame) -> DataFrame:
    """One edge per constraint with its columns in order."""
    return fk.groupBy(*CHILD, "parent_schema", "parent_table", "constraint_name").agg(
        joined(ordered_set("position", "child_column")).alias("child_columns"),
        joined(ordered_set("position", "parent_column")).alias("parent_columns"),
    )


@on_current
def many_foreign_keys(fk: DataFrame) -> DataFrame:
    """Foreign keys per table."""
    return fk.groupBy(*CHILD).agg(F.count_distinct("constraint_name").alias("fk_count"))


INDEX = [*TABLE, "index_name"]


@on_current
def indexes(index_columns: DataFrame) -> DataFrame:
    """One row per index with its columns in order."""
    grouped = index_columns.groupBy(*INDEX).agg(
        ordered_set("position", "column_name").alias("__columns"),
        F.bool_or("is_unique").alias("is_unique"),
        F.bool_or("is_primary").alias("is_primary"),
        F.bool_or("is_disabled").alias("is_disabled"),
        F.max("index_type").alias("index_type"),
        F.max("index_bytes").cast("bigint").alias("index_bytes"),
    )
    return grouped.select(
        *INDEX, joined(F.col("__columns")).alias("column_list"), F.size("__columns").cast("bigint").alias("column_count"),
        "is_unique", "is_primary", "is_disabled", "index_type", "index_bytes",
    )


def _column_lists(index_columns: DataFrame) -> DataFrame:
    return index_columns.groupBy(*INDEX).agg(joined(ordered_set("position", "column_name")).alias("column_list"))


def _index_names(index_columns: DataFrame) -> DataFrame:
    """The columns of each index in order, as a list: names may hold any sign."""
    return index_columns.groupBy(*INDEX).agg(F.transform(ordered_set("position", "column_name"), lambda p: p["i"]).alias("names"))


@on_current
def primary_keys(index_columns: DataFrame) -> DataFrame:
    """Primary key columns in order."""
    return _column_lists(index_columns.filter("is_primary"))


@on_current
def tables_without_pk(tables: DataFrame, index_columns: DataFrame) -> DataFrame:
    """Base tables without a primary key."""
    keyed = index_columns.filter("is_primary").select(*TABLE).distinct()
    base = user_tables(tables).filter(F.col("table_type") == "BASE TABLE").select(*TABLE)
    return base.join(keyed, TABLE, "left_anti")


@on_current
def unique_constraints(index_columns: DataFrame) -> DataFrame:
    """Unique indexes that are not primary keys, with their columns in order."""
    return _column_lists(index_columns.filter("is_unique AND NOT is_primary"))


@on_current
def index_column_list(index_columns: DataFrame) -> DataFrame:
    """Index columns with their position."""
    return index_columns.select(*INDEX, "position", "column_name").distinct()


@on_current
def index_counts(index_columns: DataFrame, more_than: int = 0) -> DataFrame:
    """Indexes per table."""
    counts = index_columns.groupBy(*TABLE).agg(F.count_distinct("index_name").alias("index_count"))
    return counts.filter(F.col("index_count") > more_than)


@on_current
def largest_indexes(index_columns: DataFrame, n: int = 100) -> DataFrame:
    """The n largest indexes."""
    sizes = index_columns.groupBy(*INDEX).agg(F.max("index_bytes").cast("bigint").alias("index_bytes"))
    return sizes.orderBy(F.desc("index_bytes"), *INDEX).limit(n)


@on_current
def duplicate_indexes(index_columns: DataFrame) -> DataFrame:
    """Indexes that repeat another one's columns, or whose columns are the start of another's.

    Groups, not pairs: a 'duplicate' row counts the indexes with one column list and names the first; a
    'prefix overlap' row says how many indexes of the table begin with that list and go on. ``duplicate_index_names`` has
    all names. Indexes are counted per list first, then every list counts for itself and for its starts,
    so a table with very many indexes yields no more rows than it has column lists.
    """
    lists = _index_names(index_columns).groupBy(*TABLE, "names").agg(F.count(F.lit(1)).alias("n"), F.min("index_name").alias("first_name"))
    size = F.size("names")
    starts = F.transform(F.sequence(F.lit(1), size), lambda k: F.struct(F.slice("names", F.lit(1), k).alias("names"), (k == size).alias("own")))
    own, longer = F.col("s.own"), ~F.col("s.own")
    counted = (
        lists.select(*TABLE, "n", "first_name", F.explode(starts).alias("s"))
        .groupBy(*TABLE, F.col("s.names").alias("names"))
        .agg(
            F.sum(F.when(own, F.col("n"))).alias("equal"), F.min(F.when(own, F.col("first_name"))).alias("first_index"),
            F.sum(F.when(longer, F.col("n"))).alias("longer"), F.min(F.when(longer, F.col("first_name"))).alias("longer_example"),
        )
        .filter("equal IS NOT NULL")
    )
    kinds = F.array(
        F.when(F.col("equal") > 1, F.struct(F.lit("duplicate").alias("kind"), F.col("equal").alias("index_count"), F.col("first_index").alias("example"))),
        F.when(F.col("longer") > 0, F.struct(F.lit("prefix overlap").alias("kind"), F.col("longer").alias("index_count"), F.col("longer_example").alias("example"))),
    )
    return counted.select(*TABLE, "names", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("k")).select(*TABLE, F.array_join("names", ", ").alias("column_list"), "k.*")


@on_current
def duplicate_index_names(index_columns: DataFrame) -> DataFrame:
    """The indexes that share their column list with another one of their table, a row each."""
    every = _index_names(index_columns)
    shared = every.groupBy(*TABLE, "names").agg(F.count(F.lit(1)).alias("index_count")).filter("index_count > 1")
    return every.join(shared, [*TABLE, "names"]).select(*INDEX, F.array_join("names", ", ").alias("column_list"))


def _index_io(io: DataFrame) -> DataFrame:
    """I/O counters summed per index, before any join."""
    return (
        io.filter(F.col("index_name").isNotNull())
        .groupBy(*DATABASE, "schema_name", F.col("object_name").alias("table_name"), "index_name")
        .agg(F.sum("reads").cast("bigint").alias("reads"), F.sum("writes").cast("bigint").alias("writes"))
    )


@on_current
def unused_indexes(index_columns: DataFrame, io: DataFrame) -> DataFrame:
    """Indexes, primary keys aside, that were never read."""
    candidates = index_columns.filter("NOT is_primary").select(*INDEX).distinct()
    return candidates.join(_index_io(io).filter("reads > 0").select(*INDEX), INDEX, "left_anti")


@on_current
def index_usage(index_columns: DataFrame, io: DataFrame) -> DataFrame:
    """Reads and writes of the indexes that had any."""
    return (
        index_columns.select(*INDEX).distinct()
        .join(_index_io(io), INDEX)
        .withColumn("total", F.col("reads") + F.col("writes"))
        .filter("total > 0")
    )


@on_current
def tables_without_index(tables: DataFrame, index_columns: DataFrame) -> DataFrame:
    """Base tables with no index at all."""
    base = user_tables(tables).filter(F.col("table_type") == "BASE TABLE").select(*TABLE)
    return base.join(index_columns.select(*TABLE).distinct(), TABLE, "left_anti")


@on_current
def disabled_indexes(index_columns: DataFrame) -> DataFrame:
    return index_columns.filter("is_disabled").select(*INDEX).distinct()


@on_current
def missing_index_candidates(io: DataFrame, n: int = 100) -> DataFrame:
    """Tables read most without an index; ties go to those read more in all."""
    scans = F.sum(F.when(F.col("index_name").isNull(), F.col("reads")))
    return (
        io.groupBy(*DATABASE, "schema_name", F.col("object_name").alias("table_name"))
        .agg(scans.cast("bigint").alias("full_scans"), F.sum(F.when(F.col("index_name").isNotNull(), F.col("reads"))).cast("bigint").alias("index_reads"))
        .filter("full_scans > 0")
        .withColumn("index_reads", F.coalesce("index_reads", F.lit(0).cast("bigint")))
        .orderBy(F.desc("full_scans"), F.desc("index_reads"), *TABLE)
        .limit(n)
    )
