"""Reading tables and files."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from hashlib import sha256
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = {".csv": "csv", ".parquet": "parquet", ".json": "json"}


class UnsupportedFormatError(ValueError):
    """The file extension has no reader."""


def extension_of(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""


def read_file(spark: SparkSession, path: str, schema: str | None = None, **options: str) -> DataFrame:
    """Read csv, parquet or json by extension.

    A ``schema`` saves csv and json the pass that infers one. JSON is one record per line, or an
    array of records with ``multiLine='true'``.
    """
    form = EXTENSIONS.get(extension_of(path))
    if form is None:
        raise UnsupportedFormatError(f"Unsupported file format: {extension_of(path) or path}")
    reader = spark.read.options(**options)
    if schema:
        reader = reader.schema(schema)
    if form == "csv":
        reader = reader.option("header", "true")
        return reader.csv(path) if schema else reader.option("inferSchema", "true").csv(path)
    return reader.parquet(path) if form == "parquet" else reader.json(path)


def jdbc_options(
    url: str,
    table: str,
    partition_column: str | None = None,
    bounds: tuple[str, str] | None = None,
    partitions: int | None = None,
    limit: int | None = None,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    """Options of a JDBC read; with a partition column the table is read in parallel ranges."""
    options = {
        "url": url, "dbtable": table, "fetchsize": str(fetch_size),
        "pushDownPredicate": "true", "pushDownLimit": "true", "pushDownAggregate": "true",
    }
    if partition_column:
        if not (bounds and partitions):
            raise ValueError("a partition column needs bounds and a number of partitions")
        options |= {
            "partitionColumn": partition_column, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
    elif limit is None:
        raise ValueError("a whole-table read needs a partition column; give a limit for a single-task read")
    return options


def quote_table(schema: str | None, table: str, dialect: str = "postgres") -> str:
    """A quoted table name for the source database."""
    left, right = {"mysql": ("`", "`"), "sqlserver": ("[", "]")}.get(dialect, ('"', '"'))
    return ".".join(left + part.replace(right, right * 2) + right for part in (schema, table) if part)


def read_table(
    spark: SparkSession,
    table: str,
    limit: int | None = None,
    url: str | None = None,
    credentials: dict[str, str] | None = None,
    **jdbc,
) -> DataFrame:
    """A catalogue table, or a database table over JDBC when ``url`` is given. ``limit`` 0 or None reads it all."""
    limit = limit or None
    if url:
        options = jdbc_options(url, table, limit=limit, **jdbc)
        df = spark.read.format("jdbc").options(**options, **(credentials or {})).load()
    else:
        df = spark.read.table(table)
    return df.limit(limit) if limit else df


def sample_rows(df: DataFrame, limit: int = 10, order_by: list[str] | None = None) -> DataFrame:
    """A few rows: the first ones in the order given, else any."""
    if limit < 1:
        raise ValueError("the limit has to be 1 or more")
    return (df.orderBy(*order_by) if order_by else df).limit(limit)


def list_tables(spark: SparkSession, database: str | None = None) -> list[str]:
    """Names of the tables of a catalogue database, sorted."""
    return sorted(t.name for t in spark.catalog.listTables(database))


def fan_out_union(
    spark: SparkSession, query: Callable[[str], DataFrame], databases: list[str], folder: str, threads: int = 4
) -> tuple[DataFrame | None, dict[str, str]]:
    """Run a query for each database and stack the results with a ``database_name`` column.

    Each database's rows are written to ``folder`` on their own, so that one that fails, when it is planned or
    while it runs, is left out and reported. Where all databases are in one fact table, select by its
    ``database_name`` instead: that is one scan.
    """

    def run(name: str) -> tuple[str, DataFrame | None, str | None]:
        path = f"{folder}/database={sha256(name.encode()).hexdigest()[:16]}"
        try:
            part = query(name).withColumn("database_name", F.lit(name))
            part.write.mode("overwrite").parquet(path)
            return name, spark.read.schema(part.schema).parquet(path), None
        except Exception as error:  # reported to the caller
            return name, None, str(error).splitlines()[0]

    with ThreadPoolExecutor(max_workers=threads) as pool:
        found = list(pool.map(run, databases))
    parts = [part for _, part, _ in found if part is not None]
    errors = {name: error for name, _, error in found if error is not None}
    if not parts:
        return None, errors
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), errors
