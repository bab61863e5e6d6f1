"""Profiling many tables, and running many reports, each on its own.

Each table is an independent set of Spark jobs, submitted from a few driver threads. A failing
table becomes a row with an error; finished tables are skipped when a run is repeated.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from hashlib import sha256
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.imputation import recommend
from ..operators.profile import profile
from ..plans.materialize import materialize

RUN_SCHEMA = (
    "table_key string, version string, row_limit bigint, row_count bigint, column_count bigint, "
    "missing_cells bigint, error string"
)
PROFILE_COLUMNS = (
    "position", "column_name", "spark_type", "physical_type", "category", "total_rows", "non_null_count",
    "missing_count", "missing_percentage", "unique_count", "statistics", "distribution",
    "recommended_method", "reason",
)


@dataclass(frozen=True)
class TableKey:
    """What a stored profile stands for: the table, its snapshot, and the row limit."""

    name: str
    version: str = ""
    row_limit: int = 0

    @property
    def digest(self) -> str:
        return sha256(repr((self.name, self.version, self.row_limit)).encode()).hexdigest()[:32]


def _profile_one(key: TableKey, load: Callable[[], DataFrame], folder: str) -> tuple:
    try:
        df = load()
        if key.row_limit:
            df = materialize(df.limit(key.row_limit))  # the same rows for every job of the profile
        out = recommend(profile(df), bulk=True).select(*PROFILE_COLUMNS).select(
            F.lit(key.name).alias("table_key"), F.lit(key.version).alias("version"),
            F.lit(key.row_limit).cast("bigint").alias("row_limit"), "*",
        )
        # A folder per key, so threads do not share an output folder and a repeated run replaces its own.
        path = f"{folder}/profiles/key={key.digest}"
        out.coalesce(1).write.mode("overwrite").parquet(path)
        done = (
            df.sparkSession.read.parquet(path)
            .agg(F.max("total_rows"), F.count(F.lit(1)), F.sum("missing_count"))
            .first()
        )
        return (key.name, key.version, key.row_limit, done[0], done[1], done[2], None)
    except Exception as error:  # one table must not stop the others
        return (key.name, key.version, key.row_limit, None, None, None, str(error).splitlines()[0])


def profile_many(
    spark: SparkSession,
    tables: dict[TableKey, Callable[[], DataFrame]],
    folder: str,
    threads: int = 4,
) -> DataFrame:
    """Profile tables into ``folder/profiles`` and log them in ``folder/profile_runs``; returns the run log."""
    runs_path = f"{folder}/profile_runs"
    names = [(k.name, k.version, k.row_limit) for k in tables]
    wanted = spark.createDataFrame(names, "table_key string, version string, row_limit bigint")
    try:
        finished = spark.read.schema(RUN_SCHEMA).parquet(runs_path).filter("error IS NULL")
        wanted = wanted.join(finished, ["table_key", "version", "row_limit"], "left_anti")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
    left = {tuple(r) for r in wanted.collect()}  # of the tables asked for
    todo = [(k, load) for k, load in tables.items() if (k.name, k.version, k.row_limit) in left]
    with ThreadPoolExecutor(max_workers=threads) as pool:
        rows = list(pool.map(lambda item: _profile_one(item[0], item[1], folder), todo))
    if rows:
        spark.createDataFrame(rows, RUN_SCHEMA).coalesce(1).write.mode("append").parquet(runs_path)
    return spark.read.schema(RUN_SCHEMA).parquet(runs_path)


def cached_profile(spark: SparkSession, key: TableKey, folder: str) -> DataFrame | None:
    """The stored profile of a table, or None where there is none for this version and limit."""
    try:
        return spark.read.parquet(f"{folder}/profiles/key={key.digest}")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None


def collect_all(
    spark: SparkSession, reports: dict[str, Callable[[], DataFrame]], folder: str, threads: int = 4
) -> DataFrame:
    """Write each report to ``folder/<name>``; (report, row_count, error), a failing report being a row with an error.

    Rows are counted from the footers of what was written.
    """

    def run(item: tuple[str, Callable[[], DataFrame]]) -> tuple[str, int | None, str | None]:
        name, report = item
        try:
            report().write.mode("overwrite").parquet(f"{folder}/{name}")
            return name, spark.read.parquet(f"{folder}/{name}").count(), None
        except Exception as error:  # one report must not stop the others
            return name, None, str(error).splitlines()[0]

    with ThreadPoolExecutor(max_workers=threads) as pool:
        rows = list(pool.map(run, reports.items()))
    return spark.createDataFrame(rows, "report string, row_count bigint, error string")
