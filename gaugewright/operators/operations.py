"""Configuration, backups and database flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import CONFIGURATION_LISTS
from .lists import DATABASE
from .sessions import as_of_like
from .snapshots import on_current

FULL_BACKUP = "D"
BACKUP_LABELS = {"D": "Full", "I": "Differential", "L": "Log"}


@on_current
def config_assessment(settings: DataFrame, allowed: str | list[str]) -> DataFrame:
    """Allow-listed parameters with their rank in the list."""
    names = CONFIGURATION_LISTS[allowed] if isinstance(allowed, str) else allowed
    ranks = settings.sparkSession.createDataFrame(
        [(name, i) for i, name in enumerate(names, start=1)], "name string, rank int"
    )
    # The allow-list is a constant of a few names.
    return (
        settings.withColumn("__key", F.lower("name"))
        .join(F.broadcast(ranks.select(F.lower("name").alias("__key"), "rank")), "__key")
        .select("server", "name", "value", "rank")
    )


@on_current(histories=("backups",))
def databases_without_recent_backup(databases: DataFrame, backups: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Databases whose last full backup is missing or older than ``days``."""
    last = (
        backups.filter(F.col("backup_type") == FULL_BACKUP)
        .groupBy(*DATABASE)
        .agg(F.max("finish_ts").alias("last_full_backup"))
    )
    limit = as_of_like(backups, "finish_ts", as_of) - F.expr(f"INTERVAL {int(days)} DAYS")
    return (
        databases.select(*DATABASE).distinct()
        .join(last, DATABASE, "left")
        .filter(F.col("last_full_backup").isNull() | (F.col("last_full_backup") < limit))
    )


@on_current(histories=("backups",))
def latest_backups(backups: DataFrame, n: int = 200) -> DataFrame:
    """The latest backups with a label of their type."""
    label = F.col("backup_type")
    for code, name in BACKUP_LABELS.items():
        label = F.when(F.col("backup_type") == code, F.lit(name)).otherwise(label)
    return (
        backups.select(*DATABASE, "finish_ts", label.alias("backup_kind"), "bytes")
        .orderBy(F.desc("finish_ts"), *DATABASE, "backup_kind", "bytes")
        .limit(n)
    )


@on_current
def database_flags(databases: DataFrame) -> DataFrame:
    """State, recovery and housekeeping flags of each database."""
    return databases.select(
        *DATABASE, "state", "recovery_model", "compatibility", "owner", "auto_close", "auto_shrink",
        "log_reuse_wait", "query_store_state",
    )
