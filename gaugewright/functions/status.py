"""Status bands, wait and lock categories, and the system-schema filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fixed_values import SYSTEM_SCHEMA_PREFIX, SYSTEM_SCHEMAS
from .text import title_word

SEVERITY_RANK = {"Healthy": 0, "Normal": 0, "Unavailable": 0, "Elevated": 1, "Needs Attention": 1, "High": 2, "Critical": 3}

# Upper limits (exclusive) of the bands of a metric, and the name above the last.
_BANDS = {
    "cpu": ([(60.0, "Normal"), (80.0, "Elevated"), (90.0, "High")], "Critical"),
    "connection_pct": ([(60.0, "Normal"), (80.0, "Elevated"), (90.0, "High")], "Critical"),
    "iops": ([(3000.0, "Healthy"), (6000.0, "Elevated")], "High"),
}


def status_band(metric: str, value: Column) -> Column:
    """Status name of a metric value. Unknown metrics are Normal; no value is Unavailable."""
    if metric in _BANDS:
        limits, above = _BANDS[metric]
        band = F.lit(above)
        for limit, name in reversed(limits):
            band = F.when(value < limit, F.lit(name)).otherwise(band)
    elif metric == "cache":
        band = (
            F.when(value >= 98.0, F.lit("Healthy"))
            .when(value >= 90.0, F.lit("Elevated"))
            .otherwise(F.lit("Needs Attention"))
        )
    elif metric == "blocking":
        band = (
            F.when(value == 0, F.lit("Normal")).when(value <= 5, F.lit("Elevated")).otherwise(F.lit("Critical"))
        )
    else:
        band = F.lit("Normal")
    return F.when(value.isNull(), F.lit("Unavailable")).otherwise(band)


def severity(status: Column) -> Column:
    """Rank of a status name, 0 (fine) to 3 (critical)."""
    rank = F.lit(0)
    for name, value in SEVERITY_RANK.items():
        rank = F.when(status == name, F.lit(value)).otherwise(rank)
    return rank


def _own_name(name: Column, platforms: list[str]) -> Column:
    names = sorted({n.lower() for p in platforms for n in SYSTEM_SCHEMAS[p]})
    own = F.lower(name).isin(names)
    return own | name.startswith(SYSTEM_SCHEMA_PREFIX) if "postgres" in platforms else own


def is_user_schema(schema: Column, platform: Column | None = None) -> Column:
    """True for schemas and databases that do not belong to the server itself.

    ``platform`` names the server's kind (mysql, postgres, oracle, sqlserver); only that kind's names
    then count. Without it, or where it is not known, the names of all kinds do. A missing name is a user's.
    """
    own = _own_name(schema, list(SYSTEM_SCHEMAS))
    if platform is not None:
        for kind in SYSTEM_SCHEMAS:
            own = F.when(F.lower(platform) == kind, _own_name(schema, [kind])).otherwise(own)
    return ~F.coalesce(own, F.lit(False))


def is_user_table(rows: DataFrame) -> Column:
    """True for rows of schemas and databases that are not the servers' own, by the fact's ``platform`` if it has one."""
    platform = F.col("platform") if "platform" in rows.columns else None
    return is_user_schema(F.col("schema_name"), platform) & is_user_schema(F.col("database_name"), platform)


def wait_category(event: Column) -> Column:
    """Second part of a slash-separated event name, else General."""
    part = F.split_part(event, F.lit("/"), F.lit(2))
    return F.when(F.contains(event, F.lit("/")), title_word(part)).otherwise(F.lit("General"))


def lock_category(lock_type: Column, schema: Column, relation: Column) -> Column:
    """Readable category of a lock."""
    on_relation = lock_type == "relation"
    return (
        F.when(lock_type == "virtualxid", F.lit("VirtualXID (Default Session Lock)"))
        .when(lock_type == "transactionid", F.lit("TransactionID (Row/Txn Lock)"))
        .when(on_relation & schema.isin("pg_catalog", "information_schema"), F.lit("System Relation (Catalog Lock)"))
        .when(on_relation, F.concat(F.lit("User Relation ("), F.coalesce(relation, F.lit("N/A")), F.lit(")")))
        .otherwise(F.initcap(lock_type))
    )
