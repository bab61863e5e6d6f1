"""Sessions, transactions and locks. Every 'now' is an argument, so results can be repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.status import lock_category
from .lists import DATABASE
from .snapshots import on_current

ACTIVE = "active"


def as_of_like(df: DataFrame, column: str, as_of: str) -> Column:
    """A time literal of the same type as a column, so that comparisons push down to the scan."""
    return F.lit(as_of).cast(df.schema[column].dataType)


@on_current
def sessions_by_state(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("server", F.coalesce("state", F.lit("unknown")).alias("state")).agg(
        F.count(F.lit(1)).alias("session_count")
    )


@on_current
def active_sessions(sessions: DataFrame, n: int = 100) -> DataFrame:
    """Active sessions by CPU time."""
    return (
        sessions.filter(F.col("state") == ACTIVE)
        .select(*DATABASE, "session_id", "user_id", "cpu_ms")
        .orderBy(F.desc("cpu_ms"), *DATABASE, "session_id")
        .limit(n)
    )


@on_current
def long_running(sessions: DataFrame, as_of: str, minutes: int = 5, n: int = 100) -> DataFrame:
    """Active sessions started at least ``minutes`` before ``as_of``, oldest first."""
    now = as_of_like(sessions, "start_ts", as_of)
    return (
        sessions.filter((F.col("state") == ACTIVE) & (F.col("start_ts") <= now - F.expr(f"INTERVAL {int(minutes)} MINUTES")))
        .orderBy("start_ts", *DATABASE, "session_id")
        .limit(n)
        .select(*DATABASE, "session_id", "user_id", F.timestamp_diff("SECOND", "start_ts", now).alias("seconds"))
    )


@on_current
def transactions(trx: DataFrame, sessions: DataFrame, as_of: str, n: int = 100) -> DataFrame:
    """Oldest transactions with their age and their session's user."""
    now = as_of_like(trx, "start_ts", as_of)
    oldest = trx.filter(F.col("start_ts") <= now).orderBy("start_ts", *DATABASE, "trx_id").limit(n)
    keys = ["server", "session_id"]
    users = sessions.select(*keys, "user_id", "state").join(oldest.select(*keys).distinct(), keys)
    age = F.timestamp_diff("SECOND", "start_ts", now)
    return oldest.join(users, keys, "left").select(
        *DATABASE, "trx_id", "session_id", "user_id", "state", "rows_locked",
        age.alias("age_seconds"), F.floor(age / 60).cast("bigint").alias("age_minutes"),
    )


@on_current
def locks(lock_rows: DataFrame) -> DataFrame:
    """Locks with a readable category."""
    relation = F.concat_ws(".", "schema_name", "object_name")
    category = lock_category(F.col("lock_type"), F.col("schema_name"), F.when(F.col("object_name").isNotNull(), relation))
    return lock_rows.select(
        *DATABASE, "lock_id", "session_id", "lock_type", "lock_status", category.alias("lock_category")
    )


@on_current
def lock_waits(lock_rows: DataFrame) -> DataFrame:
    """Each waiting lock with the number of other sessions holding the resource and the first of them.

    Holders are combined per resource before the join, so a resource wanted by very many sessions
    gives one row per waiter, not one per pair. A missing ``id1`` or ``id2`` is equal to another one.
    """
    resource = ["server", "id1", "id2"]
    filled = lock_rows.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in resource[1:]})
    holders = filled.filter(F.col("lock_status") == "GRANTED").select(*resource, "session_id").distinct()
    first = holders.groupBy(*resource).agg(F.count("*").alias("holders"), F.min("session_id").alias("first"))
    second = holders.join(first, resource).filter(F.col("session_id") != F.col("first")).groupBy(*resource).agg(F.min("session_id").alias("second"))
    own = holders.select(*resource, "session_id", F.lit(1).alias("holds"))
    waiting = lock_rows.filter(F.col("lock_status") == "WAITING").select(
        "server", "id1", "id2", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"k_{c}") for c in resource[1:]], "lock_id", "session_id"
    )
    keyed = [x.withColumnsRenamed({"id1": "k_id1", "id2": "k_id2"}) for x in (first, second, own)]
    keys = ["server", "k_id1", "k_id2"]
    found = waiting.join(keyed[0], keys).join(keyed[1], keys, "left").join(keyed[2], [*keys, "session_id"], "left")
    count = F.col("holders") - F.coalesce("holds", F.lit(0))
    holder = F.when(F.col("first") == F.col("session_id"), F.col("second")).otherwise(F.col("first"))
    return found.filter(count > 0).select(
        *resource, "lock_id", F.col("session_id").alias("waiting_session"), count.alias("holder_count"), holder.alias("first_holder")
    )


@on_current
def blocking_sessions(sessions: DataFrame) -> DataFrame:
    """Blocked and blocking session of each block. ``blocked_by`` is an array of session ids.

    The blocking side has one row per session, so AQE can split a session that blocks very many.
    """
    blocked = sessions.filter("size(blocked_by) > 0").select(
        "server", F.col("session_id").alias("blocked_session"), F.col("user_id").alias("blocked_user"),
        F.explode("blocked_by").alias("blocking_session"),
    )
    blocking = sessions.select(
        "server", F.col("session_id").alias("blocking_session"), F.col("user_id").alias("blocking_user"),
        F.col("state").alias("blocking_state"),
    )
    return blocked.join(blocking, ["server", "blocking_session"])
