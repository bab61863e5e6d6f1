"""The catalogue and telemetry reports by name, for running all of them over a set of fact tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import partial
from typing import Callable

from pyspark.sql import DataFrame

from ..plans.materialize import materialize
from . import catalogue as C
from . import kpi as K
from . import operations as O
from . import relations as L
from . import sessions as N
from . import storage as G
from . import workload as M
from .lists import DATABASE
from .snapshots import SNAPSHOT, current, history, of_state

# name -> (operator, facts it reads)
REPORTS: dict[str, tuple[Callable[..., DataFrame], list[str]]] = {
    "database_sizes": (G.database_sizes, ["databases", "tables"]),
    "table_storage": (G.table_storage, ["tables"]),
    "data_vs_index": (G.data_vs_index, ["tables"]),
    "top_largest": (G.top_largest, ["tables"]),
    "row_counts": (G.row_counts, ["tables"]),
    "storage_by_engine": (G.storage_by_group, ["tables"]),
    "storage_by_tablespace": (partial(G.storage_by_group, key="tablespace"), ["tables"]),
    "capacity_used": (G.capacity_used, ["volumes"]),
    "partition_counts": (G.partition_counts, ["partitions"]),
    "partition_detail": (G.partition_detail, ["partitions"]),
    "large_unpartitioned": (G.large_unpartitioned, ["tables", "partitions"]),
    "fragmentation": (G.fragmentation, ["tables"]),
    "fragmented_indexes": (G.fragmented_indexes, ["index_columns"]),
    "archival_candidates": (G.archival_candidates, ["tables", "object_io"]),
    "limited_usage": (G.limited_usage, ["tables", "object_io"]),
    "hot_tables": (G.hot_tables, ["object_io"]),
    "stale_statistics": (G.stale_statistics, ["tables"]),
    "modified_since_statistics": (G.modified_since_statistics, ["tables", "object_io"]),
    "object_inventory": (G.object_inventory, ["tables"]),
    "namespaces": (G.list_namespaces, ["tables"]),
    "table_list": (G.list_tables, ["tables"]),
    "parent_tables": (L.parent_tables, ["fk_columns"]),
    "child_tables": (L.child_tables, ["fk_columns"]),
    "independent_tables": (L.independent_tables, ["tables", "fk_columns"]),
    "foreign_keys": (L.foreign_keys, ["fk_columns"]),
    "fk_graph": (L.fk_graph, ["fk_columns"]),
    "many_foreign_keys": (L.many_foreign_keys, ["fk_columns"]),
    "primary_keys": (L.primary_keys, ["index_columns"]),
    "tables_without_pk": (L.tables_without_pk, ["tables", "index_columns"]),
    "unique_constraints": (L.unique_constraints, ["index_columns"]),
    "indexes": (L.indexes, ["index_columns"]),
    "index_columns": (L.index_column_list, ["index_columns"]),
    "index_counts": (L.index_counts, ["index_columns"]),
    "largest_indexes": (L.largest_indexes, ["index_columns"]),
    "duplicate_indexes": (L.duplicate_indexes, ["index_columns"]),
    "unused_indexes": (L.unused_indexes, ["index_columns", "object_io"]),
    "index_usage": (L.index_usage, ["index_columns", "object_io"]),
    "tables_without_index": (L.tables_without_index, ["tables", "index_columns"]),
    "disabled_indexes": (L.disabled_indexes, ["index_columns"]),
    "missing_index_candidates": (L.missing_index_candidates, ["object_io"]),
    "data_dictionary": (C.data_dictionary, ["columns"]),
    "large_object_columns": (C.large_object_columns, ["columns"]),
    "json_columns": (C.json_columns, ["columns"]),
    "generated_columns": (C.generated_columns, ["columns"]),
    "auto_increment_columns": (C.auto_increment_columns, ["columns"]),
    "large_varchar_columns": (C.large_varchar_columns, ["columns"]),
    "collation_mix": (C.collation_mix, ["tables"]),
    "documented_tables": (C.documented_tables, ["tables"]),
    "routines": (C.routines, ["objects"]),
    "views": (C.views, ["objects"]),
    "triggers": (C.triggers, ["objects", "tables"]),
    "scheduled_jobs": (C.scheduled_jobs, ["jobs"]),
    "failed_job_runs": (C.failed_job_runs, ["jobs", "job_runs"]),
    "code_dependencies": (C.code_dependencies, ["objects", "tables"]),
    "object_counts": (C.object_counts, ["objects"]),
    "accounts": (C.accounts, ["principals"]),
    "role_members": (C.role_members, ["principals"]),
    "privileges": (C.privileges, ["grants"]),
    "slow_statements": (M.slow_statements, ["statements"]),
    "top_cpu_statements": (M.top_cpu_statements, ["statements"]),
    "high_examined_statements": (M.high_examined_statements, ["statements"]),
    "frequent_statements": (M.frequent_statements, ["statements"]),
    "top_io": (M.top_io, ["statements", "object_io"]),
    "table_io_activity": (M.table_io_activity, ["object_io"]),
    "table_wait_time": (M.table_wait_time, ["object_io"]),
    "top_wait_events": (M.top_wait_events, ["waits"]),
    "temp_usage": (M.temp_usage, ["temp_usage"]),
    "sessions_by_state": (N.sessions_by_state, ["sessions"]),
    "active_sessions": (N.active_sessions, ["sessions"]),
    "blocking_sessions": (N.blocking_sessions, ["sessions"]),
    "locks": (N.locks, ["locks"]),
    "lock_waits": (N.lock_waits, ["locks"]),
    "latest_backups": (O.latest_backups, ["backups"]),
    "database_flags": (O.database_flags, ["databases"]),
    "cpu_kpi": (K.cpu_kpi, ["statements"]),
    "storage_kpi": (K.storage_kpi, ["tables"]),
    "blocked_kpi": (K.blocked_kpi, ["locks"]),
}


#: Facts that are histories: reports read all their records.
HISTORIES = ["backups", "job_runs"]
#: The large facts that many reports group by the same columns or more, stored in buckets of these.
BUCKETS = {"fk_columns": L.CHILD, "index_columns": L.INDEX, "object_io": [*DATABASE, "schema_name", "object_name"]}


def stored_states(facts: dict[str, DataFrame], threads: int = 4) -> dict[str, DataFrame]:
    """Each fact as it stands now, stored once, for many reports to read.

    Which snapshots count and which keys are missing is worked out here once per fact; reports on the result find no snapshot times to look at.
    Facts named in BUCKETS are shuffled here once, by the columns that their reports group by, and not in every report.
    """

    def store(item: tuple[str, DataFrame]) -> tuple[str, DataFrame]:
        name, fact = item
        return name, materialize(history(fact) if name in HISTORIES else current(fact).drop(SNAPSHOT), BUCKETS.get(name))

    with ThreadPoolExecutor(max_workers=threads) as pool:
        return dict(pool.map(store, facts.items()))


def reports(
    facts: dict[str, DataFrame], as_of: str | None = None, settings: dict[str, dict] | None = None, stored: bool = False
) -> dict[str, Callable[[], DataFrame]]:
    """The reports the given facts suffice for, each as a function without arguments. ``settings`` has named arguments by report.

    ``stored`` says that the facts are those of ``stored_states``: keys and flags are not filled in again, which would hide
    from Spark that the rows lie in buckets of them.
    Reports that need a moment in time are left out without ``as_of``. Pass the result to
    ``sources.bulk.collect_all`` to write them all, each on its own.
    """
    ready = {
        name: partial(of_state(run) if stored else run, *[facts[f] for f in needed], **(settings or {}).get(name, {}))
        for name, (run, needed) in REPORTS.items()
        if all(f in facts for f in needed)
    }
    if as_of and "sessions" in facts:
        ready["long_running"] = partial(N.long_running, facts["sessions"], as_of)
        if "transactions" in facts:
            ready["transactions"] = partial(N.transactions, facts["transactions"], facts["sessions"], as_of)
    if as_of and {"databases", "backups"} <= set(facts):
        ready["databases_without_recent_backup"] = partial(
            O.databases_without_recent_backup, facts["databases"], facts["backups"], as_of
        )
    return ready
