"""All catalogue and telemetry reports in one run, counted against the SQL of each."""

from __future__ import annotations

import uuid

from ..operators.fleet import REPORTS, reports, stored_states
from ..sources.bulk import collect_all
from . import catalogue_queries, telemetry_queries  # noqa: F401  (register queries)
from .facts import derived
from .materialize import shared_folder
from .registry import QUERIES, query

# The query whose SQL counts a report, where it is not the report's name after "rel_".
QUERY_OF = dict(pair.split(":") for pair in """
database_sizes:storage_databases table_storage:storage_tables data_vs_index:storage_data_vs_index top_largest:storage_largest row_counts:storage_row_counts
storage_by_engine:storage_by_engine storage_by_tablespace:storage_by_tablespace capacity_used:storage_capacity partition_counts:storage_partitions
partition_detail:storage_partition_detail large_unpartitioned:storage_large_unpartitioned fragmentation:storage_fragmentation
fragmented_indexes:storage_fragmented_indexes archival_candidates:storage_archival limited_usage:storage_limited_usage hot_tables:storage_hot_tables
stale_statistics:storage_stale_statistics modified_since_statistics:storage_modified_statistics object_inventory:storage_inventory
namespaces:storage_namespaces table_list:storage_list_tables indexes:index_list index_columns:index_columns index_counts:index_count
largest_indexes:index_largest duplicate_indexes:index_duplicates unused_indexes:index_unused index_usage:index_usage
tables_without_index:index_missing_tables disabled_indexes:index_disabled missing_index_candidates:index_candidates data_dictionary:column_dictionary
large_object_columns:column_large_objects json_columns:column_json generated_columns:column_generated auto_increment_columns:column_auto_increment
large_varchar_columns:column_large_varchar collation_mix:column_collations documented_tables:column_documented_tables routines:object_routines
views:object_views triggers:object_triggers scheduled_jobs:object_jobs failed_job_runs:object_failed_jobs code_dependencies:object_dependencies
object_counts:object_counts accounts:security_accounts role_members:security_role_members privileges:security_privileges slow_statements:workload_slow
top_cpu_statements:workload_top_cpu high_examined_statements:workload_examined frequent_statements:workload_frequent top_io:workload_top_io
table_io_activity:workload_table_io table_wait_time:workload_table_waits top_wait_events:workload_wait_events temp_usage:workload_temp
sessions_by_state:session_states active_sessions:session_active blocking_sessions:session_blocking locks:session_locks lock_waits:session_lock_waits
latest_backups:ops_latest_backups database_flags:ops_database_flags cpu_kpi:kpi_cpu storage_kpi:kpi_storage blocked_kpi:kpi_blocked
""".split())


def _counts() -> str:
    names = {report: QUERY_OF.get(report, f"rel_{report}") for report in REPORTS}
    return " UNION ALL ".join(f"SELECT '{r}' AS report, (SELECT count(*) FROM ({QUERIES[q].sql}) counted) AS row_count, CAST(NULL AS VARCHAR) AS error" for r, q in names.items())


@query("bulk_all_reports", "R11", _counts())
def bulk_all_reports(spark, folder):
    """Every report of ``operators.fleet`` over facts whose state is stored once: rows and error of each."""
    needed = sorted({fact for _, facts in REPORTS.values() for fact in facts})
    facts = {name: telemetry_queries._sessions(spark, folder) if name == "sessions" else derived(spark, folder, name) for name in needed}
    limits = {"archival_candidates": {"rows": 25, "changes": 8}, "index_counts": {"more_than": 5}}  # those of the queries
    return collect_all(spark, reports(stored_states(facts), settings=limits, stored=True), f"{shared_folder(spark)}/reports-{uuid.uuid4().hex}", threads=8)
