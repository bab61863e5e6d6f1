"""Queries of the workload, session, operations, KPI, trend and scalar operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import status as T
from ..functions import text as X
from ..functions.fixed_values import BENIGN_WAITS
from ..functions.wording import (
    BLOCKED_NEVER, BLOCKED_NOW, CPU_RULES, CPU_STATE, IO_RULES, QUERY_STATE, TABLE_STATE, TOP_CACHE, TOP_CPU, TOP_IO, TOP_TABLE, TOP_WAITS, WAIT_STATE, sentence_sql,
)
from ..operators import kpi as K
from ..operators import operations as O
from ..operators import sessions as N
from ..operators import storage as G
from ..operators import trends as R
from ..operators import workload as M
from .catalogue_queries import PLACE, TABLE, USER_TABLES, big, day, user
from .facts import derived, source
from .registry import query, rnd

AS_OF = "2024-01-31 00:00:00"
STATEMENT = f"{PLACE}, query_id"


def cut_sql(c: str, n: int) -> str:
    return f"CASE WHEN length({c}) > {n} THEN left({c}, {n}) || '...' ELSE {c} END"


def share(value: str, alias: str) -> str:
    return f"{rnd(f'coalesce(CAST({value} AS DOUBLE) / nullif(CAST(sum({value}) OVER () AS DOUBLE), 0), 0.0) * 100.0', 1)} AS {alias}"


def _top(measure: str, n: int, where: str = "true") -> str:
    return f"(SELECT * FROM fact_statements WHERE {where} ORDER BY {measure} DESC, {STATEMENT} LIMIT {n})"


# --- workload -----------------------------------------------------------------------------------------


@query("workload_slow", "M1 X5", f"""
SELECT {STATEMENT}, query_text, {cut_sql('query_text', 60)} AS query_label, calls, {rnd('total_ms / 1000.0', 4)} AS total_seconds,
 {rnd('total_ms / 1000.0 / CAST(calls AS DOUBLE)', 6)} AS avg_seconds, {big('rows_examined')} AS rows_examined, {big('rows_sent')} AS rows_sent
 FROM {_top('total_ms', 50, 'total_ms >= 10')} t""")
def workload_slow(spark, folder):
    return M.slow_statements(derived(spark, folder, "statements"))


@query("workload_top_cpu", "M2 R7", f"""
SELECT {STATEMENT}, query_text, calls, {rnd('total_ms', 2)} AS cpu_ms, {rnd('total_ms / CAST(calls AS DOUBLE)', 2)} AS mean_ms, {share('total_ms', 'cpu_pct')}
 FROM {_top('total_ms', 10)} t""")
def workload_top_cpu(spark, folder):
    return M.top_cpu_statements(derived(spark, folder, "statements"))


@query("workload_examined", "M3", f"""
SELECT {STATEMENT}, query_text, {cut_sql('query_text', 60)} AS query_label, calls, rows_examined, {rnd('CAST(rows_examined AS DOUBLE) / CAST(calls AS DOUBLE)', 2)} AS avg_rows_examined
 FROM {_top('rows_examined', 50)} t""")
def workload_examined(spark, folder):
    return M.high_examined_statements(derived(spark, folder, "statements"))


@query("workload_frequent", "M4", f"SELECT {STATEMENT}, query_text, {cut_sql('query_text', 60)} AS query_label, calls FROM {_top('calls', 50)} t")
def workload_frequent(spark, folder):
    return M.frequent_statements(derived(spark, folder, "statements"))


@query("workload_top_io", "M5 R7", f"""
SELECT {PLACE}, query_text AS entity, {big('reads + writes')} AS io_operations, 'statement' AS source, {share('(reads + writes)', 'io_pct')}
 FROM {_top('(reads + writes)', 10, 'reads + writes > 0')} t""")
def workload_top_io(spark, folder):
    return M.top_io(derived(spark, folder, "statements"), derived(spark, folder, "object_io"))


_OBJECT = f"{PLACE}, schema_name, object_name"


@query("workload_top_io_tables", "M5 R7", f"""
SELECT {PLACE}, schema_name || '.' || object_name AS entity, io_operations, 'table' AS source, {share('io_operations', 'io_pct')}
 FROM (SELECT {_OBJECT}, {big('sum(reads + writes)')} AS io_operations FROM fact_object_io GROUP BY {_OBJECT} ORDER BY 5 DESC, {_OBJECT} LIMIT 10) t""")
def workload_top_io_tables(spark, folder):
    silent = derived(spark, folder, "statements").withColumns({"reads": F.lit(0), "writes": F.lit(0)})
    return M.top_io(silent, derived(spark, folder, "object_io"))


@query("workload_table_io", "M6", f"""
SELECT {_OBJECT}, {big('sum(reads)')} AS reads, {big('sum(writes)')} AS writes, {big('sum(inserts)')} AS inserts, {big('sum(updates)')} AS updates, {big('sum(deletes)')} AS deletes
 FROM fact_object_io GROUP BY {_OBJECT} ORDER BY sum(reads) + sum(writes) DESC, {_OBJECT} LIMIT 100""")
def workload_table_io(spark, folder):
    return M.table_io_activity(derived(spark, folder, "object_io"))


_WAIT = rnd("CAST(sum(CAST(wait_ms AS DECIMAL(28,4))) AS DOUBLE)", 4)


@query("workload_table_waits", "M7", f"""
SELECT {_OBJECT}, {big('sum(reads + writes)')} AS operations, {_WAIT} AS wait_ms FROM fact_object_io GROUP BY {_OBJECT} ORDER BY 6 DESC, {_OBJECT} LIMIT 50""")
def workload_table_waits(spark, folder):
    return M.table_wait_time(derived(spark, folder, "object_io"))


_BENIGN = "(" + ", ".join(f"'{w}'" for w in BENIGN_WAITS) + ")"
_TOP_WAITS = f"""(SELECT wait_event, {big('sum(wait_count)')} AS wait_count, {rnd('CAST(sum(CAST(wait_ms AS DECIMAL(28,4))) AS DOUBLE)', 2)} AS wait_ms FROM fact_waits
 WHERE wait_class <> 'Idle' AND NOT starts_with(wait_event, 'idle') AND wait_event NOT IN {_BENIGN} GROUP BY wait_event ORDER BY 3 DESC, 1 LIMIT 10)"""


@query("workload_wait_events", "M8 R7 X10", f"""
SELECT wait_event, wait_count, wait_ms, {share('wait_ms', 'wait_pct')}, upper(left(split_part(wait_event, '/', 2), 1)) || lower(substr(split_part(wait_event, '/', 2), 2)) AS wait_category FROM {_TOP_WAITS} w""")
def workload_wait_events(spark, folder):
    return M.top_wait_events(derived(spark, folder, "waits"))


@query("workload_waiting_sessions", "M8", f"""
SELECT wait_category, wait_event, wait_count, {share('wait_count', 'wait_pct')} FROM (SELECT coalesce(state, 'Other') AS wait_category, event_type AS wait_event, count(*) AS wait_count
 FROM (SELECT event_type, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'Lock' END AS state FROM events WHERE event_id % 4 = 0) e GROUP BY ALL ORDER BY 3 DESC, 1, 2 LIMIT 10) t""")
def workload_waiting_sessions(spark, folder):
    events = source(spark, folder, "events")
    sessions = events.select(
        F.when(F.col("event_id") % 4 == 0, F.lit("active")).otherwise(F.lit("idle")).alias("state"),
        F.when(F.col("event_id") % 3 != 0, F.lit("Lock")).alias("wait_class"),
        F.col("event_type").alias("wait_event"),
    )
    return M.waiting_sessions(sessions)


_CACHE = f"""(SELECT server, hit_count, miss_count, {rnd('CAST(hit_count AS DOUBLE) / nullif(CAST(hit_count + miss_count AS DOUBLE), 0) * 100.0', 1)} AS hit_pct
 FROM (SELECT server, {big("sum(value) FILTER (WHERE metric = 'blocks_hit')")} AS hit_count, {big("sum(value) FILTER (WHERE metric = 'blocks_read')")} AS miss_count FROM fact_counters GROUP BY server) c)"""


@query("workload_cache", "M9", f"""
SELECT server, hit_count, miss_count, hit_pct, {rnd('100.0 - hit_pct', 1)} AS miss_pct,
 CASE WHEN hit_pct >= 95 THEN 'Healthy' WHEN hit_pct >= 85 THEN 'Elevated' ELSE 'Needs Attention' END AS status FROM {_CACHE} c""")
def workload_cache(spark, folder):
    return M.cache_efficiency(derived(spark, folder, "counters"))


@query("workload_activity", "M10", f"SELECT {PLACE}, " + ", ".join(
    big(f"coalesce(sum(value) FILTER (WHERE metric = '{m}'), 0)") + f" AS {m}" for m in M.ACTIVITY
) + f" FROM fact_counters GROUP BY {PLACE}")
def workload_activity(spark, folder):
    return M.activity_profile(derived(spark, folder, "counters"))


@query("workload_temp", "M11", f"SELECT {PLACE}, {big('sum(bytes)')} AS temp_bytes, {big('sum(files)')} AS temp_files FROM fact_temp_usage GROUP BY {PLACE} HAVING sum(bytes) > 0 OR sum(files) > 0")
def workload_temp(spark, folder):
    return M.temp_usage(derived(spark, folder, "temp_usage"))


# --- sessions -----------------------------------------------------------------------------------------


def _sessions(spark, folder):
    blocked = F.when(F.col("blocked_by").isNotNull(), F.array("blocked_by"))
    return derived(spark, folder, "sessions").withColumn("blocked_by", blocked)


@query("session_states", "N1", "SELECT server, coalesce(state, 'unknown') AS state, count(*) AS session_count FROM fact_sessions GROUP BY ALL")
def session_states(spark, folder):
    return N.sessions_by_state(_sessions(spark, folder))


@query("session_active", "N2", f"SELECT {PLACE}, session_id, user_id, cpu_ms FROM fact_sessions WHERE state = 'active' ORDER BY cpu_ms DESC, {PLACE}, session_id LIMIT 100")
def session_active(spark, folder):
    return N.active_sessions(_sessions(spark, folder))


@query("session_long_running", "N3 X9", f"""
SELECT {PLACE}, session_id, user_id, date_sub('second', start_ts, TIMESTAMP '2024-01-15 00:00:00') AS seconds FROM fact_sessions
 WHERE state = 'active' AND start_ts <= TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 5 MINUTE ORDER BY start_ts, {PLACE}, session_id LIMIT 100""")
def session_long_running(spark, folder):
    return N.long_running(_sessions(spark, folder), "2024-01-15 00:00:00")


@query("session_transactions", "N4 X9", f"""
SELECT t.server, t.database_name, trx_id, t.session_id, s.user_id, s.state, rows_locked, date_sub('second', t.start_ts, TIMESTAMP '{AS_OF}') AS age_seconds,
 date_sub('second', t.start_ts, TIMESTAMP '{AS_OF}') // 60 AS age_minutes FROM (SELECT * FROM fact_transactions ORDER BY start_ts, {PLACE}, trx_id LIMIT 100) t
 LEFT JOIN fact_sessions s ON s.server = t.server AND s.session_id = t.session_id""")
def session_transactions(spark, folder):
    return N.transactions(derived(spark, folder, "transactions"), _sessions(spark, folder), AS_OF)


@query("session_locks", "N5 X11", f"""
SELECT {PLACE}, lock_id, session_id, lock_type, lock_status, CASE WHEN lock_type = 'virtualxid' THEN 'VirtualXID (Default Session Lock)'
 WHEN lock_type = 'transactionid' THEN 'TransactionID (Row/Txn Lock)' WHEN lock_type = 'relation' AND schema_name IN ('pg_catalog', 'information_schema') THEN 'System Relation (Catalog Lock)'
 WHEN lock_type = 'relation' THEN 'User Relation (' || coalesce(schema_name || '.' || object_name, 'N/A') || ')' ELSE upper(left(lock_type, 1)) || lower(substr(lock_type, 2)) END AS lock_category FROM fact_locks""")
def session_locks(spark, folder):
    return N.locks(derived(spark, folder, "locks"))


@query("session_lock_waits", "N5", """
SELECT w.server, w.id1, w.id2, w.lock_id, w.session_id AS waiting_session, count(DISTINCT h.session_id) AS holder_count, min(h.session_id) AS first_holder
 FROM fact_locks w JOIN fact_locks h ON h.server = w.server AND h.id1 IS NOT DISTINCT FROM w.id1 AND h.id2 IS NOT DISTINCT FROM w.id2 AND h.session_id <> w.session_id AND h.lock_status = 'GRANTED'
 WHERE w.lock_status = 'WAITING' GROUP BY ALL""")
def session_lock_waits(spark, folder):
    return N.lock_waits(derived(spark, folder, "locks"))


@query("session_blocking", "N6", """
SELECT b.server, b.session_id AS blocked_session, b.user_id AS blocked_user, k.session_id AS blocking_session, k.user_id AS blocking_user, k.state AS blocking_state
 FROM fact_sessions b JOIN fact_sessions k ON k.server = b.server AND k.session_id = b.blocked_by""")
def session_blocking(spark, folder):
    return N.blocking_sessions(_sessions(spark, folder))


# --- operations ---------------------------------------------------------------------------------------


@query("ops_configuration", "O1", """
SELECT server, name, value, CAST(rank AS INTEGER) AS rank FROM fact_settings JOIN (VALUES ('max_connections', 1), ('shared_buffers', 2), ('effective_cache_size', 3), ('work_mem', 4), ('maintenance_work_mem', 5),
 ('wal_buffers', 6), ('checkpoint_timeout', 7), ('max_wal_size', 8), ('random_page_cost', 9), ('effective_io_concurrency', 10)) a(n, rank) ON n = name""")
def ops_configuration(spark, folder):
    return O.config_assessment(derived(spark, folder, "settings"), "postgres")


@query("ops_backup_recency", "O2", f"""
SELECT d.server, d.database_name, strftime(max(finish_ts), '%Y-%m-%d') AS last_full_backup FROM fact_backup_databases d LEFT JOIN fact_backups b
 ON b.server = d.server AND b.database_name = d.database_name AND backup_type = 'D' GROUP BY d.server, d.database_name
 HAVING max(finish_ts) IS NULL OR max(finish_ts) < TIMESTAMP '1998-01-01 00:00:00' - INTERVAL 7 DAY""")
def ops_backup_recency(spark, folder):
    found = O.databases_without_recent_backup(
        derived(spark, folder, "backup_databases"), derived(spark, folder, "backups"), "1998-01-01 00:00:00"
    )
    return found.withColumn("last_full_backup", day("last_full_backup"))


_KIND = "CASE backup_type WHEN 'D' THEN 'Full' WHEN 'I' THEN 'Differential' ELSE 'Log' END"


@query("ops_latest_backups", "O2", f"""
SELECT {PLACE}, strftime(finish_ts, '%Y-%m-%d') AS finish_ts, {_KIND} AS backup_kind, bytes FROM fact_backups ORDER BY fact_backups.finish_ts DESC, {PLACE}, {_KIND}, bytes LIMIT 200""")
def ops_latest_backups(spark, folder):
    return O.latest_backups(derived(spark, folder, "backups")).withColumn("finish_ts", day("finish_ts"))


@query("ops_database_flags", "O3", f"""
SELECT {PLACE}, state, recovery_model, CAST(compatibility AS BIGINT) AS compatibility, owner, auto_close, auto_shrink, log_reuse_wait, query_store_state FROM fact_databases""")
def ops_database_flags(spark, folder):
    return O.database_flags(derived(spark, folder, "databases"))


# --- KPIs ---------------------------------------------------------------------------------------------


def _three(v: str) -> str:
    return f"CASE WHEN {v} < 60 THEN 'Normal' WHEN {v} < 80 THEN 'Elevated' ELSE 'Critical' END"


def _four(v: str) -> str:
    return f"CASE WHEN {v} < 60 THEN 'Normal' WHEN {v} < 80 THEN 'Elevated' WHEN {v} < 90 THEN 'High' ELSE 'Critical' END"


_CPU = f"""(SELECT server, {rnd('least(100.0, greatest(0.5, CAST(sum(CAST(total_ms AS DECIMAL(28,4))) AS DOUBLE) / 1000.0 / 10.0))', 1)} AS value FROM
 (SELECT *, row_number() OVER (PARTITION BY server ORDER BY total_ms DESC, database_name, query_id) AS rn FROM fact_statements) s WHERE rn <= 10 GROUP BY server)"""


@query("kpi_cpu", "P1", f"SELECT server, value, {_three('value')} AS status FROM {_CPU} c")
def kpi_cpu(spark, folder):
    return K.cpu_kpi(derived(spark, folder, "statements"))


_DAY = f"ts >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR AND ts < TIMESTAMP '{AS_OF}'"
_BUCKET = f"CAST(floor(date_sub('microsecond', TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR, ts) / 7200000000.0) AS INTEGER)"


@query("kpi_iops", "P2 R1", f"""
SELECT server, {rnd('arg_max(total, bucket) / 7200.0', 4)} AS value, {rnd('max(total) / 7200.0', 4)} AS peak, {rnd('sum(total) / (12.0 * 7200.0)', 4)} AS avg, 'Healthy' AS status
 FROM (SELECT server, {_BUCKET} AS bucket, {rnd('sum(value)', 2)} AS total FROM fact_metric_samples WHERE {_DAY} AND metric IN ('click', 'view') GROUP BY ALL) b GROUP BY server""")
def kpi_iops(spark, folder):
    return K.iops_kpi(derived(spark, folder, "metric_samples"), "24h", AS_OF, ["click", "view"])


@query("kpi_connections", "P3 R1", f"""
SELECT *, {_four('used_pct')} AS status FROM (SELECT server, used, max_connections, {rnd('CAST(used AS DOUBLE) / nullif(CAST(max_connections AS DOUBLE), 0) * 100.0', 1)} AS used_pct FROM
 (SELECT server, {big("sum(value) FILTER (WHERE metric = 'commits')")} AS used, {big("sum(value) FILTER (WHERE metric = 'blocks_hit')")} AS max_connections FROM fact_counters GROUP BY server) c) d""")
def kpi_connections(spark, folder):
    return K.connections_kpi(derived(spark, folder, "counters"), "commits", "blocks_hit")


_RATE = "sum(step) / greatest(1, date_sub('second', min(ts), max(ts)))"


@query("kpi_qps", "P4 X7", f"""
SELECT server, qps, CASE WHEN floor(qps * 3600) >= 1e6 THEN {rnd('floor(qps * 3600) / 1e6', 2)} || 'M' WHEN floor(qps * 3600) >= 1e3 THEN {rnd('floor(qps * 3600) / 1e3', 1)} || 'K'
 ELSE CAST(CAST(floor(qps * 3600) AS BIGINT) AS VARCHAR) END AS total_queries FROM (SELECT server, {rnd(_RATE, 1)} AS qps FROM
 (SELECT server, ts, CASE WHEN before IS NULL THEN 0 WHEN v >= before THEN v - before ELSE v END AS step FROM
 (SELECT server, ts, CAST(round(value * 1000) AS BIGINT) AS v, lag(CAST(round(value * 1000) AS BIGINT)) OVER (PARTITION BY server ORDER BY ts) AS before FROM fact_metric_samples WHERE metric = 'click') a) b GROUP BY server) c""")
def kpi_qps(spark, folder):
    samples = derived(spark, folder, "metric_samples").withColumn("value", F.round(F.col("value") * 1000).cast("double"))
    return K.qps_kpi(samples, "click", "1h")


_FOOTPRINT = f"CASE WHEN b / 1048576.0 >= 1024 THEN {rnd('b / 1048576.0 / 1024.0', 2)} || ' GB' WHEN b > 0 THEN {rnd('b / 1048576.0', 2)} || ' MB' ELSE '0.00 MB' END"
_SIZE_TEXT = "CASE WHEN b / 1048576.0 >= 1024 THEN printf('%.2f GB', b / 1048576.0 / 1024.0) ELSE printf('%.2f MB', b / 1048576.0) END"


@query("kpi_storage", "P5", f"SELECT server, {big('b')} AS total_bytes, table_count, {_FOOTPRINT} AS size_text FROM (SELECT server, CAST(sum(data_bytes + index_bytes) AS DOUBLE) AS b, count(*) AS table_count FROM {USER_TABLES} t GROUP BY server) s")
def kpi_storage(spark, folder):
    return K.storage_kpi(derived(spark, folder, "tables"))


@query("kpi_storage_growth", "P5", f"SELECT {PLACE}, snapshot_year, bytes, table_count, bytes - lag(bytes) OVER (PARTITION BY {PLACE} ORDER BY snapshot_year) AS growth_bytes FROM fact_storage_snapshots")
def kpi_storage_growth(spark, folder):
    return K.storage_growth(derived(spark, folder, "storage_snapshots"), "snapshot_year")


@query("kpi_storage_total", "R9", f"SELECT {big('b')} AS total_bytes, {_FOOTPRINT} AS size_text FROM (SELECT CAST(sum(data_bytes + index_bytes) AS DOUBLE) AS b FROM {USER_TABLES} t WHERE {user('database_name')}) s")
def kpi_storage_total(spark, folder):
    return K.storage_total(derived(spark, folder, "tables"))


@query("kpi_storage_active", "R9", f"SELECT {big('b')} AS total_bytes, {_FOOTPRINT} AS size_text FROM (SELECT CAST(sum(data_bytes + index_bytes) AS DOUBLE) AS b FROM {USER_TABLES} t WHERE database_name = 'db3') s")
def kpi_storage_active(spark, folder):
    return K.storage_total(derived(spark, folder, "tables"), "DB3")


_BLOCKED = "(SELECT server, count(*) FILTER (WHERE lock_status = 'WAITING') AS blocked FROM fact_locks GROUP BY server)"


@query("kpi_blocked", "P6 R1", f"""
SELECT server, blocked, blocked AS peak, CASE WHEN blocked = 0 THEN 'No Blocking' ELSE blocked || ' Sessions Blocked' END AS status_text,
 CASE WHEN blocked = 0 THEN 'Normal' WHEN blocked <= 5 THEN 'Elevated' ELSE 'Critical' END AS status FROM {_BLOCKED} b""")
def kpi_blocked(spark, folder):
    return K.blocked_kpi(derived(spark, folder, "locks"))


_PERIOD = "TIMESTAMP '2024-01-05 00:00:00'", f"TIMESTAMP '{AS_OF}'"


@query("kpi_blocked_peak", "P6 N6", f"""
WITH w AS (
 SELECT server, greatest(start_ts, {_PERIOD[0]}) AS s, end_ts AS e FROM fact_waiting_times
 WHERE (end_ts IS NULL OR end_ts > start_ts) AND (end_ts IS NULL OR end_ts > {_PERIOD[0]}) AND start_ts < {_PERIOD[1]}),
 c AS (SELECT a.server, a.s, count(*) AS n FROM (SELECT DISTINCT server, s FROM w) a JOIN w b ON a.server = b.server AND b.s <= a.s AND (b.e IS NULL OR b.e > a.s) GROUP BY a.server, a.s),
 m AS (SELECT server, max(n) AS n, arg_min(s, struct_pack(a := -n, b := s)) AS first_at FROM c GROUP BY server)
SELECT server, blocked, greatest(blocked, coalesce(n, 0)) AS peak, first_at AS peak_at, CASE WHEN blocked = 0 THEN 'No Blocking' ELSE blocked || ' Sessions Blocked' END AS status_text,
 CASE WHEN blocked = 0 THEN 'Normal' WHEN blocked <= 5 THEN 'Elevated' ELSE 'Critical' END AS status FROM {_BLOCKED} b LEFT JOIN m USING (server)""")
def kpi_blocked_peak(spark, folder):
    return K.blocked_over_period(derived(spark, folder, "locks"), derived(spark, folder, "waiting_times"), "2024-01-05 00:00:00", AS_OF)


@query("kpi_deadlocks", "P7", f"""
SELECT server, d AS deadlocks, CASE WHEN d = 0 THEN 'Normal' ELSE 'Critical' END AS status, CASE WHEN d = 0 THEN 'Zero Contention' ELSE d || ' Deadlock Event(s)' END AS status_text
 FROM (SELECT server, {big("coalesce(sum(value) FILTER (WHERE metric = 'deadlocks'), 0)")} AS d FROM fact_counters GROUP BY server) c""")
def kpi_deadlocks(spark, folder):
    return K.deadlock_kpi(derived(spark, folder, "counters"))


# --- trends -------------------------------------------------------------------------------------------

_POINTS = f"""(SELECT server, metric, {_BUCKET} AS bucket, count(*) AS samples, {rnd('avg(value)', 1)} AS value, {rnd('sum(value)', 2)} AS total
 FROM fact_metric_samples WHERE {_DAY} GROUP BY server, metric, {_BUCKET})"""
_TREND = f"""(SELECT server, metric, arg_max(value, bucket) AS current, {rnd('CAST(sum(CAST(value AS DECIMAL(28,2))) AS DOUBLE) / count(value)', 1)} AS avg, max(value) AS peak, min(value) AS min, arg_min(value, bucket) AS start,
 strftime(TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR + to_hours(2 * arg_min(bucket, {{'v': -value, 'b': bucket}})), '%H:%M') AS peak_time FROM {_POINTS} p GROUP BY server, metric)"""
_CHANGE = f"(SELECT *, CASE WHEN start > 0 THEN {rnd('(current - start) / greatest(1.0, start) * 100.0', 1)} ELSE 0.0 END AS pct_change FROM {_TREND} t)"


@query("trend_points", "R2", f"SELECT * FROM {_POINTS} p")
def trend_points(spark, folder):
    return R.trend_points(derived(spark, folder, "metric_samples"), "24h", AS_OF).drop("bucket_start")


@query("trend_metric", "R2", f"SELECT *, (SELECT string_agg(CAST(value AS VARCHAR), ' ' ORDER BY bucket) FROM {_POINTS} p WHERE p.server = t.server AND p.metric = t.metric) AS values FROM {_TREND} t")
def trend_metric(spark, folder):
    trend = R.metric_trend(derived(spark, folder, "metric_samples"), "24h", AS_OF)
    return trend.withColumn("values", F.concat_ws(" ", F.col("values").cast("array<string>")))


@query("trend_change", "R3", f"SELECT server, metric, start, current, pct_change FROM {_CHANGE} t")
def trend_change(spark, folder):
    trend = R.trend_change(R.metric_trend(derived(spark, folder, "metric_samples"), "24h", AS_OF))
    return trend.select("server", "metric", "start", "current", "pct_change")


def _rules_sql(tests: list[str], templates: dict[int, str], values: dict[str, str]) -> str:
    """The first rule that fits, and its sentence."""
    rule = " ".join(f"WHEN {t} THEN {k}" for k, t in enumerate(tests, start=1))
    text = " ".join(f"WHEN {t} THEN {sentence_sql(templates[k], **values)}" for k, t in enumerate(tests, start=1))
    return f"CASE {rule} END AS rule, CASE {text} END AS insight"


_PERIOD = "'last 24 hours'"
_TREND_VALUES = {n: n for n in ("current", "avg", "peak", "start", "peak_time")} | {"period": _PERIOD, "change": "pct_change", "drop": "abs(pct_change)"}
_CPU_TESTS = ["peak >= 80 AND current >= 60", "current - start >= 8", "start - current >= 8", "peak - avg >= 12", "avg < 35", "true"]
_IO_TESTS = ["avg > 0 AND peak >= floor(avg * 1.35)", "pct_change >= 15", "pct_change <= -15", "current > 3000", "avg > 4000", "true"]


@query("trend_insight_cpu", "R4", f"SELECT server, metric, {_rules_sql(_CPU_TESTS, CPU_RULES, _TREND_VALUES)} FROM {_TREND} t")
def trend_insight_cpu(spark, folder):
    trend = R.metric_trend(derived(spark, folder, "metric_samples"), "24h", AS_OF)
    return R.cpu_insight(trend, "24h").select("server", "metric", "rule", "insight")


@query("trend_insight_io", "R4", f"SELECT server, metric, {_rules_sql(_IO_TESTS, IO_RULES, _TREND_VALUES)} FROM {_CHANGE} t")
def trend_insight_io(spark, folder):
    trend = R.trend_change(R.metric_trend(derived(spark, folder, "metric_samples"), "24h", AS_OF))
    return R.io_insight(trend, "24h").select("server", "metric", "rule", "insight")


@query("trend_rw_split", "R5", f"""
SELECT server, bucket, {big('o')} AS operations, {big('r')} AS read_operations, {big('o - r')} AS write_operations FROM (SELECT server, bucket, o, round_even(o * ratio, 0) AS r FROM
 (SELECT server, bucket, round_even(reads + writes, 0) AS o, sum(reads) OVER w / nullif(sum(reads + writes) OVER w, 0) AS ratio FROM
 (SELECT server, bucket, coalesce(sum(total) FILTER (WHERE metric = 'click'), 0.0) AS reads, coalesce(sum(total) FILTER (WHERE metric = 'view'), 0.0) AS writes FROM {_POINTS} p
 WHERE metric IN ('click', 'view') GROUP BY server, bucket) t WINDOW w AS (PARTITION BY server)) u) v""")
def trend_rw_split(spark, folder):
    return R.read_write_split(derived(spark, folder, "metric_samples"), "24h", AS_OF, "click", "view")


_WORST = "greatest(CASE WHEN blocked > 5 THEN 3 WHEN blocked > 0 THEN 2 ELSE 0 END, CASE WHEN value < 60 THEN 0 WHEN value < 80 THEN 1 WHEN value < 90 THEN 2 ELSE 3 END)"


_TOP_QUERY = f"(SELECT * FROM (SELECT server, query_text, {rnd('total_ms', 2)} AS cpu_ms, row_number() OVER (PARTITION BY server ORDER BY total_ms DESC, database_name, query_id) AS k FROM fact_statements) q WHERE k = 1)"
_TOP_WAIT = """(SELECT server, wait_event FROM (SELECT server, wait_event, row_number() OVER (PARTITION BY server ORDER BY ms DESC, wait_event) AS k FROM
 (SELECT server, wait_event, sum(CAST(wait_ms AS DECIMAL(28,4))) AS ms FROM fact_waits WHERE wait_class <> 'Idle' GROUP BY server, wait_event) w) x WHERE k = 1)"""
_TOP_TABLE = f"(SELECT server, table_name, CAST(data_bytes + index_bytes AS DOUBLE) AS b FROM (SELECT *, row_number() OVER (PARTITION BY server ORDER BY data_bytes + index_bytes DESC, {TABLE}) AS k FROM {USER_TABLES} t) x WHERE k = 1)"


@query("health_summary", "R6 R1", f"""
SELECT server, CASE {_WORST} WHEN 3 THEN 'Critical' WHEN 2 THEN 'High' WHEN 1 THEN 'Elevated' ELSE 'Healthy' END AS overall_status,
 concat_ws(' / ', CASE WHEN blocked > 0 THEN {sentence_sql(BLOCKED_NOW, blocked='blocked', peak='blocked', period=_PERIOD)} ELSE {sentence_sql(BLOCKED_NEVER, period=_PERIOD)} END,
 {sentence_sql(CPU_STATE, status=f"lower({_four('value')})", cpu='value', avg='value', peak='value', period=_PERIOD)},
 {sentence_sql(QUERY_STATE, query="left(query_text, 30) || '...'", ms="format('{:,.2f}', cpu_ms)", period=_PERIOD)},
 {sentence_sql(WAIT_STATE, event='wait_event', period=_PERIOD)}, {sentence_sql(TABLE_STATE, table='table_name', size=_SIZE_TEXT, period=_PERIOD)}) AS findings
 FROM {_CPU} c FULL JOIN {_BLOCKED} b USING (server) LEFT JOIN {_TOP_QUERY} q USING (server) LEFT JOIN {_TOP_WAIT} w USING (server) LEFT JOIN {_TOP_TABLE} l USING (server)""")
def health_summary(spark, folder):
    statements, waits, tables = (derived(spark, folder, n) for n in ("statements", "waits", "tables"))
    cpu = K.cpu_kpi(statements).select("server", "value", F.col("value").alias("avg"), F.col("value").alias("peak"))
    found = R.health_summary(
        cpu, K.blocked_kpi(derived(spark, folder, "locks")), "24h",
        M.top_statement_per_server(statements), M.top_wait_per_server(waits), G.largest_per_server(tables),
    )
    return found.withColumn("findings", F.array_join("findings", " / "))


@query("insight_text", "R8 R10", f"""
SELECT 'cpu' AS topic, {sentence_sql(TOP_CPU, query="left(query_text, 30) || '...'", ms="format('{:,.2f}', total_ms)", share='cpu_pct', calls="format('{:,}', calls)")} AS insight
 FROM (SELECT *, {share('total_ms', 'cpu_pct')} FROM {_top('total_ms', 10)} t ORDER BY total_ms DESC, query_id LIMIT 1) a
UNION ALL SELECT 'io', {sentence_sql(TOP_IO, entity="left(query_text, 30) || '...'", operations="format('{:,}', o)", share='io_pct')}
 FROM (SELECT *, {big('reads + writes')} AS o, {share('(reads + writes)', 'io_pct')} FROM {_top('(reads + writes)', 10)} t ORDER BY reads + writes DESC, query_text LIMIT 1) b
UNION ALL SELECT 'waits', {sentence_sql(TOP_WAITS, first='max(wait_event) FILTER (k = 1)', first_share='max(wait_pct) FILTER (k = 1)', second='max(wait_event) FILTER (k = 2)', second_share='max(wait_pct) FILTER (k = 2)', period=_PERIOD)}
 FROM (SELECT *, {share('wait_ms', 'wait_pct')}, row_number() OVER (ORDER BY wait_ms DESC, wait_event) AS k FROM {_TOP_WAITS} w) c
UNION ALL SELECT 'cache', {sentence_sql(TOP_CACHE, server='server', hit='hit_pct', miss=rnd('100.0 - hit_pct', 1))}
 FROM (SELECT * FROM {_CACHE} c ORDER BY hit_pct, server LIMIT 1) d
UNION ALL SELECT 'tables', {sentence_sql(TOP_TABLE, table="schema_name || '.' || table_name", size=_SIZE_TEXT)} FROM (SELECT *, CAST(data_bytes + index_bytes AS DOUBLE) AS b FROM {USER_TABLES} t ORDER BY b DESC, {TABLE} LIMIT 1) e""")
def insight_text(spark, folder):
    statements, io = derived(spark, folder, "statements"), derived(spark, folder, "object_io")
    return R.top_insights(
        M.top_cpu_statements(statements), M.top_io(statements, io), M.top_wait_events(derived(spark, folder, "waits")),
        M.cache_efficiency(derived(spark, folder, "counters")), G.top_largest(derived(spark, folder, "tables"), 10), "24h",
    )


@query("status_bands", "R1", f"""
SELECT event_id, {_four('value')} AS cpu, CASE WHEN value >= 98 THEN 'Healthy' WHEN value >= 90 THEN 'Elevated' ELSE 'Needs Attention' END AS cache,
 CASE WHEN event_id % 8 = 0 THEN 'Normal' WHEN event_id % 8 <= 5 THEN 'Elevated' ELSE 'Critical' END AS blocking,
 CASE WHEN event_id < 3000 THEN 'Healthy' WHEN event_id < 6000 THEN 'Elevated' ELSE 'High' END AS iops, 'Normal' AS other FROM events""")
def status_bands(spark, folder):
    value = F.col("value")
    return source(spark, folder, "events").select(
        "event_id", T.status_band("cpu", value).alias("cpu"), T.status_band("cache", value).alias("cache"),
        T.status_band("blocking", F.col("event_id") % 8).alias("blocking"),
        T.status_band("iops", F.col("event_id")).alias("iops"), T.status_band("unknown", value).alias("other"),
    )


# --- scalar expressions -------------------------------------------------------------------------------

_BYTES = "CAST(floor(p_retailprice * power(10, p_size % 13)) AS BIGINT)"


@query("scalar_size", "X1 X2 X8", f"""
SELECT p_partkey, CASE WHEN v < 1024 THEN v || ' B' WHEN v < 1048576 THEN printf('%.2f KB', v / 1024.0) WHEN v < 1073741824 THEN printf('%.2f MB', v / 1048576.0)
 WHEN v < 1099511627776 THEN printf('%.2f GB', v / 1073741824.0) WHEN v < 1125899906842624 THEN printf('%.2f TB', v / 1099511627776.0) ELSE printf('%.2f PB', v / 1125899906842624.0) END AS size_text,
 printf('%.2f', price) || ' MB' AS numeric_text, {rnd('CAST(v AS DOUBLE) / 1048576.0', 2)} AS megabytes, {rnd('CAST(p_size AS DOUBLE) * 8.0 / 1024.0', 2)} AS pages_mb
 FROM (SELECT p_partkey, p_size, p_retailprice AS price, {_BYTES} AS v FROM part) p""")
def scalar_size(spark, folder):
    size = F.floor(F.col("p_retailprice") * F.pow(F.lit(10.0), F.col("p_size") % 13)).cast("bigint")
    return source(spark, folder, "part").select(
        "p_partkey", X.format_size(size).alias("size_text"),
        X.format_numeric(F.concat(F.col("p_retailprice").cast("string"), F.lit(" MB"))).alias("numeric_text"),
        X.in_unit(size, 2).alias("megabytes"), X.pages_to_mb(F.col("p_size")).alias("pages_mb"),
    )


@query("scalar_parse_size", "X3 X6", f"""
SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN price * 1024.0 WHEN 1 THEN price WHEN 2 THEN price * (1.0 / 1024.0) WHEN 3 THEN price * 1048576.0 WHEN 4 THEN 0.0 ELSE price END AS megabytes,
 CAST(regexp_replace(p_brand, '[^0-9]', '', 'g') AS BIGINT) AS brand_number, coalesce(TRY_CAST(CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE p_type END AS DOUBLE), 0.0) AS coerced
 FROM (SELECT *, p_retailprice AS price FROM part) p""")
def scalar_parse_size(spark, folder):
    price = F.col("p_retailprice").cast("string")
    units = {0: " GB", 1: " MB", 2: "KB", 3: " tb"}
    text = price
    for k, unit in units.items():
        text = F.when(F.col("p_size") % 6 == k, F.concat(price, F.lit(unit))).otherwise(text)
    text = F.when(F.col("p_size") % 6 == 4, F.lit("-")).otherwise(text)
    mixed = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.col("p_type"))
    return source(spark, folder, "part").select(
        "p_partkey", X.parse_size_mb(text).alias("megabytes"), X.digits_only(F.col("p_brand")).alias("brand_number"),
        X.coerce_number(mixed).alias("coerced"),
    )


_LABEL = r"trim(regexp_replace(trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(39) || chr(34)), '[ \t\n\r]+', ' ', 'g'))"


@query("scalar_label", "X4 X5 X12", f"SELECT doc_id, CASE WHEN text = '' THEN 'N/A' WHEN length({_LABEL}) > 35 THEN left({_LABEL}, 35) || '...' ELSE {_LABEL} END AS label, {cut_sql('text', 200)} AS start FROM documents")
def scalar_label(spark, folder):
    return source(spark, folder, "documents").select(
        "doc_id", X.clean_label(F.col("text")).alias("label"), X.cut(F.col("text"), 200).alias("start")
    )


@query("scalar_abbrev", "X7", f"""
SELECT o_orderkey, CASE WHEN o_totalprice * 10 >= 1e6 THEN {rnd('o_totalprice * 10 / 1e6', 2)} || 'M' WHEN o_totalprice * 10 >= 1e3 THEN {rnd('o_totalprice * 10 / 1e3', 1)} || 'K'
 ELSE CAST(CAST(floor(o_totalprice * 10) AS BIGINT) AS VARCHAR) END AS short, format('{{:,}}', CAST(floor(o_totalprice) AS BIGINT)) AS long FROM orders""")
def scalar_abbrev(spark, folder):
    return source(spark, folder, "orders").select(
        "o_orderkey", X.short_count(F.col("o_totalprice") * 10).alias("short"),
        X.thousands(F.floor("o_totalprice")).alias("long"),
    )


@query("scalar_age", "X9", "SELECT o_orderkey, date_sub('second', o_orderdate, TIMESTAMP '2000-01-01 00:00:00') AS age_seconds, o_orderdate >= TIMESTAMP '2000-01-01 00:00:00' - INTERVAL 700 DAY AS is_recent FROM orders")
def scalar_age(spark, folder):
    orders = source(spark, folder, "orders")
    now = N.as_of_like(orders, "o_orderdate", "2000-01-01 00:00:00")
    return orders.select(
        "o_orderkey", X.seconds_between(F.col("o_orderdate"), now).alias("age_seconds"),
        (F.col("o_orderdate") >= now - F.expr("INTERVAL 700 DAYS")).alias("is_recent"),
    )


@query("scalar_definition", "X13", "SELECT p_partkey, 'CREATE INDEX ON ' || replace(p_name, ' ', '_') || ' (c)' AS definition FROM part")
def scalar_definition(spark, folder):
    unique = F.when(F.col("p_size") % 2 == 0, F.lit("UNIQUE ")).otherwise(F.lit(""))
    ddl = F.concat(
        F.lit("CREATE "), unique, F.lit("INDEX ix"), F.col("p_partkey").cast("string"), F.lit(" ON "),
        F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(" (c)"),
    )
    return source(spark, folder, "part").select("p_partkey", X.bare_definition(ddl).alias("definition"))
