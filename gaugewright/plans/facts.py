"""The snapshot fact tables the catalogue and telemetry operators read.

``SCHEMAS`` is the input contract. ``DERIVED`` fills the same columns from a star schema with plain
SQL, for trying the operators where no snapshots of real servers are at hand; the work grows with
the source tables. ``VIEWS`` are the profiled tables with missing and dirty values put in.
"""

from __future__ import annotations

from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

_PLACE = "server string, database_name string, snapshot_ts timestamp"

SCHEMAS = {
    "databases": f"{_PLACE}, state string, recovery_model string, compatibility int, owner string, auto_close boolean, "
    "auto_shrink boolean, log_reuse_wait string, query_store_state string",
    "tables": f"{_PLACE}, schema_name string, table_name string, table_type string, engine string, tablespace string, "
    "row_count bigint, data_bytes bigint, index_bytes bigint, free_bytes bigint, live_tuples bigint, dead_tuples bigint, "
    "create_time timestamp, update_time timestamp, last_analyzed timestamp, collation string, comment string",
    "columns": f"{_PLACE}, schema_name string, table_name string, column_name string, position int, data_type string, "
    "char_length bigint, num_precision int, num_scale int, nullable boolean, default_value string, key string, "
    "extra string, generation_expr string, charset string, collation string, check_expr string",
    "index_columns": f"{_PLACE}, schema_name string, table_name string, index_name string, column_name string, "
    "position int, is_unique boolean, is_primary boolean, is_disabled boolean, index_type string, index_bytes bigint, "
    "fragmentation_pct double, page_count bigint",
    "fk_columns": f"{_PLACE}, constraint_name string, child_schema string, child_table string, child_column string, "
    "parent_schema string, parent_table string, parent_column string, position int",
    "partitions": f"{_PLACE}, schema_name string, table_name string, partition_name string, position int, "
    "row_count bigint, data_bytes bigint, index_bytes bigint",
    "objects": f"{_PLACE}, schema_name string, object_name string, object_type string, table_name string, body string, "
    "created timestamp, altered timestamp, is_extension boolean",
    "jobs": f"{_PLACE}, job_name string, enabled boolean, schedule string, owner string",
    "job_runs": f"{_PLACE}, job_name string, run_ts timestamp, status int, message string",
    "principals": f"{_PLACE}, name string, type string, is_disabled boolean, role string",
    "grants": f"{_PLACE}, grantee string, privilege string, object_name string, grantable boolean",
    "statements": f"{_PLACE}, query_id bigint, query_text string, calls bigint, total_ms double, rows_examined bigint, "
    "rows_sent bigint, reads bigint, writes bigint",
    "object_io": f"{_PLACE}, schema_name string, object_name string, index_name string, reads bigint, writes bigint, "
    "inserts bigint, updates bigint, deletes bigint, wait_ms double",
    "waits": f"{_PLACE}, session_id bigint, wait_class string, wait_event string, wait_count bigint, wait_ms double",
    "sessions": f"{_PLACE}, session_id bigint, user_id bigint, state string, start_ts timestamp, cpu_ms double, "
    "blocked_by array<bigint>",
    "transactions": f"{_PLACE}, trx_id bigint, session_id bigint, start_ts timestamp, rows_locked bigint",
    "locks": f"{_PLACE}, lock_id bigint, session_id bigint, lock_type string, lock_status string, id1 bigint, id2 bigint, "
    "schema_name string, object_name string",
    "metric_samples": f"{_PLACE}, ts timestamp, metric string, value double",
    "settings": f"{_PLACE}, name string, value string, unit string",
    "volumes": f"{_PLACE}, name string, total_bytes bigint, used_bytes bigint",
    "backups": f"{_PLACE}, backup_type string, start_ts timestamp, finish_ts timestamp, bytes bigint",
    "temp_usage": f"{_PLACE}, session_id bigint, bytes bigint, files bigint",
}

# Where an object of the derived facts lives follows from its number, so that both ends of a
# foreign key are in one database.
_SERVER = "concat('srv', CAST({0} % 4 AS string))"
_DATABASE = "concat('db', CAST({0} % 8 AS string))"
_SCHEMA = "CASE WHEN {0} % 97 = 0 THEN 'information_schema' ELSE concat('s', CAST({0} % 2 AS string)) END"


def _place(n: str) -> str:
    return f"{_SERVER.format(n)} AS server, {_DATABASE.format(n)} AS database_name"


VIEWS = {
    "orders_missing": """
SELECT o_orderkey, nullif(o_orderstatus, 'P') AS o_orderstatus,
 CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
 CASE WHEN o_orderkey % 7 = 0 THEN 'N/A' ELSE o_orderpriority END AS o_orderpriority,
 CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderdate END AS o_orderdate FROM orders""",
    "dirty_customer": """
SELECT CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE c_custkey END AS cust_id,
 CASE WHEN c_custkey % 9 = 0 THEN concat(' ', c_name) WHEN c_custkey % 11 = 0 THEN concat(c_name, chr(9)) ELSE c_name END AS c_name,
 CASE WHEN c_custkey % 4 = 0 THEN CAST(c_custkey AS string) ELSE c_mktsegment END AS mixed, c_acctbal FROM customer""",
    "typed_strings": """
SELECT o_orderkey AS row_id, CAST(CAST(o_orderdate AS date) AS string) AS d, CAST(o_orderkey AS string) AS num,
 CASE WHEN o_orderkey % 2 = 0 THEN 'Y' ELSE 'N' END AS flag,
 CASE o_orderkey % 3 WHEN 0 THEN 'Gold' WHEN 1 THEN 'Silver' ELSE 'bronze' END AS tier, o_orderpriority AS nominal FROM orders""",
    "labelled_documents": """
SELECT d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
}

DERIVED = {
    "databases": f"""
SELECT {_SERVER.format('k')} AS server, concat('db', CAST(k % 16 AS string)) AS database_name,
 CASE WHEN sum(n) % 7 = 0 THEN 'RESTORING' ELSE 'ONLINE' END AS state,
 CASE WHEN k % 3 = 0 THEN 'SIMPLE' ELSE 'FULL' END AS recovery_model, 150 - (k % 16) AS compatibility,
 concat('u', CAST(k % 5 AS string)) AS owner, k % 4 = 1 AS auto_close, k % 4 = 2 AS auto_shrink,
 CASE WHEN sum(n) % 2 = 0 THEN 'NOTHING' ELSE 'LOG_BACKUP' END AS log_reuse_wait,
 CASE WHEN k % 2 = 0 THEN 'READ_WRITE' ELSE 'OFF' END AS query_store_state
 FROM (SELECT l_orderkey % 16 AS k, 1 AS n FROM lineitem) b GROUP BY k""",
    "tables": f"""
SELECT {_place('p_partkey')}, {_SCHEMA.format('p_partkey')} AS schema_name,
 concat('t', CAST(p_partkey AS string)) AS table_name,
 CASE WHEN p_size % 9 = 0 THEN 'VIEW' ELSE 'BASE TABLE' END AS table_type,
 CASE WHEN p_size % 5 = 0 THEN 'engine_b' ELSE 'engine_a' END AS engine,
 CASE WHEN p_size % 3 = 0 THEN NULL ELSE concat('ts', CAST(p_size % 4 AS string)) END AS tablespace,
 CASE WHEN p_size % 10 = 0 THEN NULL ELSE coalesce(l.n, 0) END AS row_count,
 coalesce(l.n, 0) * 8192 AS data_bytes, CAST(p_size AS bigint) * 4096 AS index_bytes,
 coalesce(l.n, 0) * (p_size % 4) * 512 AS free_bytes,
 coalesce(l.n, 0) AS live_tuples, CAST(p_size % 7 AS bigint) AS dead_tuples,
 l.first_ts AS create_time, CASE WHEN p_size % 6 = 0 THEN NULL ELSE l.last_ts END AS update_time,
 CASE WHEN p_size % 8 < 4 THEN NULL ELSE l.last_ts END AS last_analyzed,
 CASE WHEN p_size % 4 = 0 THEN 'latin1' ELSE 'utf8' END AS collation,
 CASE WHEN p_size % 11 = 0 THEN p_name WHEN p_size % 2 = 0 THEN '' ELSE NULL END AS comment
 FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, min(l_shipdate) AS first_ts, max(l_shipdate) AS last_ts
 FROM lineitem GROUP BY l_partkey) l ON l.l_partkey = p_partkey""",
    "partitions": f"""
SELECT {_place('l_partkey')}, {_SCHEMA.format('l_partkey')} AS schema_name,
 concat('t', CAST(l_partkey AS string)) AS table_name, concat('p', CAST(year(l_shipdate) AS string)) AS partition_name,
 year(l_shipdate) - 1990 AS position, count(*) AS row_count, count(*) * 8192 AS data_bytes, count(*) * 1024 AS index_bytes
 FROM lineitem WHERE l_partkey % 3 <> 0 GROUP BY l_partkey, year(l_shipdate)""",
    "fk_columns": f"""
SELECT {_place('c')}, concat('fk_', CAST(c AS string), '_', CAST(p AS string)) AS constraint_name,
 concat('s', CAST(c % 2 AS string)) AS child_schema, concat('t', CAST(c AS string)) AS child_table,
 concat('c', CAST(k AS string)) AS child_column,
 concat('s', CAST(p % 2 AS string)) AS parent_schema, concat('t', CAST(p AS string)) AS parent_table,
 concat('k', CAST(k AS string)) AS parent_column, k AS position
 FROM (SELECT DISTINCT l_partkey AS c, l_suppkey * 8 + l_partkey % 8 AS p, 1 + l_linenumber % 2 AS k FROM lineitem
 WHERE l_partkey % 16 < 8) e WHERE c <> p""",
    "index_columns": f"""
SELECT {_place('t')}, concat('s', CAST(t % 2 AS string)) AS schema_name, concat('t', CAST(t AS string)) AS table_name,
 concat('ix', CAST(i AS string)) AS index_name, concat('c', CAST(k + i % 3 AS string)) AS column_name, k AS position,
 i % 5 = 0 AS is_unique, i % 20 = 0 AS is_primary, i % 50 = 1 AS is_disabled,
 CASE WHEN i % 7 = 0 THEN 'HASH' ELSE 'BTREE' END AS index_type, (i % 1000) * 8192 AS index_bytes,
 CAST(i % 100 AS double) AS fragmentation_pct, i % 3000 AS page_count
 FROM (SELECT DISTINCT l_orderkey AS i, l_orderkey % 500 AS t, l_linenumber AS k FROM lineitem) e""",
    "object_io": f"""
SELECT {_place('l_partkey')}, {_SCHEMA.format('l_partkey')} AS schema_name,
 concat('t', CAST(l_partkey AS string)) AS object_name,
 CASE WHEN l_linenumber < 3 THEN NULL ELSE concat('ix', CAST(l_partkey + 500 * (l_linenumber % 5) AS string)) END AS index_name,
 sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END) AS reads,
 sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS writes,
 sum(CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 1 ELSE 0 END) AS inserts,
 sum(CASE WHEN l_linestatus = 'O' AND l_returnflag = 'R' AND l_linenumber > 4 THEN 1 ELSE 0 END) AS updates,
 sum(CASE WHEN l_linestatus = 'O' AND l_returnflag = 'R' AND l_linenumber <= 4 THEN 1 ELSE 0 END) AS deletes,
 round(CAST(sum(CAST(l_discount AS decimal(18,4))) AS double), 4) AS wait_ms
 FROM lineitem WHERE l_partkey % 6 <> 0 GROUP BY l_partkey,
 CASE WHEN l_linenumber < 3 THEN NULL ELSE concat('ix', CAST(l_partkey + 500 * (l_linenumber % 5) AS string)) END""",
    "statements": f"""
SELECT {_place('l_suppkey')}, l_suppkey AS query_id,
 concat('select * from supplier where k = ', CAST(l_suppkey AS string), ' and flag in (A, N, R) order by 1') AS query_text,
 count(*) AS calls, round(CAST(sum(CAST(l_extendedprice AS decimal(18,2))) AS double), 2) AS total_ms,
 CAST(sum(CAST(l_quantity AS bigint)) AS bigint) AS rows_examined,
 sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS rows_sent,
 sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END) AS reads, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS writes
 FROM lineitem GROUP BY l_suppkey""",
    "waits": f"""
SELECT {_place('user_id')}, user_id AS session_id, CASE WHEN event_type = 'view' THEN 'Idle' ELSE 'Concurrency' END AS wait_class,
 concat('wait/', event_type, '/', CAST(user_id % 5 AS string)) AS wait_event, count(*) AS wait_count,
 round(CAST(sum(CAST(value AS decimal(18,2))) AS double), 2) AS wait_ms FROM events GROUP BY user_id, event_type""",
    "sessions": f"""
SELECT {_SERVER.format('0')} AS server, {_DATABASE.format('user_id')} AS database_name, event_id AS session_id, user_id,
 CASE WHEN event_id % 29 = 0 THEN NULL WHEN event_type = 'click' THEN 'active' ELSE event_type END AS state, ts AS start_ts, value AS cpu_ms,
 CASE WHEN event_id % 17 = 0 AND event_id > 0 THEN event_id - 1 WHEN event_id % 19 = 0 THEN 1 END AS blocked_by FROM events""",
    "transactions": f"""
SELECT {_SERVER.format('0')} AS server, {_DATABASE.format('user_id')} AS database_name, event_id + 1000000 AS trx_id,
 event_id AS session_id, ts AS start_ts, user_id * 3 AS rows_locked FROM events WHERE event_type <> 'error'""",
    "locks": f"""
SELECT {_SERVER.format('user_id')} AS server, {_DATABASE.format('user_id')} AS database_name, event_id AS lock_id,
 user_id AS session_id, event_id % 97 AS id1, user_id % 3 AS id2,
 CASE event_type WHEN 'click' THEN 'relation' WHEN 'view' THEN 'virtualxid' WHEN 'error' THEN 'transactionid' ELSE event_type END AS lock_type,
 CASE WHEN event_id % 23 = 0 THEN 'WAITING' ELSE 'GRANTED' END AS lock_status,
 CASE WHEN event_id % 5 = 0 THEN 'pg_catalog' ELSE 's1' END AS schema_name,
 CASE WHEN event_id % 7 = 0 THEN NULL ELSE concat('t', CAST(event_id % 97 AS string)) END AS object_name FROM events""",
    "waiting_times": f"""
SELECT {_SERVER.format('user_id')} AS server, event_id AS lock_id, ts AS start_ts,
 CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN ts WHEN 2 THEN ts + INTERVAL 7 MINUTE WHEN 3 THEN ts + INTERVAL 95 MINUTE ELSE ts + INTERVAL 31 HOUR END AS end_ts
 FROM events WHERE event_id % 3 <> 0""",
    "metric_samples": f"""
SELECT {_SERVER.format('user_id')} AS server, ts, event_type AS metric, value FROM events""",
    "counters": f"""
SELECT {_SERVER.format('user_id')} AS server, {_DATABASE.format('user_id')} AS database_name,
 CASE event_type WHEN 'click' THEN 'commits' WHEN 'view' THEN 'rollbacks' WHEN 'purchase' THEN 'blocks_read'
 WHEN 'signup' THEN 'blocks_hit' ELSE 'deadlocks' END AS metric,
 CAST(sum(CAST(floor(value * 100) AS bigint)) AS bigint) AS value FROM events GROUP BY user_id, event_type""",
    "backups": f"""
SELECT {_SERVER.format('o_custkey')} AS server, concat('db', CAST(o_custkey % 500 AS string)) AS database_name,
 o_orderdate AS finish_ts, CASE o_orderstatus WHEN 'F' THEN 'D' WHEN 'O' THEN 'L' ELSE 'I' END AS backup_type,
 CAST(floor(o_totalprice) AS bigint) AS bytes FROM orders""",
    "backup_databases": f"""
SELECT DISTINCT {_SERVER.format('c_custkey')} AS server, concat('db', CAST(c_custkey % 700 AS string)) AS database_name FROM customer""",
    "columns": f"""
SELECT {_place('p_partkey')}, {_SCHEMA.format('p_partkey')} AS schema_name,
 concat('t', CAST(p_partkey AS string)) AS table_name, concat('c', CAST(p_size AS string)) AS column_name, p_size AS position,
 CASE p_size % 6 WHEN 0 THEN 'json' WHEN 1 THEN 'text' WHEN 2 THEN 'blob' WHEN 3 THEN 'varchar' ELSE 'int' END AS data_type,
 CASE WHEN p_size % 6 = 3 THEN p_size * 10 END AS char_length, p_size % 2 = 0 AS nullable,
 CASE WHEN p_size % 12 = 4 THEN 'auto_increment' ELSE '' END AS extra,
 CASE WHEN p_size % 13 = 0 THEN concat('c1 + ', CAST(p_size AS string)) ELSE '' END AS generation_expr,
 CASE WHEN p_size % 6 = 4 THEN p_size % 10 + 5 END AS num_precision, CASE WHEN p_size % 12 = 4 THEN 0 WHEN p_size % 6 = 4 THEN 2 END AS num_scale,
 CASE WHEN p_size % 5 = 0 THEN concat('d', CAST(p_size AS string)) END AS default_value, CASE WHEN p_size % 7 = 0 THEN 'PRI' WHEN p_size % 7 = 1 THEN 'MUL' ELSE '' END AS key,
 CASE WHEN p_size % 6 = 1 THEN 'utf8mb4' END AS charset, CASE WHEN p_size % 6 = 1 THEN 'utf8' END AS collation,
 CASE WHEN p_size % 6 = 2 THEN 'c IS JSON' END AS check_expr FROM part""",
    "objects": f"""
SELECT {_place('n')}, concat('s', CAST(n % 2 AS string)) AS schema_name, concat('r', CAST(n AS string)) AS object_name,
 CASE n % 5 WHEN 0 THEN 'VIEW' WHEN 1 THEN 'PROCEDURE' WHEN 2 THEN 'FUNCTION' WHEN 3 THEN 'TRIGGER' ELSE 'MATERIALIZED VIEW' END AS object_type,
 CASE WHEN n % 5 = 3 THEN concat('t', CAST(n + 8 AS string)) END AS table_name,
 concat('select * from T', CAST(n + 8 AS string), ' join t', CAST((n + 16) * 2 AS string), ' on a.t', CAST(n AS string), '=1') AS body,
 n % 10 = 2 AS is_extension FROM (SELECT c_custkey AS n FROM customer) o""",
    "jobs": f"""
SELECT {_place('s_suppkey')}, concat('job', CAST(s_suppkey AS string)) AS job_name, s_suppkey % 4 <> 0 AS enabled,
 CASE WHEN s_suppkey % 2 = 0 THEN 'daily' ELSE 'hourly' END AS schedule, concat('u', CAST(s_nationkey AS string)) AS owner FROM supplier""",
    "job_runs": f"""
SELECT {_place('l_suppkey')}, concat('job', CAST(l_suppkey AS string)) AS job_name, l_shipdate AS run_ts,
 CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE CASE WHEN l_linenumber = 7 THEN 3 ELSE 1 END END AS status,
 concat('run ', CAST(l_orderkey AS string), '/', CAST(l_linenumber AS string)) AS message FROM lineitem""",
    "principals": f"""
SELECT {_place('c_custkey')}, c_name AS name, CASE WHEN c_custkey % 6 = 0 THEN 'ROLE' ELSE 'USER' END AS type,
 c_custkey % 9 = 0 AS is_disabled, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS role FROM customer""",
    "grants": f"""
SELECT {_place('c_custkey')}, concat('u', CAST(c_custkey % 40 AS string)) AS grantee, c_mktsegment AS privilege,
 concat('t', CAST(c_nationkey AS string)) AS object_name, c_custkey % 3 = 0 AS grantable FROM customer""",
    "settings": """
SELECT concat('srv', CAST(c_custkey % 50 AS string)) AS server,
 CASE c_nationkey % 8 WHEN 0 THEN 'max_connections' WHEN 1 THEN 'shared_buffers' WHEN 2 THEN 'work_mem' WHEN 3 THEN 'wal_buffers'
 WHEN 4 THEN 'max_wal_size' WHEN 5 THEN 'random_page_cost' WHEN 6 THEN 'log_level' ELSE 'timezone' END AS name,
 CAST(max(c_custkey) AS string) AS value FROM customer GROUP BY c_custkey % 50,
 CASE c_nationkey % 8 WHEN 0 THEN 'max_connections' WHEN 1 THEN 'shared_buffers' WHEN 2 THEN 'work_mem' WHEN 3 THEN 'wal_buffers'
 WHEN 4 THEN 'max_wal_size' WHEN 5 THEN 'random_page_cost' WHEN 6 THEN 'log_level' ELSE 'timezone' END""",
    "volumes": f"""
SELECT {_SERVER.format('c_custkey')} AS server, concat('vol', CAST(c_custkey AS string)) AS name,
 CASE WHEN c_custkey % 25 = 0 THEN 0 ELSE (c_custkey % 100 + 1) * 1000000 END AS total_bytes,
 CASE WHEN c_custkey % 25 = 0 THEN 0 ELSE (c_custkey % (c_custkey % 100 + 1)) * 900000 END AS used_bytes FROM customer""",
    "temp_usage": f"""
SELECT {_place('user_id')}, user_id AS session_id, CAST(sum(CASE WHEN event_type = 'error' THEN event_id ELSE 0 END) AS bigint) * 1024 AS bytes,
 sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS files FROM events GROUP BY user_id""",
    "storage_snapshots": f"""
SELECT {_SERVER.format('o_custkey')} AS server, {_DATABASE.format('o_custkey')} AS database_name,
 CAST(year(o_orderdate) AS int) AS snapshot_year, CAST(sum(CAST(floor(o_totalprice) AS bigint)) AS bigint) * 1024 AS bytes, count(*) AS table_count
 FROM orders GROUP BY o_custkey % 4, o_custkey % 8, year(o_orderdate)""",
}


#: Facts that are a history in themselves.
SERIES = ["metric_samples", "storage_snapshots", "waiting_times"]
#: Histories of records that every snapshot repeats.
RECORDS = ["backups", "job_runs"]
#: Whether derived facts carry older snapshots.
HISTORY: ContextVar[bool] = ContextVar("HISTORY", default=False)


def read_sources(spark: SparkSession, folder: str) -> None:
    """Register the source tables of a folder as temporary views."""
    for name in SOURCES:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)


def source(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def derived(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A fact table or profiled view derived from the sources."""
    text = VIEWS.get(name) or DERIVED[name]
    for table in SOURCES:
        if table in text:
            source(spark, folder, table).createOrReplaceTempView(table)
    found = spark.sql(text)
    if not HISTORY.get() or name not in DERIVED or name in SERIES:
        return found
    return with_repeats(found) if name in RECORDS else with_history(found)


def with_facts(sql: str) -> str:
    """A query over derived facts as self-contained SQL, the facts it names in front as CTEs."""
    every = {**VIEWS, **{f"fact_{k}": v for k, v in DERIVED.items()}}
    used = [name for name in every if name in sql]
    if not used:
        return sql
    head = ", ".join(f"{name} AS ({every[name]})" for name in sorted(used))
    body = sql.strip()
    return f"WITH {head}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {head} {body}"


def with_history(fact: DataFrame) -> DataFrame:
    """A derived fact as the latest of three collection runs per server, each server at a time of its own and each database some seconds on.

    The older runs hold half of the rows with other numbers, all of the rows with other states, and a database that
    is gone from the latest, so a report that adds up or joins across runs gives something else.
    """
    now = _run_time(fact)
    numbers = [f.name for f in fact.schema.fields if f.dataType.simpleString() in ("bigint", "double", "int") and f.name not in ("position", "session_id", "lock_id", "trx_id", "query_id", "user_id")]
    texts = [f.name for f in fact.schema.fields if f.name in ("state", "lock_status", "comment", "engine", "tablespace", "data_type", "object_type", "value")]
    shrunk = {c: (F.col(c) / 2).cast(fact.schema[c].dataType) for c in numbers}
    changed = {c: F.lit("old").cast(fact.schema[c].dataType) for c in texts if fact.schema[c].dataType.simpleString() == "string"}
    # every row is read once and turned into its versions: 0 the latest, 1 an older one, 2 the oldest, 3 an older one of a database that is gone
    version = F.col("__version")
    halved, gone = version.isin(1, 3), version == 3
    kept = F.pmod(F.xxhash64(*[c for c in fact.columns if c not in numbers][:4]), F.lit(2)) == 0
    hours = F.when(version == 0, 0).when(version == 2, -48).otherwise(-24)

    def seen(name: str) -> Column:
        found = F.when(halved, shrunk[name]).otherwise(F.col(name)) if name in shrunk else F.col(name)
        found = F.when(version == 2, changed[name]).otherwise(found) if name in changed else found
        return (F.when(gone, F.lit("gone")).otherwise(found) if name == "database_name" else found).alias(name)

    versions = F.array(*[F.lit(v) for v in ([0, 1, 2, 3] if "database_name" in fact.columns else [0, 1, 2])])
    every = fact.select("*", F.explode(versions).alias("__version")).filter(~halved | kept)
    return every.select(*[seen(c) for c in fact.columns], F.timestamp_add("HOUR", hours, now).alias("snapshot_ts"))


def _run_time(fact: DataFrame) -> Column:
    """When the latest run read a row's database: hours that depend on the server, and seconds that depend on the database."""
    hours = F.pmod(F.xxhash64("server"), F.lit(48)).cast("int")
    start = F.timestamp_add("HOUR", hours, F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return F.timestamp_add("SECOND", F.pmod(F.xxhash64("database_name"), F.lit(600)).cast("int"), start) if "database_name" in fact.columns else start


def with_repeats(records: DataFrame) -> DataFrame:
    """A history of records as two snapshots give it: the older has all of them, the latest repeats some."""
    now = _run_time(records)
    older = records.withColumn("snapshot_ts", F.timestamp_add("HOUR", F.lit(-24), now))
    return older.unionByName(records.filter(F.pmod(F.xxhash64(*records.columns), F.lit(3)) == 0).withColumn("snapshot_ts", now))
