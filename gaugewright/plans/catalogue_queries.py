"""Queries of the storage, relation, index, column, object and security operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fixed_values import LARGE_OBJECT_TYPES, SYSTEM_SCHEMAS
from ..operators import catalogue as C
from ..operators import relations as L
from ..operators import storage as G
from .facts import derived, source
from .registry import query, rnd

PLACE = "server, database_name"
TABLE = f"{PLACE}, schema_name, table_name"
_SYSTEM = ", ".join(f"'{n}'" for n in sorted({n.lower() for group in SYSTEM_SCHEMAS.values() for n in group}))


def user(column: str = "schema_name") -> str:
    return f"(lower({column}) NOT IN ({_SYSTEM}) AND NOT starts_with({column}, 'pg_'))"


USER_TABLES = f"(SELECT * FROM fact_tables WHERE {user()})"
SIZE = "data_bytes + index_bytes"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def mb(x: str, power: int = 2, digits: int = 2) -> str:
    return rnd(f"CAST({x} AS DOUBLE) / {float(1024 ** power)!r}", digits)


def day(c: str):
    return F.date_format(c, "yyyy-MM-dd").alias(c)


# --- storage ------------------------------------------------------------------------------------------


@query("storage_databases", "G1", f"""
SELECT CASE WHEN grouping(server) = 1 THEN 'TOTAL' ELSE server END AS server, CASE WHEN grouping(server) = 1 THEN 'TOTAL' ELSE database_name END AS database_name,
 {big('sum(t)')} AS table_count, {big('sum(d)')} AS data_bytes, {big('sum(i)')} AS index_bytes, {big('sum(d) + sum(i)')} AS total_bytes,
 {mb('sum(d) + sum(i)')} AS total_mb, {mb('sum(d) + sum(i)', 3)} AS total_gb
 FROM (SELECT b.server, b.database_name, count(a.table_name) AS t, coalesce(sum(a.data_bytes), 0) AS d, coalesce(sum(a.index_bytes), 0) AS i
 FROM fact_databases b LEFT JOIN {USER_TABLES} a ON a.server = b.server AND a.database_name = b.database_name GROUP BY b.server, b.database_name) x
 GROUP BY GROUPING SETS ((server, database_name), ())""")
def storage_databases(spark, folder):
    return G.database_sizes(derived(spark, folder, "databases"), derived(spark, folder, "tables"))


@query("storage_tables", "G2 X8", f"""
SELECT {TABLE}, {big('coalesce(row_count, 0)')} AS row_count, {mb('data_bytes')} AS data_mb, {mb('index_bytes')} AS index_mb,
 {mb(SIZE)} AS total_mb, {mb(SIZE, 3, 4)} AS total_gb FROM {USER_TABLES} t""")
def storage_tables(spark, folder):
    return G.table_storage(derived(spark, folder, "tables"))


@query("storage_data_vs_index", "G3", f"""
SELECT {big('d')} AS data_bytes, {big('i')} AS index_bytes, {big('d + i')} AS total_bytes, {mb('d')} AS data_mb, {mb('i')} AS index_mb,
 {mb('d + i', 3, 4)} AS total_gb, {mb('d + i', 4, 6)} AS total_tb, {rnd('CAST(i AS DOUBLE) / CAST(d AS DOUBLE)', 4)} AS index_per_data
 FROM (SELECT sum(data_bytes) AS d, sum(index_bytes) AS i FROM {USER_TABLES} t) s""")
def storage_data_vs_index(spark, folder):
    return G.data_vs_index(derived(spark, folder, "tables"))


def _largest(order: str, n: int) -> str:
    return f"SELECT {TABLE}, {big('coalesce(row_count, 0)')} AS row_count, {big(SIZE)} AS total_bytes FROM {USER_TABLES} t ORDER BY {order} DESC, {SIZE} DESC, {TABLE} LIMIT {n}"


@query("storage_largest", "G4", _largest(SIZE, 100))
def storage_largest(spark, folder):
    return G.top_largest(derived(spark, folder, "tables"), 100)


@query("storage_largest_by_rows", "G4", _largest("coalesce(row_count, 0)", 10))
def storage_largest_by_rows(spark, folder):
    return G.top_largest(derived(spark, folder, "tables"), 10, "rows")


@query("storage_largest_per_database", "G4", f"""
SELECT * FROM (SELECT {TABLE}, {big('coalesce(row_count, 0)')} AS row_count, {big(SIZE)} AS total_bytes,
 CAST(row_number() OVER (PARTITION BY {PLACE} ORDER BY {SIZE} DESC, {TABLE}) AS INTEGER) AS rank FROM {USER_TABLES} t) r WHERE rank <= 5""")
def storage_largest_per_database(spark, folder):
    return G.top_largest(derived(spark, folder, "tables"), 5, per_database=True)


@query("storage_row_counts", "G5", f"SELECT {TABLE}, {big('coalesce(row_count, 0)')} AS row_count FROM {USER_TABLES} t ORDER BY 5 DESC, {TABLE} LIMIT 5000")
def storage_row_counts(spark, folder):
    return G.row_counts(derived(spark, folder, "tables"), 5000)


@query("storage_by_engine", "G6", f"SELECT engine AS storage_class, count(*) AS table_count, {big(f'sum({SIZE})')} AS total_bytes FROM {USER_TABLES} t GROUP BY engine")
def storage_by_engine(spark, folder):
    return G.storage_by_group(derived(spark, folder, "tables"))


@query("storage_by_tablespace", "G6", f"SELECT coalesce(tablespace, 'default') AS storage_class, count(*) AS table_count, {big(f'sum({SIZE})')} AS total_bytes FROM {USER_TABLES} t GROUP BY 1")
def storage_by_tablespace(spark, folder):
    return G.storage_by_group(derived(spark, folder, "tables"), "tablespace")


@query("storage_non_default_engine", "G7", f"SELECT {TABLE}, engine, {big(SIZE)} AS total_bytes FROM {USER_TABLES} t WHERE engine <> 'engine_a' AND table_type = 'BASE TABLE'")
def storage_non_default_engine(spark, folder):
    return G.non_default_engine(derived(spark, folder, "tables"), "engine_a")


@query("storage_capacity", "G8", f"""
SELECT server, name, {big('total_bytes')} AS total_bytes, {big('used_bytes')} AS used_bytes, {big('total_bytes - used_bytes')} AS free_bytes,
 {rnd('CAST(used_bytes AS DOUBLE) / nullif(CAST(total_bytes AS DOUBLE), 0) * 100.0', 2)} AS used_pct FROM fact_volumes""")
def storage_capacity(spark, folder):
    return G.capacity_used(derived(spark, folder, "volumes"))


@query("storage_partitions", "G9", f"SELECT {TABLE}, count(*) AS partition_count, {big('sum(row_count)')} AS row_count, {big(f'sum({SIZE})')} AS total_bytes FROM fact_partitions WHERE {user()} GROUP BY {TABLE}")
def storage_partitions(spark, folder):
    return G.partition_counts(derived(spark, folder, "partitions"))


@query("storage_partition_detail", "G9", f"SELECT {TABLE}, partition_name, CAST(position AS INTEGER) AS position, row_count, {big(SIZE)} AS total_bytes FROM fact_partitions WHERE {user()}")
def storage_partition_detail(spark, folder):
    return G.partition_detail(derived(spark, folder, "partitions"))


@query("storage_large_unpartitioned", "G10", f"""
SELECT {TABLE}, {big(SIZE)} AS total_bytes FROM {USER_TABLES} t WHERE NOT EXISTS (SELECT 1 FROM fact_partitions p WHERE p.server = t.server
 AND p.database_name = t.database_name AND p.schema_name = t.schema_name AND p.table_name = t.table_name) ORDER BY 5 DESC, {TABLE} LIMIT 100""")
def storage_large_unpartitioned(spark, folder):
    return G.large_unpartitioned(derived(spark, folder, "tables"), derived(spark, folder, "partitions"))


@query("storage_fragmentation", "G11", f"""
SELECT {TABLE}, {rnd('coalesce(CAST(free_bytes AS DOUBLE) / nullif(CAST(data_bytes + free_bytes AS DOUBLE), 0), 0.0) * 100.0', 2)} AS free_pct,
 {rnd('CAST(dead_tuples AS DOUBLE) / nullif(CAST(live_tuples + dead_tuples AS DOUBLE), 0) * 100.0', 2)} AS dead_pct FROM {USER_TABLES} t""")
def storage_fragmentation(spark, folder):
    return G.fragmentation(derived(spark, folder, "tables"))


@query("storage_fragmented_indexes", "G11", f"SELECT DISTINCT {TABLE}, index_name, fragmentation_pct, page_count FROM fact_index_columns WHERE page_count >= 1000 AND fragmentation_pct >= 30")
def storage_fragmented_indexes(spark, folder):
    return G.fragmented_indexes(derived(spark, folder, "index_columns"))


_IO = f"""(SELECT {PLACE}, schema_name, object_name AS table_name, {big('sum(reads)')} AS reads, {big('sum(writes)')} AS writes,
 {big('sum(inserts + updates + deletes)')} AS changes FROM fact_object_io GROUP BY {PLACE}, schema_name, object_name)"""


@query("storage_archival", "G12", f"""
SELECT {TABLE}, {big('row_count')} AS row_count, {big('coalesce(changes, 0)')} AS changes FROM {USER_TABLES} t LEFT JOIN {_IO} i USING ({TABLE})
 WHERE row_count > 25 AND coalesce(changes, 0) <= 8""")
def storage_archival(spark, folder):
    return G.archival_candidates(derived(spark, folder, "tables"), derived(spark, folder, "object_io"), rows=25, changes=8)


@query("storage_limited_usage", "G13", f"""
SELECT {TABLE}, {big(SIZE)} AS total_bytes FROM {USER_TABLES} t LEFT JOIN {_IO} i USING ({TABLE}) WHERE coalesce(reads, 0) = 0 AND coalesce(writes, 0) = 0""")
def storage_limited_usage(spark, folder):
    return G.limited_usage(derived(spark, folder, "tables"), derived(spark, folder, "object_io"))


@query("storage_hot_tables", "G14", f"SELECT {TABLE}, reads, writes, reads + writes AS operations FROM {_IO} i WHERE reads + writes > 0 ORDER BY reads + writes DESC, {TABLE} LIMIT 10")
def storage_hot_tables(spark, folder):
    return G.hot_tables(derived(spark, folder, "object_io"))


@query("storage_heavy_writes", "G14", f"SELECT {TABLE}, reads, writes, reads + writes AS operations FROM {_IO} i WHERE reads + writes > 0 ORDER BY writes DESC, {TABLE} LIMIT 20")
def storage_heavy_writes(spark, folder):
    return G.hot_tables(derived(spark, folder, "object_io"), 20, "writes")


@query("storage_stale_statistics", "G15", f"SELECT {TABLE}, coalesce(strftime(coalesce(last_analyzed, update_time), '%Y-%m-%d'), 'Never') AS statistics_label FROM {USER_TABLES} t")
def storage_stale_statistics(spark, folder):
    return G.stale_statistics(derived(spark, folder, "tables")).drop("statistics_time")


@query("storage_modified_statistics", "G15", f"""
SELECT {TABLE}, {big('coalesce(row_count, 0)')} AS row_count, changes AS modification_counter FROM {USER_TABLES} t JOIN {_IO} i USING ({TABLE})
 WHERE changes > 0 ORDER BY 5 DESC, 6 DESC, {TABLE} LIMIT 100""")
def storage_modified_statistics(spark, folder):
    return G.modified_since_statistics(derived(spark, folder, "tables"), derived(spark, folder, "object_io"))


@query("storage_inventory", "G16", f"""
SELECT {PLACE}, schema_name, count(*) AS table_count, strftime(min(create_time), '%Y-%m-%d') AS first_created, strftime(max(update_time), '%Y-%m-%d') AS last_updated
 FROM {USER_TABLES} t GROUP BY {PLACE}, schema_name""")
def storage_inventory(spark, folder):
    found = G.object_inventory(derived(spark, folder, "tables"))
    return found.withColumns({c: day(c) for c in ("first_created", "last_updated")})


@query("storage_namespaces", "G17 X14", f"SELECT DISTINCT {PLACE}, schema_name FROM {USER_TABLES} t")
def storage_namespaces(spark, folder):
    return G.list_namespaces(derived(spark, folder, "tables"))


@query("storage_list_tables", "G17 X14", f"SELECT {TABLE} FROM {USER_TABLES} t WHERE table_type = 'BASE TABLE'")
def storage_list_tables(spark, folder):
    return G.list_tables(derived(spark, folder, "tables"))


@query("storage_sample_rows", "A4", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey, o_custkey, o_totalprice LIMIT 200")
def storage_sample_rows(spark, folder):
    from ..sources.readers import sample_rows

    by = ["o_orderkey", "o_custkey", "o_totalprice"]
    return sample_rows(source(spark, folder, "orders").select(*by), 200, by)


@query("storage_fan_out", "A6", f"SELECT database_name, count(*) AS table_count FROM fact_tables GROUP BY database_name")
def storage_fan_out(spark, folder):
    """Every database on its own, and one that fails while it runs."""
    import uuid

    from ..sources.readers import fan_out_union
    from .materialize import shared_folder

    tables = derived(spark, folder, "tables").select("database_name")
    names = [r[0] for r in tables.distinct().collect()]  # databases, one row each

    def count(name: str):
        kept = tables.filter(F.col("database_name") == name) if name != "broken" else tables.select(F.raise_error(F.lit("down")).alias("database_name"))
        return kept.groupBy().agg(F.count("database_name").alias("table_count"))

    return fan_out_union(spark, count, [*names, "broken"], f"{shared_folder(spark)}/fan-{uuid.uuid4().hex}")[0]


# --- relations ----------------------------------------------------------------------------------------

CHILD, PARENT = f"{PLACE}, child_schema, child_table", f"{PLACE}, parent_schema, parent_table"


def _related(side: str, other: str, count: str) -> str:
    name = f"struct_pack(s := {other}_schema, t := {other}_table)"
    return f"SELECT {side}, count(DISTINCT {name}) AS {count}, count(DISTINCT constraint_name) AS fk_count FROM fact_fk_columns GROUP BY {side}"


@query("rel_parent_tables", "H1", _related(PARENT, "child", "child_count"))
def rel_parent_tables(spark, folder):
    return L.parent_tables(derived(spark, folder, "fk_columns"))


@query("rel_child_tables", "H2", _related(CHILD, "parent", "parent_count"))
def rel_child_tables(spark, folder):
    return L.child_tables(derived(spark, folder, "fk_columns"))


@query("rel_related_tables", "H1 H2", f"SELECT DISTINCT {CHILD}, parent_schema, parent_table FROM fact_fk_columns")
def rel_related_tables(spark, folder):
    return L.related_tables(derived(spark, folder, "fk_columns"))


@query("rel_independent_tables", "H3", f"""
SELECT {TABLE} FROM {USER_TABLES} t WHERE NOT EXISTS (SELECT 1 FROM fact_fk_columns f WHERE f.server = t.server AND f.database_name = t.database_name AND f.child_schema = t.schema_name AND f.child_table = t.table_name)
 AND NOT EXISTS (SELECT 1 FROM fact_fk_columns f WHERE f.server = t.server AND f.database_name = t.database_name AND f.parent_schema = t.schema_name AND f.parent_table = t.table_name)""")
def rel_independent_tables(spark, folder):
    return L.independent_tables(derived(spark, folder, "tables"), derived(spark, folder, "fk_columns"))


@query("rel_foreign_keys", "H4", f"SELECT DISTINCT {CHILD}, constraint_name, CAST(position AS INTEGER) AS position, child_column, parent_schema, parent_table, parent_column FROM fact_fk_columns")
def rel_foreign_keys(spark, folder):
    return L.foreign_keys(derived(spark, folder, "fk_columns"))


@query("rel_fk_graph", "H5", f"""
SELECT {CHILD}, parent_schema, parent_table, constraint_name, string_agg(child_column, ', ' ORDER BY position) AS child_columns,
 string_agg(parent_column, ', ' ORDER BY position) AS parent_columns FROM (SELECT DISTINCT * FROM fact_fk_columns) f GROUP BY {CHILD}, parent_schema, parent_table, constraint_name""")
def rel_fk_graph(spark, folder):
    return L.fk_graph(derived(spark, folder, "fk_columns"))


@query("rel_many_foreign_keys", "H6", f"SELECT {CHILD}, count(DISTINCT constraint_name) AS fk_count FROM fact_fk_columns GROUP BY {CHILD}")
def rel_many_foreign_keys(spark, folder):
    return L.many_foreign_keys(derived(spark, folder, "fk_columns"))


INDEX = f"{TABLE}, index_name"


def _index_list(where: str) -> str:
    return f"SELECT {INDEX}, string_agg(column_name, ', ' ORDER BY position, column_name) AS column_list FROM fact_index_columns WHERE {where} GROUP BY {INDEX}"


@query("rel_primary_keys", "H7", _index_list("is_primary"))
def rel_primary_keys(spark, folder):
    return L.primary_keys(derived(spark, folder, "index_columns"))


def _no_index(where: str) -> str:
    return f"""SELECT {TABLE} FROM {USER_TABLES} t WHERE table_type = 'BASE TABLE' AND NOT EXISTS (SELECT 1 FROM fact_index_columns x WHERE {where}
 AND x.server = t.server AND x.database_name = t.database_name AND x.schema_name = t.schema_name AND x.table_name = t.table_name)"""


@query("rel_tables_without_pk", "H8", _no_index("x.is_primary"))
def rel_tables_without_pk(spark, folder):
    return L.tables_without_pk(derived(spark, folder, "tables"), derived(spark, folder, "index_columns"))


@query("rel_unique_constraints", "H9", _index_list("is_unique AND NOT is_primary"))
def rel_unique_constraints(spark, folder):
    return L.unique_constraints(derived(spark, folder, "index_columns"))


# --- indexes ------------------------------------------------------------------------------------------


@query("index_list", "I1", f"""
SELECT {INDEX}, string_agg(column_name, ', ' ORDER BY position, column_name) AS column_list, count(*) AS column_count, bool_or(is_unique) AS is_unique,
 bool_or(is_primary) AS is_primary, bool_or(is_disabled) AS is_disabled, max(index_type) AS index_type, {big('max(index_bytes)')} AS index_bytes FROM fact_index_columns GROUP BY {INDEX}""")
def index_list(spark, folder):
    return L.indexes(derived(spark, folder, "index_columns"))


@query("index_columns", "I2", f"SELECT DISTINCT {INDEX}, position, column_name FROM fact_index_columns")
def index_columns(spark, folder):
    return L.index_column_list(derived(spark, folder, "index_columns"))


@query("index_count", "I3", f"SELECT {TABLE}, count(DISTINCT index_name) AS index_count FROM fact_index_columns GROUP BY {TABLE} HAVING count(DISTINCT index_name) > 5")
def index_count(spark, folder):
    return L.index_counts(derived(spark, folder, "index_columns"), 5)


@query("index_largest", "I4", f"SELECT {INDEX}, {big('max(index_bytes)')} AS index_bytes FROM fact_index_columns GROUP BY {INDEX} ORDER BY max(index_bytes) DESC, {INDEX} LIMIT 100")
def index_largest(spark, folder):
    return L.largest_indexes(derived(spark, folder, "index_columns"))


_LISTS = f"(SELECT {INDEX}, list(column_name ORDER BY position, column_name) AS names FROM fact_index_columns GROUP BY {INDEX})"


@query("index_duplicates", "I5", f"""
SELECT {TABLE}, array_to_string(names, ', ') AS column_list, 'duplicate' AS kind, count(*) AS index_count, min(index_name) AS example FROM {_LISTS} a GROUP BY {TABLE}, names HAVING count(*) > 1
UNION ALL
SELECT s.server, s.database_name, s.schema_name, s.table_name, array_to_string(s.names, ', '), 'prefix overlap', count(*), min(b.index_name)
 FROM (SELECT DISTINCT {TABLE}, names FROM {_LISTS} a) s JOIN {_LISTS} b ON b.server = s.server AND b.database_name = s.database_name
 AND b.schema_name = s.schema_name AND b.table_name = s.table_name AND len(b.names) > len(s.names) AND b.names[1:len(s.names)] = s.names
 GROUP BY s.server, s.database_name, s.schema_name, s.table_name, s.names""")
def index_duplicates(spark, folder):
    return L.duplicate_indexes(derived(spark, folder, "index_columns"))


@query("index_duplicate_names", "I5", f"SELECT {INDEX}, array_to_string(names, ', ') AS column_list FROM (SELECT *, count(*) OVER (PARTITION BY {TABLE}, names) AS n FROM {_LISTS} a) b WHERE n > 1")
def index_duplicate_names(spark, folder):
    return L.duplicate_index_names(derived(spark, folder, "index_columns"))


_INDEX_IO = f"""(SELECT {PLACE}, schema_name, object_name AS table_name, index_name, {big('sum(reads)')} AS reads, {big('sum(writes)')} AS writes
 FROM fact_object_io WHERE index_name IS NOT NULL GROUP BY ALL)"""


@query("index_unused", "I6", f"""
SELECT DISTINCT {INDEX} FROM fact_index_columns x LEFT JOIN {_INDEX_IO} u USING ({INDEX}) WHERE NOT is_primary AND coalesce(reads, 0) = 0""")
def index_unused(spark, folder):
    return L.unused_indexes(derived(spark, folder, "index_columns"), derived(spark, folder, "object_io"))


@query("index_usage", "I7", f"SELECT {INDEX}, reads, writes, reads + writes AS total FROM (SELECT DISTINCT {INDEX} FROM fact_index_columns) x JOIN {_INDEX_IO} u USING ({INDEX}) WHERE reads + writes > 0")
def index_usage(spark, folder):
    return L.index_usage(derived(spark, folder, "index_columns"), derived(spark, folder, "object_io"))


@query("index_missing_tables", "I8", _no_index("true"))
def index_missing_tables(spark, folder):
    return L.tables_without_index(derived(spark, folder, "tables"), derived(spark, folder, "index_columns"))


@query("index_disabled", "I9", f"SELECT DISTINCT {INDEX} FROM fact_index_columns WHERE is_disabled")
def index_disabled(spark, folder):
    return L.disabled_indexes(derived(spark, folder, "index_columns"))


@query("index_candidates", "I10", f"""
SELECT * FROM (SELECT {PLACE}, schema_name, object_name AS table_name, {big('sum(reads) FILTER (index_name IS NULL)')} AS full_scans,
 {big('coalesce(sum(reads) FILTER (index_name IS NOT NULL), 0)')} AS index_reads FROM fact_object_io GROUP BY {PLACE}, schema_name, object_name) x
 WHERE full_scans > 0 ORDER BY full_scans DESC, index_reads DESC, {TABLE} LIMIT 100""")
def index_candidates(spark, folder):
    return L.missing_index_candidates(derived(spark, folder, "object_io"))


# --- columns ------------------------------------------------------------------------------------------

COLUMN = f"{TABLE}, column_name"
_USER_COLUMNS = f"(SELECT * FROM fact_columns WHERE {user()})"


@query("column_dictionary", "J1", f"SELECT {COLUMN}, position, data_type, char_length, num_precision, num_scale, default_value, nullable, extra, coalesce(key = 'PRI', false) AS in_primary_key FROM {_USER_COLUMNS} c")
def column_dictionary(spark, folder):
    return C.data_dictionary(derived(spark, folder, "columns"))


@query("column_charsets", "J7", f'SELECT {COLUMN}, charset, c."collation" FROM {_USER_COLUMNS} c WHERE c."collation" IS NOT NULL')
def column_charsets(spark, folder):
    return C.column_collations(derived(spark, folder, "columns"))


_TYPES = "(" + ", ".join(f"'{t}'" for t in LARGE_OBJECT_TYPES) + ")"


@query("column_large_objects", "J2", f"SELECT {COLUMN}, data_type FROM {_USER_COLUMNS} c WHERE lower(data_type) IN {_TYPES}")
def column_large_objects(spark, folder):
    return C.large_object_columns(derived(spark, folder, "columns"))


@query("column_json", "J3", f"SELECT DISTINCT {COLUMN}, data_type FROM {_USER_COLUMNS} c WHERE data_type IN ('json', 'jsonb') OR upper(check_expr) LIKE '%IS JSON%'")
def column_json(spark, folder):
    return C.json_columns(derived(spark, folder, "columns"))


@query("column_generated", "J4", f"SELECT {COLUMN}, generation_expr FROM {_USER_COLUMNS} c WHERE generation_expr <> ''")
def column_generated(spark, folder):
    return C.generated_columns(derived(spark, folder, "columns"))


@query("column_auto_increment", "J5", f"SELECT {COLUMN}, data_type FROM {_USER_COLUMNS} c WHERE extra LIKE '%auto_increment%'")
def column_auto_increment(spark, folder):
    return C.auto_increment_columns(derived(spark, folder, "columns"))


@query("column_large_varchar", "J6", f"SELECT {COLUMN}, data_type, char_length FROM {_USER_COLUMNS} c WHERE (data_type IN ('varchar', 'char', 'nvarchar') AND char_length >= 255) OR data_type LIKE '%text%'")
def column_large_varchar(spark, folder):
    return C.large_varchar_columns(derived(spark, folder, "columns"))


@query("column_collations", "J7", f'SELECT {PLACE}, schema_name, "collation", count(*) AS table_count FROM {USER_TABLES} t WHERE "collation" IS NOT NULL GROUP BY ALL')
def column_collations(spark, folder):
    return C.collation_mix(derived(spark, folder, "tables"))


@query("column_documented_tables", "J8", f"SELECT {TABLE}, comment FROM {USER_TABLES} t WHERE comment <> ''")
def column_documented_tables(spark, folder):
    return C.documented_tables(derived(spark, folder, "tables"))


# --- objects and security -----------------------------------------------------------------------------

OBJECT = f"{PLACE}, schema_name, object_name"


@query("object_routines", "K1", f"SELECT {OBJECT}, object_type FROM fact_objects WHERE {user()} AND object_type IN ('PROCEDURE', 'FUNCTION', 'PACKAGE') AND NOT is_extension")
def object_routines(spark, folder):
    return C.routines(derived(spark, folder, "objects"))


@query("object_views", "K2", f"SELECT {OBJECT}, CASE object_type WHEN 'VIEW' THEN 'View' ELSE 'Materialized View' END AS view_type FROM fact_objects WHERE {user()} AND object_type LIKE '%VIEW'")
def object_views(spark, folder):
    return C.views(derived(spark, folder, "objects"))


@query("object_triggers", "K3", f"SELECT {OBJECT}, table_name FROM fact_objects o WHERE object_type = 'TRIGGER' AND EXISTS (SELECT 1 FROM fact_tables t WHERE t.server = o.server AND t.database_name = o.database_name AND t.schema_name = o.schema_name AND t.table_name = o.table_name)")
def object_triggers(spark, folder):
    return C.triggers(derived(spark, folder, "objects"), derived(spark, folder, "tables"))


@query("object_jobs", "K4", f"SELECT {PLACE}, job_name, enabled, schedule, owner FROM fact_jobs")
def object_jobs(spark, folder):
    return C.scheduled_jobs(derived(spark, folder, "jobs"))


@query("object_failed_jobs", "K4", f"""
SELECT r.server, r.database_name, r.job_name, j.owner, strftime(r.run_ts, '%Y-%m-%d') AS run_ts, CAST(status AS INTEGER) AS status, message FROM fact_job_runs r JOIN fact_jobs j
 ON j.server = r.server AND j.database_name = r.database_name AND j.job_name = r.job_name WHERE status <> 1
 ORDER BY r.run_ts DESC, r.server, r.database_name, r.job_name, message LIMIT 100""")
def object_failed_jobs(spark, folder):
    return C.failed_job_runs(derived(spark, folder, "jobs"), derived(spark, folder, "job_runs")).withColumn("run_ts", day("run_ts"))


_CODE = f"(SELECT * FROM fact_objects WHERE {user()} AND object_type IN ('PROCEDURE', 'FUNCTION') AND NOT is_extension)"


@query("object_dependencies", "K5", f"""
SELECT DISTINCT c.server, c.database_name, c.schema_name, c.object_name, object_type, coalesce(t.schema_name || '.' || t.table_name, 'None (Standalone Code)') AS referenced_object
 FROM {_CODE} c LEFT JOIN {USER_TABLES} t ON t.server = c.server AND t.database_name = c.database_name
 AND list_contains(string_split_regex(lower(c.body), '[^a-z0-9_]+'), lower(t.table_name))""")
def object_dependencies(spark, folder):
    return C.code_dependencies(derived(spark, folder, "objects"), derived(spark, folder, "tables"))


@query("object_view_dependencies", "K5", f"""
SELECT DISTINCT {PLACE}, table_name AS referencing, 't' || CAST(position AS VARCHAR) AS referenced FROM fact_columns WHERE table_name <> 't' || CAST(position AS VARCHAR)""")
def object_view_dependencies(spark, folder):
    columns = derived(spark, folder, "columns")
    edges = {"referencing": F.col("table_name"), "referenced": F.concat(F.lit("t"), F.col("position").cast("string"))}
    return C.view_dependencies(columns.withColumns(edges).select(*[c for c in columns.columns if c in ("server", "database_name", "snapshot_ts")], *edges))


@query("object_counts", "K5", f"SELECT {PLACE}, object_type, count(*) AS object_count FROM fact_objects GROUP BY ALL")
def object_counts(spark, folder):
    return C.object_counts(derived(spark, folder, "objects"))


@query("security_accounts", "L1", f"SELECT DISTINCT {PLACE}, name, type, is_disabled, coalesce(role, 'none') AS role FROM fact_principals")
def security_accounts(spark, folder):
    return C.accounts(derived(spark, folder, "principals"))


@query("security_privileges", "L2", f"SELECT {PLACE}, grantee, privilege, object_name, bool_or(grantable) AS grantable FROM fact_grants GROUP BY {PLACE}, grantee, privilege, object_name")
def security_privileges(spark, folder):
    return C.privileges(derived(spark, folder, "grants"))


@query("security_role_members", "L2", f"SELECT DISTINCT {PLACE}, role, name AS member FROM fact_principals WHERE role IS NOT NULL")
def security_role_members(spark, folder):
    return C.role_members(derived(spark, folder, "principals"))
