"""Catalogue and telemetry operators on small cases, hot keys included."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gaugewright.operators import catalogue as C
from gaugewright.operators import kpi as K
from gaugewright.operators import relations as L
from gaugewright.operators import sessions as N
from gaugewright.operators import storage as G
from gaugewright.operators import trends as R
from gaugewright.operators import workload as M
from gaugewright.functions.fixed_values import STANDALONE
from gaugewright.plans.facts import DERIVED, SCHEMAS


@pytest.mark.parametrize("name", SCHEMAS)
def test_fact_schemas_parse(spark, name):
    df = spark.createDataFrame([], SCHEMAS[name])
    assert {"server", "database_name", "snapshot_ts"} <= set(df.columns)


FK = "server string, database_name string, constraint_name string, child_schema string, child_table string, child_column string, parent_schema string, parent_table string, parent_column string, position int"


def test_a_parent_of_very_many_has_one_row(spark):
    n = F.format_string("t%05d", "id")
    fk = spark.range(2500).select(
        F.lit("s").alias("server"), F.lit("d").alias("database_name"), n.alias("constraint_name"), F.lit("p").alias("child_schema"), n.alias("child_table"),
        F.lit("c").alias("child_column"), F.lit("p").alias("parent_schema"), F.lit("hub").alias("parent_table"), F.lit("k").alias("parent_column"), F.lit(1).alias("position"),
    )
    assert [tuple(r)[2:] for r in L.parent_tables(fk.union(fk)).collect()] == [("p", "hub", 2500, 2500)]
    assert L.related_tables(fk.union(fk)).count() == 2500


INDEX_ROW = "server string, database_name string, schema_name string, table_name string, index_name string, column_name string, position int, is_unique boolean, is_primary boolean, is_disabled boolean, index_type string, index_bytes bigint"


def index(name, columns, table="t"):
    return [("s", "d", "p", table, name, c, i, False, False, False, "BTREE", 1) for i, c in enumerate(columns, 1)]


def test_duplicate_and_overlapping_indexes(rows):
    data = index("a", "xy") + index("b", "xy") + index("c", "xyz") + index("d", "yx") + index("e", "xy", "other")
    got = {(r["kind"], r["column_list"]): r for r in L.duplicate_indexes(rows(data, INDEX_ROW)).collect()}
    assert set(got) == {("duplicate", "x, y"), ("prefix overlap", "x, y")}
    assert (got[("duplicate", "x, y")]["index_count"], got[("duplicate", "x, y")]["example"]) == (2, "a")
    assert (got[("prefix overlap", "x, y")]["index_count"], got[("prefix overlap", "x, y")]["example"]) == (1, "c")
    assert sorted(r["index_name"] for r in L.duplicate_index_names(rows(data, INDEX_ROW)).collect()) == ["a", "b"]


def test_copies_of_catalogue_rows_change_nothing(rows):
    once = rows(index("a", "xy"), INDEX_ROW)
    assert L.indexes(once.union(once)).collect() == L.indexes(once).collect()


def test_code_dependencies_match_whole_words(rows):
    objects = rows(
        [("s", "d", "p", "f1", "FUNCTION", "SELECT * FROM Orders JOIN order_lines", False),
         ("s", "d", "p", "f2", "PROCEDURE", "delete from my-table; x", False),
         ("s", "d", "p", "f3", "FUNCTION", "nothing, reorders, my-tables", False),
         ("s", "e", "p", "f4", "FUNCTION", "orders", False),
         ("s", "d", "p", "f5", "FUNCTION", "orders", True)],
        "server string, database_name string, schema_name string, object_name string, object_type string, body string, is_extension boolean",
    )
    tables = rows([("s", "d", "p", t) for t in ("ORDERS", "order_lines", "lines", "my-table")], "server string, database_name string, schema_name string, table_name string")
    got = {(r["object_name"], r["referenced_object"]) for r in C.code_dependencies(objects, tables).collect()}
    assert got == {
        ("f1", "p.ORDERS"), ("f1", "p.order_lines"), ("f2", "p.my-table"), ("f3", STANDALONE), ("f4", STANDALONE),
    }


def test_lock_waits_are_linear_in_waiters(spark):
    locks = spark.range(2000).select(
        F.lit("s").alias("server"), F.lit("d").alias("database_name"), F.col("id").alias("lock_id"), F.col("id").alias("session_id"),
        F.lit(1).alias("id1"), F.lit(1).alias("id2"), F.when(F.col("id") % 2 == 0, "WAITING").otherwise("GRANTED").alias("lock_status"),
    )
    got = N.lock_waits(locks)
    assert got.count() == 1000 and got.select("holder_count", "first_holder").distinct().first()[:] == (1000, 1)


def test_no_waits_and_no_reads(rows):
    waits = rows([("Idle", "x", 1, 1.0), ("Other", "WAITFOR", 1, 5.0), ("Other", "idle/x", 1, 2.0)], "wait_class string, wait_event string, wait_count bigint, wait_ms double")
    assert M.top_wait_events(waits).count() == 0
    none = M.cache_efficiency(rows([("s", "blocks_hit", 0)], "server string, metric string, value bigint")).first()
    assert (none["hit_pct"], none["status"]) == (None, "Unavailable")


def test_share_of_nothing_is_zero(rows):
    assert [r["share_pct"] for r in M.share_of_total(rows([(0,), (0,)], "v int"), "v").collect()] == [0.0, 0.0]


SAMPLE = "server string, ts timestamp, metric string, value double"


def at(minute, second=0):
    return datetime(2024, 1, 1, 0, minute, second)


def test_trend_buckets(rows):
    df = rows([("s", at(0), "cpu", 10.0), ("s", at(4, 59), "cpu", 20.0), ("s", at(5), "cpu", 90.0), ("s", at(59), "cpu", 70.0)], SAMPLE)
    t = R.metric_trend(df, "1h", "2024-01-01 01:00:00").first()
    assert t["values"] == [15.0, 90.0] + [None] * 9 + [70.0]
    assert (t["start"], t["current"], t["peak"], t["min"], t["avg"], t["peak_time"]) == (15.0, 70.0, 90.0, 15.0, 58.3, "00:05")
    insight = R.cpu_insight(R.metric_trend(df, "1h", "2024-01-01 01:00:00"), "1h").first()
    assert insight["rule"] == 1 and insight["insight"].endswith("its peak was 90.0% at 00:05.")


def test_trend_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "samples")
    spark.createDataFrame([("s", at(1), "cpu", 1.0)], SAMPLE).write.parquet(path)
    plan = R.metric_trend(spark.read.parquet(path), "1h", "2024-01-01 01:00:00")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan


def test_change_from_zero_is_zero(rows):
    df = rows([(0.0, 5.0), (4.0, 5.0), (0.5, 1.0)], "start double, current double")
    assert [r["pct_change"] for r in R.trend_change(df).collect()] == [0.0, 25.0, 50.0]


def test_counter_increase_crosses_buckets_and_restarts(rows):
    values = [(0, 100.0), (30, 130.0), (59, 150.0)]
    data = [("s", at(m), "q", v) for m, v in values] + [("s", datetime(2024, 1, 1, 1, 1), "q", 170.0), ("s", datetime(2024, 1, 1, 2, 0), "q", 5.0)]
    for minutes in (1, 60, 1440):
        got = K.counter_increase(rows(data, SAMPLE), minutes).first()
        assert (got["increase"], got["seconds"]) == (75.0, 7200)


def test_blocked_peak_and_health(rows):
    locks = rows([("a", "WAITING"), ("a", "GRANTED"), ("b", "GRANTED"), ("c", "waiting")], "server string, lock_status string")
    blocked = K.blocked_kpi(locks, rows([("b", 4)], "server string, peak bigint"))
    got = {r["server"]: (r["blocked"], r["peak"], r["status_text"]) for r in blocked.collect()}
    assert got == {"a": (1, 1, "1 Sessions Blocked"), "b": (0, 4, "No Blocking"), "c": (1, 1, "1 Sessions Blocked")}
    cpu = rows([("a", 10.0, 9.0, 12.0), ("b", 10.0, 9.0, 12.0), ("c", 95.0, 9.0, 96.0)], "server string, value double, avg double, peak double")
    table = rows([("a", "t1", 3 * 1024**3)], "server string, table_name string, total_bytes bigint")
    health = {r["server"]: r for r in R.health_summary(cpu, blocked, "1h", top_table=table).collect()}
    assert {k: r["overall_status"] for k, r in health.items()} == {"a": "High", "b": "Elevated", "c": "Critical"}
    assert health["a"]["findings"][-1] == "The largest table over last 1 hour is 't1' with 3.00 GB."
    assert len(health["b"]["findings"]) == 2


def test_slow_statement_texts_are_not_shuffled_with_the_sums(spark):
    df = spark.createDataFrame([], SCHEMAS["statements"])
    plan = M.slow_statements(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "GlobalLimit 50" in plan


def test_every_derived_fact_has_keys(spark):
    for name, sql in DERIVED.items():
        assert "AS server" in sql, name


def test_all_reports_run_on_empty_facts(spark, tmp_path):
    from gaugewright.operators.fleet import REPORTS, reports
    from gaugewright.sources.bulk import collect_all

    facts = {name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}
    ready = reports(facts, "2024-01-01 00:00:00")
    assert set(REPORTS) < set(ready)
    errors = [r for r in collect_all(spark, ready, str(tmp_path), threads=8).collect() if r["error"]]
    assert errors == []
    assert set(reports({"tables": facts["tables"]})) >= {"table_storage"} and "fk_graph" not in reports({"tables": facts["tables"]})


def test_reports_read_the_latest_snapshot(spark):
    one, two = datetime(2024, 1, 1), datetime(2024, 1, 2)
    tables = spark.createDataFrame(
        [("s", "d", one, "p", "a", 10), ("s", "d", two, "p", "a", 20), ("s", "d", one, "p", "gone", 5), ("r", "d", one, "p", "b", 7)],
        "server string, database_name string, snapshot_ts timestamp, schema_name string, table_name string, data_bytes bigint",
    ).withColumns({"index_bytes": F.lit(0).cast("bigint"), "row_count": F.lit(1).cast("bigint")})
    assert {(r["server"], r["table_name"], r["total_bytes"]) for r in G.top_largest(tables).collect()} == {("s", "a", 20), ("r", "b", 7)}
    assert {r["server"]: r["total_bytes"] for r in K.storage_kpi(tables).collect()} == {"s": 20, "r": 7}
    sessions = spark.createDataFrame(
        [("s", t, 1, 5, "active", None) for t in (one, two)] + [("s", t, 2, 6, "idle", [1]) for t in (one, two)],
        "server string, snapshot_ts timestamp, session_id bigint, user_id bigint, state string, blocked_by array<bigint>",
    )
    assert N.blocking_sessions(sessions).count() == 1
    gauges = spark.createDataFrame(
        [("s", t, m, v) for t, m, v in ((one, "threads_connected", 50), (two, "threads_connected", 60), (one, "max_connections", 100), (two, "max_connections", 100))],
        "server string, snapshot_ts timestamp, metric string, value bigint",
    )
    assert K.connections_kpi(gauges).first()["used_pct"] == 60.0


def test_missing_flags_classes_and_schemas_lose_no_rows(rows):
    waits = rows([(None, "lock/x", 1, 5.0), ("Idle", "nap", 1, 9.0)], "wait_class string, wait_event string, wait_count bigint, wait_ms double")
    assert [r["wait_event"] for r in M.top_wait_events(waits).collect()] == ["lock/x"]
    objects = rows([("s", "d", None, "f", "FUNCTION", "select 1 from t", None)], "server string, database_name string, schema_name string, object_name string, object_type string, body string, is_extension boolean")
    tables = rows([("s", "d", None, "t", "BASE TABLE")], "server string, database_name string, schema_name string, table_name string, table_type string")
    assert C.routines(objects).count() == 1
    assert C.code_dependencies(objects, tables).first()["referenced_object"] == ".t"
    assert G.list_tables(tables).count() == 1 and L.tables_without_pk(tables, rows([], INDEX_ROW)).count() == 1
    keys = rows([("s", "d", None, "t", "pk", "c", 1, True, True, False, "BTREE", 1), ("s", "d", None, "t", "ix", "c", 1, None, None, None, "BTREE", 1)], INDEX_ROW)
    assert L.tables_without_pk(tables, keys).count() == 0
    assert [r["index_name"] for r in L.unused_indexes(keys, rows([], "server string, database_name string, schema_name string, object_name string, index_name string, reads bigint, writes bigint")).collect()] == ["ix"]


def test_system_names_are_those_of_the_platform(rows):
    schema = "server string, database_name string, platform string, schema_name string, table_name string, table_type string"
    tables = rows([("s", "d", "mysql", "model", "t", "BASE TABLE"), ("s", "d", "postgres", "sys", "t", "BASE TABLE"), ("s", "model", "sqlserver", "dbo", "t", "BASE TABLE"), ("s", "d", "mysql", "sys", "t", "BASE TABLE"), ("s", "d", "postgres", "pg_x", "t", "BASE TABLE")], schema)
    assert sorted(r["schema_name"] for r in G.list_tables(tables).collect()) == ["model", "sys"]


def test_table_names_of_any_script_are_found(rows):
    objects = rows([("s", "d", "p", "f", "FUNCTION", "select * from 表 join größe", False)], "server string, database_name string, schema_name string, object_name string, object_type string, body string, is_extension boolean")
    tables = rows([("s", "d", "p", "表"), ("s", "d", "p", "Größe"), ("s", "d", "p", "gr")], "server string, database_name string, schema_name string, table_name string")
    assert {r["referenced_object"] for r in C.code_dependencies(objects, tables).collect()} == {"p.表", "p.Größe"}


def test_a_waiter_is_not_its_own_holder(rows):
    schema = "server string, id1 bigint, id2 bigint, lock_id bigint, session_id bigint, lock_status string"
    locks = rows([("s", 1, None, 1, 7, "GRANTED"), ("s", 1, None, 2, 7, "WAITING"), ("s", 1, None, 3, 9, "GRANTED"), ("s", 2, 1, 4, 7, "GRANTED"), ("s", 2, 1, 5, 7, "WAITING")], schema)
    assert [(r["lock_id"], r["holder_count"], r["first_holder"]) for r in N.lock_waits(locks).collect()] == [(2, 1, 9)]


def test_reports_of_stored_states_shuffle_no_rows_of_their_bucket_keys(spark):
    from gaugewright.operators.fleet import reports, stored_states

    keys = spark.createDataFrame(
        [("s", None, None, f"t{k % 3}", f"fk{k}", 1, f"c{k}", None, f"p{k % 2}", "id") for k in range(12)] * 2,
        "server string, database_name string, child_schema string, child_table string, constraint_name string, position int, child_column string, parent_schema string, parent_table string, parent_column string",
    )
    ready = reports(stored_states({"fk_columns": keys}), stored=True)
    for name in ("foreign_keys", "fk_graph", "many_foreign_keys"):
        assert "Exchange hashpartitioning" not in ready[name]()._jdf.queryExecution().executedPlan().toString(), name
    for name, run in reports({"fk_columns": keys}).items():
        assert sorted(map(repr, run().collect())) == sorted(map(repr, ready[name]().collect())) != [], name
    assert {(r.parent_table, r.child_count, r.fk_count) for r in ready["parent_tables"]().collect()} == {("p0", 3, 6), ("p1", 3, 6)}


def test_older_snapshots_come_from_one_reading_of_a_fact(spark, rows):
    from gaugewright.plans.facts import with_history

    fact = rows([("s", f"d{k}", k * 2, "on") for k in range(40)], "server string, database_name string, n int, state string").distinct()
    every = with_history(fact)
    assert every._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    got = every.collect()
    now = {r.database_name: r.snapshot_ts for r in got if r.state == "on" and r.n == 2 * int(r.database_name[1:] if r.database_name != "gone" else -1) and r.n}
    assert len([r for r in got if r.state == "old"]) == 40 and len(now) >= 39
    assert 0 < len([r for r in got if r.database_name == "gone"]) < 40
    assert all(r.snapshot_ts == now[r.database_name] - timedelta(hours=48) for r in got if r.state == "old" and r.database_name in now)
