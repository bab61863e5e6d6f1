"""Collection runs, histories, and names that hold any sign."""

from datetime import datetime, timedelta

import pytest

from gaugewright.operators import catalogue as C
from gaugewright.operators import operations as O
from gaugewright.operators import relations as L
from gaugewright.operators import storage as G
from gaugewright.operators.snapshots import collection_runs, current, history

DAY = datetime(2024, 1, 1)
FACT = "server string, database_name string, snapshot_ts timestamp, value int"


def at(minutes, day=0):
    return DAY + timedelta(days=day, minutes=minutes)


def found(df):
    return sorted((r.server, r.database_name, r.value) for r in df.collect())


def test_databases_read_one_after_another_are_one_run(rows):
    data = [("s", f"d{k}", at(k * 10), k) for k in range(8)] + [("s", f"d{k}", at(k, day=-1), 100 + k) for k in range(9)] + [("r", "x", at(0, day=-3), 7)]
    assert found(current(rows(data, FACT))) == [("r", "x", 7)] + [("s", f"d{k}", k) for k in range(8)]


def test_a_database_dropped_before_the_last_run_is_gone(rows):
    data = [("s", "old", at(0, -1), 1), ("s", "kept", at(1, -1), 2), ("s", "kept", at(0), 3)]
    assert found(current(rows(data, FACT))) == [("s", "kept", 3)]


def test_a_database_read_twice_in_a_run_counts_once(rows):
    data = [("s", "a", at(0), 1), ("s", "b", at(10), 2), ("s", "a", at(20), 3), ("s", "a", at(20), 4)]
    assert found(current(rows(data, FACT))) == [("s", "a", 3), ("s", "a", 4), ("s", "b", 2)]
    assert found(current(rows(data, FACT), gap="5 minutes")) == [("s", "a", 3), ("s", "a", 4)]


def test_nulls_empties_and_facts_without_times(rows):
    data = [("s", None, at(0), 1), (None, "a", at(0), 2), (None, "a", None, 3), ("t", "b", None, 4)]
    assert [r.value for r in current(rows(data, FACT)).orderBy("value").collect()] == [1, 2, 4]
    assert current(rows([], FACT)).count() == 0
    assert current(rows([("s", 1), ("s", 2)], "server string, value int")).count() == 2
    only_server = rows([("s", at(0), 1), ("s", at(0, -1), 2)], "server string, snapshot_ts timestamp, value int")
    assert [r.value for r in current(only_server).collect()] == [1]


def test_runs_of_several_facts(rows):
    one = rows([("s", "a", at(0), 1), ("s", "a", at(60), 1)], FACT)
    two = rows([("s", at(10)), ("s", at(65)), ("r", at(5))], "server string, snapshot_ts timestamp")
    got = {(r.server, r.run_start, r.run_end, r.snapshots) for r in collection_runs(one, two).collect()}
    assert got == {("s", at(0), at(10), 2), ("s", at(60), at(65), 2), ("r", at(5), at(5), 1)}


@pytest.mark.parametrize("gap,runs", [("9 minutes", 4), ("11 minutes", 1)])
def test_gap(rows, gap, runs):
    assert collection_runs(rows([("s", "a", at(10 * k), k) for k in range(4)], FACT), gap=gap).count() == runs


def test_storage_of_databases_read_a_second_apart(rows):
    schema = "server string, database_name string, snapshot_ts timestamp, schema_name string, table_name string, engine string, data_bytes bigint, index_bytes bigint, row_count bigint"
    tables = rows([("s", "d1", DAY, "p", "a", "e", 1, 1, 1), ("s", "d2", DAY + timedelta(seconds=1), "p", "b", "e", 2, 2, 1)], schema)
    assert G.storage_by_group(tables).first()["table_count"] == 2


def test_backups_and_job_runs_are_read_over_all_snapshots(rows):
    backups = rows(
        [("s", "d", at(0, -1), "D", at(-60, -1), 5), ("s", "d", at(0), "L", at(-60), 1), ("s", "d", at(0, -1), "L", at(-90, -1), 1), ("s", "d", at(0), "L", at(-90, -1), 1)],
        "server string, database_name string, snapshot_ts timestamp, backup_type string, finish_ts timestamp, bytes bigint",
    )
    databases = rows([("s", "d", at(0)), ("s", "e", at(0)), ("s", "dropped", at(0, -1))], "server string, database_name string, snapshot_ts timestamp")
    late = O.databases_without_recent_backup(databases, backups, "2024-01-02 00:00:00")
    assert [(r.database_name, r.last_full_backup) for r in late.collect()] == [("e", None)]
    assert history(backups).count() == 3 and O.latest_backups(backups).count() == 3
    jobs = rows([("s", "d", at(0), "j", "u")], "server string, database_name string, snapshot_ts timestamp, job_name string, owner string")
    runs = rows(
        [("s", "d", at(0, -1), "j", at(-9, -1), 0, "x"), ("s", "d", at(0), "j", at(-9, -1), 0, "x"), ("s", "d", at(0, -1), "j", at(-19, -1), 0, "y")],
        "server string, database_name string, snapshot_ts timestamp, job_name string, run_ts timestamp, status int, message string",
    )
    assert [r.message for r in C.failed_job_runs(jobs, runs).collect()] == ["x", "y"]


def test_dependencies_stay_with_their_server_and_run(rows):
    edges = rows(
        [("s", "d", at(0), "v", "t"), ("r", "d", at(0), "v", "t"), ("s", "d", at(0, -1), "v", "gone"), ("s", "d", at(0), "v", "v")],
        "server string, database_name string, snapshot_ts timestamp, referencing string, referenced string",
    )
    assert sorted((r.server, r.referenced) for r in C.view_dependencies(edges).collect()) == [("r", "t"), ("s", "t")]
    assert C.view_dependencies(rows([("v", "t")], "referencing string, referenced string")).columns == ["referencing", "referenced"]


def test_names_with_separators_do_not_collide(rows):
    fk = rows(
        [("s", "d", "f1", "a", "c.x", "p", "t"), ("s", "d", "f2", "a.c", "x", "p", "t")],
        "server string, database_name string, constraint_name string, child_schema string, child_table string, parent_schema string, parent_table string",
    )
    assert L.parent_tables(fk).first()["child_count"] == 2
    index = "server string, database_name string, schema_name string, table_name string, index_name string, column_name string, position int"
    columns = rows([("s", "d", "p", "t", "i1", "a, b", 1), ("s", "d", "p", "t", "i2", "a", 1), ("s", "d", "p", "t", "i2", "b", 2), ("s", "d", "p", "t", "i3", "a", 1)], index)
    assert [(r.kind, r.column_list, r.index_count) for r in L.duplicate_indexes(columns).collect()] == [("prefix overlap", "a", 1)]
    assert L.duplicate_index_names(columns).count() == 0


def test_a_fact_is_not_shuffled_by_its_few_databases(spark, rows):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fact = rows([("s", "a", at(0), 1), ("s", "a", at(0, -1), 2), ("s", "b", at(5), 3)], FACT)
        plan = current(fact)._jdf.queryExecution().executedPlan().toString()
        assert found(current(fact)) == [("s", "a", 1), ("s", "b", 3)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
