"""States of parts of a table: merged they give the profile of the whole, within the bounds stated."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gaugewright.operators import profile as P
from gaugewright.operators import semantics as S
from gaugewright.operators import sketches as K


@pytest.fixture(scope="module")
def table(spark):
    draw = random.Random(3)
    long = "x" * 120
    rows = [
        (k, draw.gauss(1e6, 3.0), draw.choice("abc"), None if k % 9 == 0 else k % 4, str(draw.randint(0, 5)), f"{long}{k % 5}", k % 2 == 0, datetime(2024, 1, 1 + k % 3, 5), "N/A" if k % 2 else "y")
        for k in range(6000)
    ]
    return spark.createDataFrame(rows, "n bigint, g double, t string, few int, digits string, long string, b boolean, ts timestamp, gap string")


def by_name(df):
    return {r["column_name"]: r.asDict(recursive=True) for r in df.collect()}


def test_merged_parts_are_the_profile_of_the_whole(table):
    parts = [K.states(table.filter(F.col("n") % 3 == k)) for k in range(3)]
    merged, whole, exact = by_name(K.profile_of(K.merge(*parts))), by_name(P.profile(table, approximate=True)), by_name(P.profile(table))
    days = by_name(K.profile_of(K.merge(K.states(table, F.to_date("ts")).drop("part"))))
    for name, e in exact.items():
        for got in (merged[name], whole[name], days[name]):
            for field in ("position", "physical_type", "category", "spark_type", "total_rows", "non_null_count", "missing_count", "missing_percentage"):
                assert got[field] == e[field], (name, field)
            assert got["unique_count"] == pytest.approx(e["unique_count"], rel=0.02)
            if e["unique_count"] < 30:
                assert got["distribution"] == e["distribution"] and got["unique_count"] == e["unique_count"]
            assert (got["statistics"] is None) == (e["statistics"] is None)
            if e["statistics"]:
                for s in ("min", "max", "mean", "variance", "stddev", "skewness", "kurtosis"):
                    assert got["statistics"][s] == pytest.approx(e["statistics"][s], rel=1e-6, abs=2e-4), (name, s)
                ordered = sorted(float(r[0]) for r in table.select(name).dropna().collect())
                for q, s in ((0.25, "q1"), (0.5, "median"), (0.75, "q3")):
                    low, high = (ordered[max(0, min(len(ordered) - 1, int((q + d) * len(ordered))))] for d in (-0.004, 0.004))
                    assert low - 1e-4 <= got["statistics"][s] <= high + 1e-4, (name, s)


def test_merging_months_reads_the_table_once(spark, tmp_path):
    """profile_merged read and turned it a second time, for the means."""
    from gaugewright.plans.registry import QUERIES

    days = spark.range(900).selectExpr(
        "id", "CAST(id % 7 AS INT) l_linenumber", "CAST(id % 50 AS DOUBLE) l_quantity", "id % 3 / 100D l_discount", "0.5D l_tax", "IF(id % 5 = 0, NULL, 'R') l_returnflag", "'O' l_linestatus",
        "IF(id % 9 = 0, NULL, timestampadd(DAY, CAST(id AS INT), TIMESTAMP '1968-06-01 10:00:00')) l_shipdate",
    )
    days.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    taken = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            taken.add(batch.num_rows)
            yield batch

    read = spark.read.parquet(f"{tmp_path}/lineitem.parquet")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr("gaugewright.plans.profile_queries.source", lambda *_: read.mapInArrow(counted, read.schema))
        found = {r.column_name: r for r in QUERIES["profile_merged"].run(spark, str(tmp_path)).collect()}
    assert taken.value == 900
    assert (found["l_quantity"].mean, found["l_quantity"].unique_count, found["l_quantity"].top_count) == (24.5, 50, 18)
    assert (found["l_returnflag"].non_null_count, found["l_returnflag"].top_count, found["l_discount"].max) == (720, 720, 0.02)


def test_states_by_dates_are_those_by_texts(rows):
    """Dates of any age, and none, are parts of their own, and are grouped by one number: a sort of texts took long."""
    days = ["0001-01-01", "1969-12-31", "1970-01-01", "9999-12-31", None, "1970-01-01"]
    df = rows([(d, k, "ab"[k % 2]) for k, d in enumerate(days)], "d string, k int, t string")
    shown = lambda part: K.states(df, part).select(F.col("part").cast("string"), *K.KEYS, *K.EXACT, "mean", "m2")
    by_date = K.states(df, F.to_date("d"))
    assert sorted(map(repr, shown(F.to_date("d")).collect())) == sorted(map(repr, shown(F.col("d")).collect()))
    assert by_date.schema["part"].dataType.typeName() == "date" and by_date.count() == 15
    assert f"keys=[{K.CELL_KEY}" in by_date._jdf.queryExecution().toString()


def test_long_texts_with_one_beginning_stay_apart(rows):
    start = "s" * 97
    df = rows([(start + "abcdef",)] * 3 + [(start + "abcdeg",)] * 2, "t string")
    for p in (P.profile(df, approximate=True).first(), P.profile(df).first()):
        assert p["unique_count"] == 2 and [d["count"] for d in p["distribution"]] == [3, 2]
        assert {d["value"] for d in p["distribution"]} == {start + "..."}


def test_parts_are_stored_and_replaced(table, spark, tmp_path):
    folder = str(tmp_path)
    K.add_part(table.filter("n < 1000"), folder, "t", "one")
    K.add_part(table.filter("n >= 1000"), folder, "t", "two")
    K.add_part(table.filter("n >= 1000"), folder, "t", "two")
    found = by_name(K.stored_profile(spark, folder, "t"))
    assert found["n"]["total_rows"] == 6000 and found["t"]["distribution"] == by_name(P.profile(table))["t"]["distribution"]


def test_edges(rows):
    with pytest.raises(P.EmptyTableError):
        P.profile(rows([], "a int"), approximate=True)
    empty, some = rows([], "a int, b string"), rows([(1, None)], "a int, b string")
    p = by_name(K.profile_of(K.merge(K.states(empty), K.states(some))))
    assert p["a"]["total_rows"] == 1 and p["a"]["statistics"]["variance"] == 0.0 and p["b"]["unique_count"] == 0 and p["b"]["distribution"] == []
    odd = rows([(float("nan"), [1]), (0.0, None), (-0.0, [2])], "`x.y` double, `l``` array<int>")
    q = by_name(P.profile(odd, approximate=True))
    assert q["x.y"]["non_null_count"] == 2 and q["x.y"]["unique_count"] == 1 and q["l`"]["unique_count"] is None




@pytest.mark.parametrize("wide", [False, True])
def test_evidence_takes_two_scans_at_most(spark, tmp_path, monkeypatch, wide):
    if wide:
        path = str(tmp_path / "w")
        spark.range(50).select(*[(F.col("id") * k % 7 if k % 2 else F.concat(F.lit("v"), F.col("id") % k)).alias(f"c{k}") for k in range(1, 201)]).write.option("header", True).csv(path)
        df = spark.read.option("header", True).csv(path)
    else:
        df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plans = []
    collect = type(df).collect

    def counted(self):
        plans.append(self._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
        return collect(self)

    monkeypatch.setattr(type(df), "collect", counted)
    evidence, facts = S.column_evidence(S.normalize_missing(df), moments=True)
    assert len(evidence) == len(df.columns) and 1 <= sum(plans) <= 2
    assert all("kurt" in facts[e.position] for e in evidence)
