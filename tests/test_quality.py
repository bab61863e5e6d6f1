from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from gaugewright.functions import fixed_values as V
from gaugewright.operators import imputation as I
from gaugewright.operators import profile as P
from gaugewright.operators import quality as Q
from gaugewright.operators import rollup as R


def found(df):
    return {(r["column_name"], r["issue_type"]): r for r in Q.quality_issues(df).collect()}


def test_identifier_blank(rows):
    got = found(rows([("",), (" \t",), (None,), ("a",)], "user_id string"))
    issue = got[("user_id", "IDENTIFIER_NULL")]
    assert (issue["affected_count"], issue["affected_percentage"], issue["severity"]) == (3, 75.0, "ERROR")
    assert issue["examples"] == ["", " \t"]


def test_identifier_null_example(rows):
    assert found(rows([(None,), (1,)], "x_id int"))[("x_id", "IDENTIFIER_NULL")]["examples"] == ["NULL"]


def test_outer_space(rows):
    got = found(rows([("a\n",), ("　b",), ("c d",), (None,)], "t string"))
    assert got[("t", "LEADING_TRAILING_SPACES")]["affected_count"] == 2


def test_examples_are_five_smallest(rows):
    df = rows([(f" {c}",) for c in "gfedcba"], "t string")
    assert found(df)[("t", "LEADING_TRAILING_SPACES")]["examples"] == [" a", " b", " c", " d", " e"]


@pytest.mark.parametrize("values, count", [(["1", "2"], None), (["a", "b"], None), (["1", "b", " 3 "], 2), (["NaN", "x"], None)])
def test_mixed_numeric(rows, values, count):
    got = found(rows([(v,) for v in values], "t string")).get(("t", "MIXED_NUMERIC_TEXT"))
    assert (got and got["affected_count"]) == count


def test_one_number_in_many_texts_is_found(spark):
    df = spark.range(5000).select(F.when(F.col("id") == 4321, "7").otherwise("x").alias("t"))
    assert found(df)[("t", "MIXED_NUMERIC_TEXT")]["affected_count"] == 1


def test_clean_table_has_no_issues(rows):
    assert Q.quality_issues(rows([("a", 1)], "t string, n int")).count() == 0


def summary(df):
    r = Q.duplicates(df).first()
    return r["duplicate_group_count"], r["duplicate_extra_record_count"], r["audit_columns"]


def test_duplicates(rows):
    df = rows([(1, "a", None), (2, "a", None), (3, "b", 1.0), (4, "a", None)], "id int, t string, d double")
    assert summary(df) == (1, 2, "id")


def test_duplicates_of_audit_columns_only(rows):
    assert summary(rows([(1, 1), (1, 1), (2, 1)], "id int, row_id int")) == (1, 1, "id, row_id")


def test_duplicates_treat_tokens_zero_and_nan_alike(rows):
    nan = float("nan")
    df = rows([("NULL", 0.0, nan), (None, -0.0, nan)], "t string, z double, n double")
    assert summary(df)[:2] == (1, 1)


def test_long_texts_differing_at_the_end(rows):
    a = "q" * 5000
    assert summary(rows([(a + "1",), (a + "2",), (a + "1",)], "t string"))[:2] == (1, 1)


def test_duplicates_do_not_depend_on_order(spark):
    df = spark.range(900).select((F.col("id") % 100).alias("a"), F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 4).alias("b"))
    assert summary(df.repartition(32).orderBy(F.rand(1))) == summary(df.coalesce(1))


def test_map_columns_can_be_compared(rows):
    assert summary(rows([({"a": 1},), ({"a": 1},)], "m map<string,int>"))[:2] == (1, 1)


def methods(df, **kw):
    return {r["column_name"]: r["recommended_method"] for r in I.recommend(P.profile(df), **kw).collect()}


def test_recommendations(rows):
    data = [(i, float(i) + 0.5, float(3**i) + 0.5, "ab"[i % 2], date(2024, 1, 1 + i), True) for i in range(12)]
    data.append((None,) * 6)
    df = rows(data, "n int, even double, skewed double, t string, d date, b boolean")
    assert methods(df) == {
        "n": V.METHOD_MEAN, "even": V.METHOD_MEAN, "skewed": V.METHOD_MEDIAN, "t": V.METHOD_MODE,
        "d": V.METHOD_CONSTANT, "b": V.METHOD_MODE,
    }
    assert methods(df, bulk=True)["d"] == V.METHOD_DATE
    assert methods(df.filter("n IS NOT NULL"))["n"] == V.METHOD_NONE


def test_skew_of_exactly_one_is_mean(rows):
    base = P.profile(rows([(1.5,), (None,)], "x double"))
    for skew, method in [(1.0, V.METHOD_MEAN), (1.0001, V.METHOD_MEDIAN), (-1.5, V.METHOD_MEDIAN)]:
        p = base.withColumn("statistics", F.col("statistics").withField("skewness", F.lit(skew))).withColumn(
            "category", F.lit("NUMERICAL_CONTINUOUS")
        )
        row = I.recommend(p).first()
        assert row["recommended_method"] == method
        if method == V.METHOD_MEDIAN:
            assert f"|skew|={abs(skew):.2f} > 1.0" in row["reason"]


def test_imputation_fills_and_flags(rows):
    df = rows([(1.5, "a"), (2.5, "b"), (None, "b"), (2.5, "NULL")], "x double, t string")
    got = I.apply_imputation(df, ["x", "t"], {"x": "median"}, flag=True).collect()
    assert [tuple(r) for r in got] == [
        (1.5, "a", False, False), (2.5, "b", False, False), (2.5, "b", True, False), (2.5, "b", False, True),
    ]


def test_fills_keep_the_type_and_what_is_there(rows):
    from decimal import Decimal

    big, exact = 9007199254740993, Decimal("12345678901234567.1234567891")
    df = rows([(big, exact, 1e-6), (None, None, None), (big + 2, exact, 3e-6)], "n bigint, d decimal(30,10), x double")
    out = I.apply_imputation(df, ["n", "d", "x"], {c: "mean" for c in "ndx"})
    assert out.dtypes == df.dtypes
    got = out.collect()
    assert (got[0][0], got[2][0], got[0][1]) == (big, big + 2, exact)
    assert got[1]["x"] == pytest.approx(2e-6, rel=1e-9) and got[1]["n"] in range(big - 2, big + 4)


def test_duplicate_groups_are_whole_and_told_apart(rows):
    a = "q" * 300
    got = Q.duplicate_groups(rows([(a + "1",), (a + "2",), (a + "1",), (a + "2",), ("x",)], "t string")).collect()
    assert {r["t"] for r in got} == {a + "1", a + "2"} and len({r["group_key"] for r in got}) == 2


def test_carrying_forward_by_text(rows):
    df = rows([(1, "b", 5), (1, "a", None), (1, "c", None), (None, "a", 7), (None, "b", None)], "k int, o string, v int")
    got = I.carry_forward(df, "v", ("k",), ("o",)).collect()
    assert {(r["k"], r["o"]): r["v"] for r in got} == {(1, "a"): None, (1, "b"): 5, (1, "c"): 5, (None, "a"): 7, (None, "b"): 7}


def test_constant_imputation(rows):
    df = rows([("a",), (None,)], "t string")
    got = I.apply_imputation(df, ["t"], {"t": "constant"}, {"t": "?"}).collect()
    assert [r["t"] for r in got] == ["a", "?"]


def test_mode_of_long_texts_is_whole(rows):
    text = "y" * 300
    got = I.apply_imputation(rows([(text,), (text,), ("a",), (None,)], "t string"), ["t"]).collect()
    assert got[3]["t"] == text


def test_date_rules(rows):
    d = date(2024, 5, 1)
    df = rows([(1, 1, d), (1, 2, None), (2, 1, None), (2, 2, date(2024, 6, 1))], "k int, o int, d date")
    carried = I.apply_date_rules(df, {"d": I.DateRule("forward", partition_by=("k",), order_by=("o",))})
    assert [r["d"] for r in carried.orderBy("k", "o").collect()] == [d, d, None, date(2024, 6, 1)]
    latest = I.apply_date_rules(df, {"d": I.DateRule("max")})
    assert latest.filter(F.col("d") == date(2024, 6, 1)).count() == 3
    with pytest.raises(ValueError):
        I.apply_date_rules(df, {"d": I.DateRule("forward")})


def test_quality_overview_mixes_cells_and_issues(rows):
    df = rows([("a ", None), ("1", 2)], "t string, x_id int")
    got = {r["label"]: r["value"] for r in R.quality_overview(P.profile(df), Q.quality_issues(df)).collect()}
    assert got == {"Complete Data Cells": 3, "Missing Cells": 1, "Confirmed Inconsistencies": 2, "Potential Anomalies": 1}


def test_carrying_forward_over_a_hot_key(spark):
    df = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, F.lit(None).cast("int")).otherwise(F.lit(1)).alias("k"), F.col("id").alias("o"),
        F.when(F.col("id") % 50 < 3, F.date_add(F.lit(date(2020, 1, 1)), F.col("id").cast("int"))).alias("d"),
    )
    got = I.apply_date_rules(df.repartition(16), {"d": I.DateRule("forward", partition_by=("k",), order_by=("o",))})
    last, want = {}, {}
    for r in df.orderBy("o").collect():
        last[r["k"]] = r["d"] or last.get(r["k"])
        want[r["o"]] = last[r["k"]]
    assert {r["o"]: r["d"] for r in got.collect()} == want


def test_table_report(rows):
    from gaugewright.operators.report import table_report

    report = table_report(rows([("a ", 1.5), ("b", None), ("b", None)], "t string, x double"))
    s = report["summary"].first()
    assert (s["total_rows"], s["missing_cells"], s["duplicate_groups"], s["inconsistencies"]) == (3, 2, 1, 1)
    assert report["affected_columns"].first()["column_name"] == "t"
    assert all(df.columns for df in report.values())


def test_rows_a_microsecond_apart_are_no_duplicates(rows):
    at = [datetime(2024, 1, 1, 5, 6, 7, us) for us in (123456, 123999, 123456)]
    df = rows([(t, {"k": t}, [t], 1) for t in at], "t timestamp, m map<string,timestamp>, a array<timestamp>, n int")
    for columns in (["t"], ["a"], ["m"], ["t", "a", "m", "n"]):
        assert [r["row_count"] for r in Q.duplicate_groups(df, columns).collect()] == [2]
    assert Q.duplicates(df).first()["duplicate_extra_record_count"] == 1


def test_places_of_nulls_and_borders_of_texts_count(rows):
    df = rows([(None, "a", "bc"), ("a", None, "bc"), ("ab", "c", None), ("a", "bc", None), (None, "a", "bc")], "x string, y string, z string")
    assert [tuple(r)[1:] for r in Q.duplicate_groups(df).collect()] == [(None, "a", "bc", 2)]


def test_columns_without_any_value_stay_empty_or_take_a_constant(rows):
    df = rows([(None, None, 1), (None, "N/A", 2)], "x double, t string, n int")
    assert [tuple(r) for r in I.apply_imputation(df, ["x", "t"]).orderBy("n").collect()] == [(None, None, 1), (None, None, 2)]
    assert [tuple(r) for r in I.apply_imputation(df, ["x", "t"], {"x": "mean"}, {"x": 1.5, "t": "u"}).orderBy("n").collect()] == [(1.5, "u", 1), (1.5, "u", 2)]
