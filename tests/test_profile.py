import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from gaugewright.functions.fixed_values import MISSING_TOKENS, ORDINAL_WORDS
from gaugewright.operators import profile as P
from gaugewright.operators import semantics as S
from gaugewright.operators.quantiles import in_ranges, order_statistics


def types(df):
    return {r["column_name"]: (r["physical_type"], r["category"]) for r in S.semantic_category(df).collect()}


def by_name(df):
    return {r["column_name"]: r for r in P.profile(df).collect()}


def test_missing_tokens_are_exact(rows):
    near = ["Null", " NA ", "None", "N/a", "NULL ", "Missing"]
    df = rows([(t,) for t in MISSING_TOKENS + near], "c string")
    kept = [r["c"] for r in S.normalize_missing(df).collect() if r["c"] is not None]
    assert sorted(kept) == sorted(near)
    assert S.normalize_missing(S.normalize_missing(df)).filter("c IS NULL").count() == len(MISSING_TOKENS)


@pytest.mark.parametrize(
    "name, expected",
    [("id", True), ("KEY", True), ("doc_id", True), ("o_orderkey", False), ("user_key", True), ("id_", True), ("valid", False), ("my_uuid", True)],
)
def test_identifier_names(name, expected):
    assert S.is_identifier_name(name) is expected


def test_types_of_numbers(rows):
    data = [(1, 0, i, i / 2, float(i), 1.5 if i < 10 else float(i % 10) + 0.5, float(i) + 0.25, True) for i in range(12)]
    found = types(rows(data, "ones int, zeros int, n bigint, halves double, whole double, ten double, many double, flag boolean"))
    assert found["ones"] == ("INTEGER", "BOOLEAN") and found["zeros"] == ("INTEGER", "BOOLEAN")
    assert found["n"] == ("INTEGER", "NUMERICAL_DISCRETE")
    assert found["halves"] == ("DECIMAL/CONTINUOUS_NUMERIC", "NUMERICAL_CONTINUOUS")
    assert found["whole"] == ("INTEGER", "NUMERICAL_DISCRETE")
    assert found["ten"] == ("DECIMAL/CONTINUOUS_NUMERIC", "NUMERICAL_DISCRETE")
    assert found["many"] == ("DECIMAL/CONTINUOUS_NUMERIC", "NUMERICAL_CONTINUOUS")
    assert found["flag"] == ("BOOLEAN", "BOOLEAN")


@pytest.mark.parametrize("distinct, category", [(10, "NUMERICAL_DISCRETE"), (11, "NUMERICAL_CONTINUOUS")])
def test_ten_or_eleven_values(rows, distinct, category):
    assert types(rows([(i % distinct + 0.5, str(i % distinct)) for i in range(200)], "d double, t string")) == {
        "d": ("DECIMAL/CONTINUOUS_NUMERIC", category), "t": ("INTEGER", category),
    }


def test_types_of_texts(rows):
    data = {
        "dates": ["2024-01-31", "2024/01/31", "31/01/2024", "31-01-2024 "],
        "one_bad": ["2024-01-31", "2024-1-31", "2024-01-31", "2024-01-31"],
        "times": ["2024-01-31 10:11:12", "2024/01/31T10:11:12.5", "2024-01-31 10:11:12Z", " 2024-01-31 10:11:12"],
        "numbers": ["1e5", " 12 ", "3", "4"],
        "suffix": ["1d", "2", "3", "4"],
        "decimals": ["1.5", "2", "3", "4"],
        "infinite": ["inf", "2", "3", "4"],
        "yes": ["Y", "n", "true", "0"],
        "tier": ["Gold", "SILVER", "bronze", "gold"],
        "no_vocab": ["gold", "low", "gold", "gold"],
        "empty": ["", "NULL", "n/a", "nil"],
        "row_id": ["a", "b", "c", "d"],
    }
    found = types(rows(list(zip(*data.values())), ", ".join(f"{c} string" for c in data)))
    assert found == {
        "dates": ("STRING", "DATE"), "one_bad": ("STRING", "CATEGORICAL_NOMINAL"), "times": ("STRING", "TIMESTAMP"),
        "numbers": ("INTEGER", "NUMERICAL_DISCRETE"), "suffix": ("STRING", "CATEGORICAL_NOMINAL"),
        "decimals": ("DECIMAL/CONTINUOUS_NUMERIC", "NUMERICAL_CONTINUOUS"),
        "infinite": ("DECIMAL/CONTINUOUS_NUMERIC", "NUMERICAL_CONTINUOUS"), "yes": ("STRING", "BOOLEAN"),
        "tier": ("STRING", "CATEGORICAL_ORDINAL"), "no_vocab": ("STRING", "CATEGORICAL_NOMINAL"),
        "empty": ("STRING", "CATEGORICAL_NOMINAL"), "row_id": ("STRING", "IDENTIFIER"),
    }


@pytest.mark.parametrize("words", ORDINAL_WORDS.values(), ids=ORDINAL_WORDS)
def test_ordinal_vocabularies(rows, words):
    assert types(rows([(w.title(),) for w in words], "c string"))["c"][1] == "CATEGORICAL_ORDINAL"


def test_all_null_columns(rows):
    found = types(rows([(None, None, None, None, None)], "s string, i int, d double, b boolean, a array<int>"))
    assert [found[c][1] for c in "sidba"] == [
        "CATEGORICAL_NOMINAL", "NUMERICAL_DISCRETE", "NUMERICAL_DISCRETE", "BOOLEAN", "COMPLEX",
    ]


def test_statistics_of_few_rows(rows):
    one = by_name(rows([(5.5,)], "x double"))["x"]["statistics"]
    assert (one["stddev"], one["variance"], one["skewness"], one["kurtosis"], one["median"]) == (0.0, 0.0, 0.0, 0.0, 5.5)
    two = by_name(rows([(1.5,), (2.5,)], "x double"))["x"]["statistics"]
    assert (two["q1"], two["median"], two["q3"], two["skewness"]) == (1.75, 2.0, 2.25, 0.0)
    constant = by_name(rows([(7.0,)] * 9, "x double"))["x"]["statistics"]
    assert (constant["iqr"], constant["skewness"], constant["kurtosis"]) == (0.0, 0.0, 0.0)


def test_corrected_skewness_and_kurtosis(rows):
    values = [1.0, 2.0, 2.0, 3.0, 12.0, 4.5]
    s = by_name(rows([(v,) for v in values], "x double"))["x"]["statistics"]
    n, mean = len(values), statistics.fmean(values)
    m2, m3, m4 = (sum((v - mean) ** k for v in values) / n for k in (2, 3, 4))
    assert s["skewness"] == round(math.sqrt(n * (n - 1)) / (n - 2) * m3 / m2**1.5, 4)
    assert s["kurtosis"] == round((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / m2**2 - 3) + 6), 4)


def test_nan_counts_as_missing(rows):
    p = by_name(rows([(float("nan"),), (None,), (1.5,)], "x double"))["x"]
    assert (p["missing_count"], p["missing_percentage"], p["unique_count"]) == (2, 66.67, 1)


def test_long_texts_are_counted_whole_and_shown_cut(rows):
    long_a, long_b, edge = "x" * 101, "x" * 100 + "y", "z" * 100
    p = by_name(rows([(long_a,), (long_a,), (long_b,), (edge,)], "t string"))["t"]
    assert p["unique_count"] == 3
    assert [(d["value"], d["count"]) for d in p["distribution"]] == [("x" * 97 + "...", 2), ("x" * 97 + "...", 1), (edge, 1)]


def test_ties_at_rank_ten(rows):
    p = by_name(rows([(i,) for i in range(15)] + [(14,)], "n int"))["n"]
    assert [d["value"] for d in p["distribution"]] == ["14"] + [str(i) for i in range(9)]
    assert p["distribution"][0]["percentage"] == 12.5


def test_complex_columns_are_only_counted(rows):
    p = by_name(rows([([1.0], 1), (None, 2)], "v array<float>, n int"))["v"]
    assert (p["category"], p["missing_count"], p["unique_count"], p["distribution"]) == ("COMPLEX", 1, None, [])


def test_empty_table(rows):
    with pytest.raises(P.EmptyTableError, match="no data rows"):
        P.profile(rows([], "a int"))


def test_profile_does_not_depend_on_partitions_or_order(spark):
    df = spark.range(3000).select(
        (F.col("id") % 37).alias("a"), (F.col("id") * 0.25).alias("b"), F.concat(F.lit("v"), F.col("id") % 11).alias("c")
    )
    few = P.profile(df.coalesce(1)).orderBy("position").collect()
    many = P.profile(df.orderBy(F.rand(3)).repartition(64)).orderBy("position").collect()
    assert few == many
    for p in few:
        assert sum(d["count"] for d in p["distribution"]) <= p["non_null_count"]


def test_a_value_in_a_third_of_all_rows(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 1.5).otherwise(F.col("id") + 0.5).alias("x"))
    p = by_name(df)["x"]
    # 1.5 is also the value of id 1.
    assert p["distribution"][0]["count"] == 3001 and p["unique_count"] == 6000
    values = sorted(r["x"] for r in df.collect())
    assert p["statistics"]["median"] == round((values[4499] + values[4500]) / 2, 4)


EXTREMES = [float("-inf"), -1.7e308, -1.0, -5e-324, 0.0, 5e-324, 1e-300, 1.0, 1.0 + 2**-52, 1e308, float("inf")]


def test_order_statistics_of_extreme_values(spark):
    rng = random.Random(7)
    values = EXTREMES + [rng.uniform(-1, 1) * 10 ** rng.randint(-200, 200) for _ in range(500)] + [3.0] * 300
    histogram = (
        spark.createDataFrame([(0, v) for v in values], "key int, value double")
        .groupBy("key", "value").agg(F.count(F.lit(1)).alias("count"))
    )
    ordered = sorted(values)
    ranks = [0, 1, 5, 200, 405, 600, len(values) - 2, len(values) - 1]
    ranged = in_ranges(histogram, "key", "value")
    assert {(r["key"], r["rank"]): r["value"] for r in order_statistics(ranged, [(0, r) for r in ranks]).collect()} == {(0, r): ordered[r] for r in ranks}
    assert order_statistics(ranged, [(0, len(values)), (1, 0)]).count() == 0


@pytest.mark.parametrize("ranges", ["1", "3", "64"])
def test_ranks_do_not_depend_on_the_ranges(spark, ranges):
    """A value that holds most rows, several keys, and more ranges than values."""
    rng = random.Random(9)
    rows = [(k, v) for k in range(3) for v in [float(rng.randint(-20, 20)) for _ in range(400)] + [7.0] * (3000 if k == 1 else 1)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        histogram = spark.createDataFrame(rows, "key int, value double").groupBy("key", "value").agg(F.count(F.lit(1)).alias("count"))
        targets = [(k, r) for k in range(3) for r in (0, 1, 99, 200, 399, 400)] + [(1, 3399)]
        found = {(r["key"], r["rank"]): r["value"] for r in order_statistics(in_ranges(histogram, "key", "value"), targets).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    ordered = {k: sorted(v for key, v in rows if key == k) for k in range(3)}
    assert found == {(k, r): ordered[k][r] for k, r in targets}


def test_numeric_texts_and_any_column_name(rows):
    df = rows([("1", 1, "x"), (" 12 ", 2, "y"), ("inf", 3, "y"), (None, 4, "z")], "num string, `a{0}` int, `b``c` string")
    p = by_name(df)
    assert p["num"]["statistics"]["min"] == 1.0 and p["num"]["unique_count"] == 3
    assert p["a{0}"]["statistics"]["median"] == 2.5 and p["b`c"]["distribution"][0]["value"] == "y"
    assert {r["column_name"]: r["mode"] for r in P.mode(df).collect()}["b`c"] == "y"
    assert {r["column_name"]: r["unique_count"] for r in P.unique_counts(df).collect()} == {"num": 3, "a{0}": 4, "b`c": 3}


def test_mode_is_the_whole_value(rows):
    long = "m" * 500
    got = P.mode(rows([(long, 1), (long, 1), ("a", 2)], "t string, n int")).collect()
    assert {r["column_name"]: (r["mode"], r["count"]) for r in got} == {"t": (long, 2), "n": ("1", 2)}


def test_approximate_profile(spark):
    df = spark.range(20000).select((F.col("id") * 0.5).alias("x"))
    p = P.profile(df, approximate=True).first()
    assert abs(p["unique_count"] - 20000) < 3000 and abs(p["statistics"]["median"] - 5000) < 5


def test_approximate_top_values_without_a_histogram(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 1.5).otherwise(F.col("id") + 0.25).alias("x"), F.concat(F.lit("v"), F.col("id") % 4).alias("t"), F.lit(None).cast("int").alias("n"))
    p = {r["column_name"]: r for r in P.profile(df, approximate=True).collect()}
    assert (p["x"]["distribution"][0]["value"], p["x"]["distribution"][0]["count"]) == ("1.5", 3000)
    assert sorted((d["value"], d["count"]) for d in p["t"]["distribution"]) == [(f"v{i}", 2250) for i in range(4)]
    assert p["n"]["distribution"] == []


def test_plan_has_group_limit_and_no_python(spark):
    df = spark.range(1000).select("id", F.concat(F.lit("v"), F.col("id") % 5).alias("t"))
    plan = P.distribution(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Python" not in plan and "CartesianProduct" not in plan


def test_completeness_is_one_aggregate(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(10).withColumn("x", F.lit(1.5)).write.parquet(path)
    plan = P.completeness(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_outliers(rows):
    s = P.shape(rows([(float(v),) for v in [*range(1, 20), 500.5]], "x double")).first()
    assert (s["outlier_count"], s["skew_direction"], s["skew_severity"]) == (1, "right", "high")


def test_outliers_among_small_numbers(rows):
    s = P.shape(rows([(v * 1e-6,) for v in [*range(1, 20), 500.5]], "x double")).first()
    assert s["outlier_count"] == 1 and s["upper_fence"] == pytest.approx(29.5e-6, rel=1e-6)


def test_wide_table(spark, monkeypatch):
    monkeypatch.setattr(P, "COLUMNS_PER_HISTOGRAM", 7)
    df = spark.range(50).select(*[(F.col("id") * i).alias(f"n{i}") for i in range(1, 20)], *[F.lit(f"x{i}").alias(f"t{i}") for i in range(9)])
    found = by_name(df)
    assert len(found) == 28 and found["n19"]["statistics"]["max"] == 931.0 and found["t8"]["unique_count"] == 1
    assert all(found[f"n{i}"]["statistics"]["median"] == 24.5 * i for i in range(1, 20))


def test_table_of_complex_columns_only(rows):
    df = rows([([1],), (None,)], "a array<int>")
    assert P.distribution(df).count() == 0 and P.unique_counts(df).first()["unique_count"] is None
    assert P.profile(df).first()["missing_count"] == 1


def test_unique_counts_of_numeric_texts(rows):
    assert P.unique_counts(rows([("1",), ("1.0",), ("NULL",)], "t string")).first()["unique_count"] == 2
