import pytest
from pyspark.sql import functions as F

from gaugewright.operators.rollup import run_totals
from gaugewright.plans.materialize import materialize, shared_folder
from gaugewright.sources import readers, writers
from gaugewright.sources.bulk import TableKey, cached_profile, collect_all, profile_many


@pytest.mark.parametrize("ext", ["csv", "parquet", "json"])
def test_write_and_read_back(spark, tmp_path, ext):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, t string")
    path = writers.write_output(df, str(tmp_path / f"x.{ext}"))
    assert path.endswith(f"x_imputed.{ext}")
    back = readers.read_file(spark, path).select(F.col("n").cast("int"), "t")
    assert sorted(map(tuple, back.collect())) == [(1, "a"), (2, "b")]


def test_output_names():
    assert writers.output_path("/d/a.b/x.xlsx") == "/d/a.b/x_imputed.csv"
    assert writers.output_path("x", "y.txt") == "y.csv"
    assert writers.output_path("x", "y.json") == "y.json"


def test_unknown_extension(spark):
    with pytest.raises(readers.UnsupportedFormatError, match="Unsupported file format: .xlsx"):
        readers.read_file(spark, "/tmp/x.xlsx")


def test_jdbc_options():
    options = readers.jdbc_options("jdbc:x", "t", "id", ("1", "100"), 8)
    assert options["numPartitions"] == "8" and options["pushDownLimit"] == "true"
    with pytest.raises(ValueError):
        readers.jdbc_options("jdbc:x", "t")
    with pytest.raises(ValueError):
        readers.jdbc_options("jdbc:x", "t", "id")
    assert "partitionColumn" not in readers.jdbc_options("jdbc:x", "t", limit=10)


def test_quoted_names():
    assert readers.quote_table("s", 'a"b') == '"s"."a""b"'
    assert readers.quote_table("s", "a`b", "mysql") == "`s`.`a``b`"
    assert readers.quote_table(None, "t]", "sqlserver") == "[t]]]"


@pytest.mark.parametrize("asked, given", [(1, 1), (5, 5), (1000, 500)])
def test_sample_rows(spark, asked, given):
    assert readers.sample_rows(spark.range(500), asked).count() == given
    assert readers.sample_rows(spark.range(500).repartition(7), asked, ["id"]).agg(F.max("id")).first()[0] == given - 1
    with pytest.raises(ValueError):
        readers.sample_rows(spark.range(5), 0)


def test_fan_out_skips_failing_databases(spark, tmp_path):
    def run(name):
        if name == "b":
            raise ValueError("down")
        if name == "late":
            return spark.range(2).select(F.raise_error(F.lit("gone")).alias("id"))
        return spark.range(2)

    df, errors = readers.fan_out_union(spark, run, ["a", "b", "c", "late"], str(tmp_path))
    assert df.groupBy("database_name").count().count() == 2 and set(errors) == {"b", "late"} and errors["b"] == "down"
    assert readers.fan_out_union(spark, run, ["b"], str(tmp_path)) == (None, {"b": "down"})


def test_bulk_run_goes_on_after_a_failure_and_resumes(spark, tmp_path):
    folder, calls = str(tmp_path), []

    def load(name, rows):
        def make():
            calls.append(name)
            return spark.range(rows).select((F.col("id") * 0.5).alias("x"), F.lit("a").alias("t"))

        return make

    tables = {TableKey("a"): load("a", 10), TableKey("b", "v1", 3): load("b", 10), TableKey("empty"): load("empty", 0)}
    totals = run_totals(profile_many(spark, tables, folder, threads=2)).first()
    assert tuple(totals) == (2, 1)
    assert cached_profile(spark, TableKey("b", "v1", 3), folder).first()["total_rows"] == 3
    assert cached_profile(spark, TableKey("b", "v2", 3), folder) is None
    calls.clear()
    tables[TableKey("empty")] = load("empty", 4)
    assert tuple(run_totals(profile_many(spark, tables, folder)).first()) == (3, 0)
    assert calls == ["empty"]


def test_collect_all_isolates_failures(spark, tmp_path):
    def fail():
        raise RuntimeError("no such table")

    log = {r["report"]: r["error"] for r in collect_all(spark, {"good": lambda: spark.range(3), "bad": fail}, str(tmp_path)).collect()}
    assert log == {"good": None, "bad": "no such table"}
    assert spark.read.parquet(str(tmp_path / "good")).count() == 3


def test_materialize_uses_the_shared_folder(spark):
    df = materialize(spark.range(5))
    assert df.count() == 5 and shared_folder(spark) in df.inputFiles()[0]
