import pytest
from pyspark.sql import functions as F

from gaugewright.functions import status as T
from gaugewright.functions import text as X


def one(spark, column, value, dtype="string"):
    return spark.createDataFrame([(value,)], f"c {dtype}").select(column(F.col("c"))).first()[0]


@pytest.mark.parametrize(
    "text, number",
    [("12", 12.0), (" 12 ", 12.0), ("1e5", 1e5), ("-.5", -0.5), ("1d", None), ("1f", None), ("NaN", None), ("", None),
     ("1_0", None), ("inf", float("inf")), ("12x", None), (" 12　", 12.0), ("1.", 1.0), (".", None)],
)
def test_number_of(spark, text, number):
    assert one(spark, X.number_of, text) == number
    assert spark.createDataFrame([(text,)], "c string").select(F.expr(X.number_sql("c"))).first()[0] == number


@pytest.mark.parametrize(
    "size, shown",
    [(None, "-"), (0, "0 B"), (1023, "1023 B"), (1024, "1.00 KB"), (1536, "1.50 KB"), (1048576, "1.00 MB"),
     (1024**3, "1.00 GB"), (1024**4, "1.00 TB"), (1024**5, "1.00 PB"), (2000 * 1024**5, "2000.00 PB")],
)
def test_format_size(spark, size, shown):
    assert one(spark, X.format_size, size, "bigint") == shown


@pytest.mark.parametrize(
    "text, shown",
    [(None, "-"), ("", "-"), ("3.14159", "3.14"), ("2.5 MB", "2.50 MB"), ("99.456%", "99.46 %"), ("abc", "abc"), ("12", "12")],
)
def test_format_numeric(spark, text, shown):
    assert one(spark, X.format_numeric, text) == shown


@pytest.mark.parametrize(
    "text, mb",
    [("1 GB", 1024.0), ("2 TB", 2097152.0), ("512 KB", 0.5), ("1048576 B", 1.0), ("1048576 Bytes", 1.0), ("7", 7.0),
     ("-", 0.0), ("N/A", 0.0), ("1.2.3 MB", 0.0), ("size 3 mb", 3.0)],
)
def test_parse_size(spark, text, mb):
    assert one(spark, X.parse_size_mb, text) == mb


@pytest.mark.parametrize(
    "text, label",
    [("  'a   b'\n", "a b"), (None, "N/A"), ("", "N/A"), ("x" * 35, "x" * 35), ("x" * 36, "x" * 35 + "...")],
)
def test_clean_label(spark, text, label):
    assert one(spark, X.clean_label, text) == label


@pytest.mark.parametrize("n, shown", [(999, "999"), (1000, "1.0K"), (43645, "43.6K"), (2_500_000, "2.5M"), (12_345_678, "12.35M")])
def test_short_count(spark, n, shown):
    assert one(spark, X.short_count, n, "bigint") == shown


@pytest.mark.parametrize("size, shown", [(0, "0.00 MB"), (1048576, "1.0 MB"), (1024**3 * 5 // 2, "2.5 GB")])
def test_footprint(spark, size, shown):
    assert one(spark, X.footprint_text, size, "bigint") == shown


def test_rounding_is_half_even(spark):
    assert [one(spark, lambda c: X.rounded(c, 1), v, "double") for v in (0.25, 0.35, -0.25)] == [0.2, 0.4, -0.2]


def test_percent_of_nothing(spark):
    row = spark.createDataFrame([(0, 0)], "a bigint, b bigint").select(X.percent(F.col("a"), F.col("b"))).first()
    assert row[0] == 0.0


def test_bare_definition(spark):
    assert one(spark, X.bare_definition, "CREATE UNIQUE INDEX ix1 ON t (a)") == "CREATE INDEX ON t (a)"
    assert one(spark, X.bare_definition, "create index ix2 on t (a)") == "CREATE INDEX ON t (a)"


@pytest.mark.parametrize(
    "metric, value, name",
    [("cpu", 59.9, "Normal"), ("cpu", 60.0, "Elevated"), ("cpu", 80.0, "High"), ("cpu", 90.0, "Critical"),
     ("cache", 98.0, "Healthy"), ("cache", 90.0, "Elevated"), ("cache", 89.9, "Needs Attention"),
     ("blocking", 0.0, "Normal"), ("blocking", 5.0, "Elevated"), ("blocking", 6.0, "Critical"),
     ("iops", 2999.0, "Healthy"), ("iops", 3000.0, "Elevated"), ("iops", 9000.0, "High"),
     ("other", 1.0, "Normal"), ("cpu", None, "Unavailable")],
)
def test_status_band(spark, metric, value, name):
    assert one(spark, lambda c: T.status_band(metric, c), value, "double") == name


@pytest.mark.parametrize("name, kept", [("public", True), ("pg_toast", False), ("SYS", False), ("sys", False), ("mysql", False), ("sales", True)])
def test_is_user_schema(spark, name, kept):
    assert one(spark, T.is_user_schema, name) is kept


@pytest.mark.parametrize("name, category", [("wait/io/file", "Io"), ("wait/SYNCH/x", "Synch"), ("latch", "General")])
def test_wait_category(spark, name, category):
    assert one(spark, T.wait_category, name) == category
