from datetime import datetime, timedelta

from pyspark.sql import functions as F

from gaugewright.streaming.monitors import run_available, run_to_end, start, stream_quality, stream_trend, windowed

SCHEMA = "server string, ts timestamp, metric string, value double"
T0 = datetime(2024, 1, 1)


def minute(m):
    return T0 + timedelta(minutes=m)


def stream_of(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def add(spark, folder, data):
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_closed_windows_equal_batch(spark, tmp_path):
    folder = str(tmp_path / "in")
    add(spark, folder, [("s", minute(i), "cpu", float(i % 7)) for i in range(120)])
    streamed = run_available(stream_trend(stream_of(spark, folder))).orderBy("window_start").collect()
    batch = stream_trend(spark.read.parquet(folder)).orderBy("window_start").collect()
    assert streamed == batch[: len(streamed)] and len(batch) - len(streamed) <= 3


def test_windows_open_at_the_end_are_not_lost(spark, tmp_path):
    folder = str(tmp_path / "in")
    add(spark, folder, [("s", minute(i), "cpu", float(i % 7)) for i in range(120)])
    whole = run_to_end(stream_trend(stream_of(spark, folder)), stream_trend(spark.read.parquet(folder)))
    assert whole.orderBy("window_start").collect() == stream_trend(spark.read.parquet(folder)).orderBy("window_start").collect()
    assert whole.agg(F.sum("samples")).first()[0] == 120


def test_late_rows_beyond_the_watermark_are_dropped(spark, tmp_path):
    folder, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    result = lambda: stream_trend(stream_of(spark, folder))
    add(spark, folder, [("s", minute(1), "cpu", 1.0), ("s", minute(60), "cpu", 1.0)])
    start(result(), out, progress, once=True).awaitTermination()
    add(spark, folder, [("s", minute(2), "cpu", 99.0), ("s", minute(55), "cpu", 5.0), ("s", minute(120), "cpu", 1.0)])
    start(result(), out, progress, once=True).awaitTermination()
    got = {r["window_start"]: r["samples"] for r in spark.read.parquet(out).collect()}
    assert got[T0] == 1  # the row for minute 2 came after its window closed
    assert got[minute(55)] == 1 and got[minute(60)] == 1


def test_times_without_zone_get_one(spark, tmp_path):
    df = spark.createDataFrame([(T0, 1)], "ts timestamp_ntz, n int")
    assert dict(windowed(df, "ts", "1 hour", "1 minute").dtypes)["ts"] == "timestamp"


def test_quality_per_window(spark):
    df = spark.createDataFrame(
        [(minute(0), "a ", 1), (minute(1), "b", None), (minute(70), "7", 2), (minute(71), "x", 3)],
        "ts timestamp, t string, k_id int",
    )
    got = {(r["window_start"], r["column_name"], r["issue_type"]): r["affected_percentage"] for r in stream_quality(df, "ts").collect()}
    assert got == {
        (T0, "t", "LEADING_TRAILING_SPACES"): 50.0, (T0, "k_id", "IDENTIFIER_NULL"): 50.0,
        (minute(60), "t", "MIXED_NUMERIC_TEXT"): 50.0,
    }
    assert df.filter(F.col("t").isNull()).count() == 0
