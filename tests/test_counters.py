"""Counters on a stream: order, resets, late samples, timers and restarts."""

from datetime import datetime, timedelta

from gaugewright.operators.kpi import counter_increase
from gaugewright.streaming.counters import counter_totals, latest_rates, run_counters, walk

SCHEMA = "server string, metric string, ts timestamp, value double"
T0 = datetime(2024, 1, 1)


def add(spark, folder, data):
    rows = [(s, "q", T0 + timedelta(minutes=m), v) for s, m, v in data]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_walk_counts_restarts_from_zero():
    assert walk(None, [(1, 5.0), (2, 9.0), (3, 2.0), (4, 2.0)]) == (1, 4, 2.0, 6.0, 4)
    assert walk(walk(None, [(1, 5.0)]), [(2, 7.0)]) == (1, 2, 7.0, 2.0, 2) and walk(None, []) is None


def test_restart_and_samples_out_of_order_equal_the_batch(spark, tmp_path):
    place = str(tmp_path)
    totals = lambda: counter_totals(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{place}/in"))
    parts = [
        [("a", 0, 10.0), ("a", 4, 30.0), ("b", 1, 5.0)],
        [("a", 2, 20.0), ("a", 9, 3.0), ("b", 3, None)],  # minute 2 comes after minute 4; minute 9 is a restart
        [("a", 30, 8.0), ("a", 25, 6.0)],
        [("a", 31, 9.0), ("c", 40, 1.0), ("b", 39, 4.0)],
    ]
    for part in parts:  # stopped after every part, and started again from the checkpoint
        add(spark, f"{place}/in", part)
        found = run_counters(totals(), f"{place}/out", f"{place}/progress")
    got = {r.server: (r.increase, r.seconds) for r in latest_rates(found).collect()}
    batch = counter_increase(spark.read.parquet(f"{place}/in").filter("value IS NOT NULL"))
    assert got == {r.server: (r.increase, r.seconds) for r in batch.collect()} and got["a"] == (20.0 + 3.0 + 6.0, 31 * 60)


def test_samples_later_than_the_watermark_are_dropped(spark, tmp_path):
    place = str(tmp_path)
    totals = lambda: counter_totals(spark.readStream.schema(SCHEMA).parquet(f"{place}/in"), "5 minutes")
    for part in ([("a", 0, 1.0), ("a", 60, 11.0)], [("a", 5, 999.0), ("a", 61, 12.0)], [("a", 62, 14.0)]):
        add(spark, f"{place}/in", part)
        found = run_counters(totals(), f"{place}/out", f"{place}/progress")
    assert [(r.increase, r.seconds, r.rate) for r in latest_rates(found).collect()] == [(13.0, 62 * 60, 0.0)]
