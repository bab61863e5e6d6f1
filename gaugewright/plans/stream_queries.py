"""Streaming queries: a file stream over events, run until it is used up."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..streaming.counters import counter_totals, latest_rates, run_counters
from ..streaming.monitors import run_to_end, stream_quality, stream_trend
from .facts import source
from .materialize import shared_folder
from .registry import pct, query, rnd


def events_stream(spark, folder: str) -> DataFrame:
    schema = source(spark, folder, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)


def to_end(spark, folder: str, report) -> DataFrame:
    """A report over events as a stream, up to the end of the events."""
    return run_to_end(report(events_stream(spark, folder)), report(source(spark, folder, "events")))


def utc_text(pattern: str) -> Column:
    """The window start in UTC, whatever the session's zone."""
    return F.date_format(F.to_utc_timestamp("window_start", F.current_timezone()), pattern)


_START = "time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01 00:00:00')"


@query("stream_trend", "R2", f"""
SELECT strftime({_START}, '%Y-%m-%d %H:%M') AS window_start, 'srv' || CAST(user_id % 4 AS VARCHAR) AS server, event_type AS metric, count(*) AS samples,
 {rnd('avg(value)', 1)} AS value, min(value) AS min, max(value) AS max FROM events GROUP BY ALL""")
def trend_on_stream(spark, folder):
    def report(events: DataFrame) -> DataFrame:
        server = F.concat(F.lit("srv"), (F.col("user_id") % 4).cast("string"))
        return stream_trend(events.select(server.alias("server"), "ts", F.col("event_type").alias("metric"), "value"), "2 hours")

    found = to_end(spark, folder, report)
    return found.withColumn("window_start", utc_text("yyyy-MM-dd HH:mm"))


_DAY = "date_trunc('day', ts)"


@query("stream_quality", "C1 C2 C3", f"""
SELECT strftime(d, '%Y-%m-%d') AS window_start, 'session_id' AS column_name, 'IDENTIFIER_NULL' AS issue_type, n AS affected_count, {pct('n', 'total')} AS affected_percentage
 FROM (SELECT {_DAY} AS d, count(*) FILTER (WHERE user_id % 7 = 0) AS n, count(*) AS total FROM events GROUP BY 1) w
 WHERE n > 0
UNION ALL SELECT strftime(d, '%Y-%m-%d'), 'label', 'LEADING_TRAILING_SPACES', n, {pct('n', 'total')}
 FROM (SELECT {_DAY} AS d, count(*) FILTER (WHERE event_id % 11 = 0) AS n, count(*) AS total FROM events GROUP BY 1) w
 WHERE n > 0
UNION ALL SELECT strftime(d, '%Y-%m-%d'), 'label', 'MIXED_NUMERIC_TEXT', n, {pct('n', 'total')}
 FROM (SELECT {_DAY} AS d, count(*) FILTER (WHERE event_id % 13 = 0) AS n, count(*) AS total FROM events GROUP BY 1) w
 WHERE n > 0 AND n < total""")
def quality_on_stream(spark, folder):
    label = F.when(F.col("event_id") % 13 == 0, F.col("event_id").cast("string")).otherwise(F.col("event_type"))

    def report(events: DataFrame) -> DataFrame:
        dirty = events.select(
            "ts", F.when(F.col("user_id") % 7 != 0, F.col("user_id")).alias("session_id"),
            F.when(F.col("event_id") % 11 == 0, F.concat(label, F.lit("\t"))).otherwise(label).alias("label"),
        )
        return stream_quality(dirty, "ts", "1 day")

    found = to_end(spark, folder, report)
    return found.withColumn("window_start", utc_text("yyyy-MM-dd"))


@query("stream_qps", "P4 R2", f"""
SELECT server, CAST(sum(step) AS DOUBLE) AS increase, CAST(date_sub('second', min(ts), max(ts)) AS BIGINT) AS seconds, {rnd("sum(step) / greatest(1, date_sub('second', min(ts), max(ts)))", 1)} AS qps FROM
 (SELECT server, ts, CASE WHEN before IS NULL THEN 0 WHEN v >= before THEN v - before ELSE v END AS step FROM
 (SELECT 'srv' || CAST(user_id % 4 AS VARCHAR) AS server, ts, CAST(round(value * 1000) AS BIGINT) AS v,
 lag(CAST(round(value * 1000) AS BIGINT)) OVER (PARTITION BY user_id % 4 ORDER BY ts, value) AS before FROM events WHERE event_type = 'click') a) b GROUP BY server""")
def qps_on_stream(spark, folder):
    """A query counter as a stream that is stopped half way and goes on from its checkpoint."""
    place = f"{shared_folder(spark)}/counters-{uuid.uuid4().hex}"
    server = F.concat(F.lit("srv"), (F.col("user_id") % 4).cast("string"))
    events = source(spark, folder, "events").filter("event_type = 'click'")
    samples = events.select(server.alias("server"), F.col("event_type").alias("metric"), "ts", F.round(F.col("value") * 1000).cast("double").alias("value"))
    middle = samples.agg(F.expr("percentile_approx(ts, 0.5)").alias("m")).first()["m"]
    for half in (F.col("ts") < middle, F.col("ts") >= middle):
        samples.filter(half).write.mode("append").parquet(f"{place}/in")
        totals = counter_totals(spark.readStream.schema(samples.schema).parquet(f"{place}/in"))
        found = run_counters(totals, f"{place}/out", f"{place}/progress")
    return latest_rates(found).select("server", "increase", "seconds", F.col("rate").alias("qps"))
