"""Rates of cumulative counters on a stream: the last value of every series is kept as state.

A counter only grows; a smaller value than before is a restart from zero. Samples of a series can
come out of order, so those the watermark has not passed yet wait in the state, sorted in when the
next ones come, and are settled when it passes: by the next input or, where none comes, by a timer. What
is settled is one row per series. Samples later than the watermark are dropped by the engine.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import rounded
from ..plans.materialize import shared_folder
from .monitors import SERIES, instants

SETTLED = "first bigint, last bigint, value double, increase double, samples bigint"
STORE, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

Total = tuple[int, int, float, float, int]


def walk(total: Total | None, samples: list[tuple[int, float]]) -> Total | None:
    """A series' total after further samples in the order of their times."""
    for at, value in samples:
        if total is None:
            total = (at, at, value, 0.0, 1)
        else:
            first, _, before, increase, n = total
            total = (first, at, value, increase + (value - before if value >= before else value), n + 1)
    return total


class CounterIncrease(StatefulProcessor):
    """Keeps a series' settled total and its waiting samples; gives the total over all samples after every input."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", SETTLED)
        self.waiting = handle.getListState("waiting", "at bigint, value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [s for part in rows for s in zip(part["us"].tolist(), part["value"].tolist())]
        samples = sorted([*(tuple(s) for s in self.waiting.get()), *new])
        total = walk(self._total(), samples)
        self._settle(samples, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame([(*key, *total)], columns=[*SERIES, "first", "last", "value", "increase", "samples"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._settle(sorted(tuple(s) for s in self.waiting.get()), timerValues.getCurrentWatermarkInMs())
        yield from ()

    def close(self) -> None:
        pass

    def _total(self) -> Total | None:
        return tuple(self.settled.get()) if self.settled.exists() else None

    def _settle(self, samples: list[tuple[int, float]], watermark_ms: int) -> None:
        passed = sum(at < watermark_ms * 1000 for at, _ in samples)
        if passed:
            self.settled.update(walk(self._total(), samples[:passed]))
        left = samples[passed:]
        if left:
            self.waiting.put(left)
            self.handle.registerTimer(left[-1][0] // 1000 + 1)
        else:
            self.waiting.clear()


def counter_totals(samples: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """(server, metric, first, last, value, increase, samples) of a stream of (server, metric, ts, value), after every input of a series.

    Samples without a time or value count nothing. State is one row per series, and the samples of the last ``delay``.
    """
    known = instants(samples, "ts").filter("ts IS NOT NULL AND value IS NOT NULL")
    keyed = known.withWatermark("ts", delay).select(*SERIES, "ts", F.unix_micros("ts").alias("us"), F.col("value").cast("double").alias("value"))
    return keyed.groupBy(*SERIES).transformWithStateInPandas(CounterIncrease(), f"server string, metric string, {SETTLED}", "Append", "EventTime")


def run_counters(totals: DataFrame, out: str, checkpoint: str | None = None) -> DataFrame:
    """Processes what the source holds now and returns all totals written so far; a later run with the same checkpoint goes on from there."""
    spark = totals.sparkSession
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKSDB)  # the only store that keeps lists and timers
    try:
        place = checkpoint or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
        writer = totals.writeStream.format("parquet").outputMode("append").option("checkpointLocation", place)
        writer.trigger(availableNow=True).start(out).awaitTermination()
    finally:
        spark.conf.set(STORE, before)
    return spark.read.schema(totals.schema).parquet(out)


def latest_rates(totals: DataFrame) -> DataFrame:
    """(server, metric, increase, seconds, rate) as the latest total of each series has them."""
    last = totals.groupBy(*SERIES).agg(F.max_by(F.struct("first", "last", "increase"), "samples").alias("t"))
    seconds = F.floor((F.col("t.last") - F.col("t.first")) / 1_000_000).cast("bigint")
    rate = rounded(F.col("t.increase") / F.greatest(F.lit(1), seconds), 1)
    return last.select(*SERIES, F.col("t.increase").alias("increase"), seconds.alias("seconds"), rate.alias("rate"))
