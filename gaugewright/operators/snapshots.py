"""Facts as they stand now: the latest collection run of each server, with keys and flags that hold no nulls.

A collector reads the databases of a server one after another, so the snapshots of one run carry
different times. Times of a server that follow each other within a gap are one run. The state of a
server is its latest run: a database that was not in it any more has no state, and of a database read
twice in a run the later snapshot counts.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from functools import partial, reduce, wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SNAPSHOT = "snapshot_ts"
#: Snapshots of one server further apart than this belong to different runs.
RUN_GAP = "15 minutes"
#: Key parts that some sources leave out; joins and groups need them to be equal to themselves.
KEYS = ["server", "database_name", "schema_name", "child_schema", "parent_schema"]
#: Flags that only some sources have; without one it is not set.
FLAGS = ["is_unique", "is_primary", "is_disabled", "is_extension"]
_NEVER = "1900-01-01 00:00:00"


def filled_keys(fact: DataFrame) -> DataFrame:
    """Missing key parts as empty texts, missing flags as false."""
    types = dict(fact.dtypes)
    values = {c: "" for c in KEYS if types.get(c) == "string"} | {c: False for c in FLAGS if types.get(c) == "boolean"}
    return fact.fillna(values) if values else fact


def collection_runs(*facts: DataFrame, gap: str = RUN_GAP) -> DataFrame:
    """(server, run_start, run_end, snapshots): the collection runs that the facts' snapshot times make up.

    Times are reduced to one row per server and time before they meet; sessions are then merged in one sorted pass.
    """
    times = reduce(DataFrame.unionByName, [_times(filled_keys(f), ["server"]) for f in facts]).distinct()
    return _merged(times, gap)


def _merged(times: DataFrame, gap: str) -> DataFrame:
    """Sessions of (server, __ts). Sessions merge only while an aggregate is asked for: the filter on a count keeps one in every plan."""
    made = [F.min("__ts").alias("run_start"), F.max("__ts").alias("run_end"), F.count(F.lit(1)).alias("snapshots")]
    return times.groupBy("server", F.session_window("__ts", gap)).agg(*made).filter("snapshots > 0").select("server", "run_start", "run_end", "snapshots")


def _times(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*keys, F.coalesce(F.col(SNAPSHOT).cast("timestamp"), F.lit(_NEVER).cast("timestamp")).alias("__ts")).distinct()


def current(fact: DataFrame, gap: str = RUN_GAP) -> DataFrame:
    """The rows of each server's latest run, each database at its latest snapshot of that run; all rows where the fact has no ``snapshot_ts``.

    Counters that run since a server's start are read as they stand in that run, gauges likewise. Missing
    key parts become empty texts and missing flags false. Rows without a time are older than all others.
    A snapshot of a database carries one time. Which snapshots count is decided over one row per server,
    database and time; the fact itself is joined to one row per database, and stays where it is: shuffled by
    database, it would end in as few tasks as there are databases.
    """
    rows = filled_keys(fact)
    if SNAPSHOT not in fact.columns or "server" not in fact.columns:
        return rows
    keys = ["server"] + [c for c in ("database_name",) if c in fact.columns]
    times = _times(rows, keys)
    latest = _merged(times.select("server", "__ts").distinct(), gap).groupBy("server").agg(F.max("run_start").alias("__start"))
    chosen = times.join(F.broadcast(latest), "server").filter(F.col("__ts") >= F.col("__start")).groupBy(*keys).agg(F.max("__ts").alias("__latest"))
    time = F.coalesce(F.col(SNAPSHOT).cast("timestamp"), F.lit(_NEVER).cast("timestamp"))
    return rows.withColumn("__ts", time).join(F.broadcast(chosen.withColumnRenamed("__latest", "__ts")), [*keys, "__ts"]).select(*fact.columns)


def history(fact: DataFrame) -> DataFrame:
    """All records of a fact that is a history in itself (backups, job runs). What several snapshots repeat counts once."""
    rows = filled_keys(fact)
    return rows.drop(SNAPSHOT).distinct() if SNAPSHOT in fact.columns else rows


def on_current(report: Callable[..., DataFrame] | None = None, *, histories: tuple[str, ...] = ()) -> Callable[..., DataFrame]:
    """Makes a report read the current state of every fact it is given, and the arguments named in ``histories`` over all their snapshots."""
    if report is None:
        return lambda r: on_current(r, histories=histories)
    names = list(inspect.signature(report).parameters)

    def seen(name: str, value):
        if not isinstance(value, DataFrame):
            return value
        return history(value) if name in histories else current(value)

    @wraps(report)
    def run(*args, **named):
        return report(*[seen(n, a) for n, a in zip(names, args)], **{n: seen(n, a) for n, a in named.items()})

    return run


def of_state(report: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A report that takes its facts as they are: for states that ``current`` and ``history`` gave before."""
    if isinstance(report, partial):
        return partial(of_state(report.func), *report.args, **report.keywords)
    return getattr(report, "__wrapped__", report)
