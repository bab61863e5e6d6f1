"""Named queries: each runs an operator over whole tables, most with the same result as plain SQL."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from .facts import DERIVED, HISTORY, SERIES, with_facts

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    """A query, the operators it shows, and SQL that gives the same rows."""

    run: Run
    operators: str
    sql: str | None = None


QUERIES: dict[str, Query] = {}


def query(name: str, operators: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a query under a name."""

    def register(run: Run) -> Run:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(run, operators, with_facts(sql) if sql else None)
        return run

    return register


def add_history() -> None:
    """For every query over state facts a second one over the same facts with older snapshots: the same rows are due."""
    for name, q in list(QUERIES.items()):
        used = [f for f in DERIVED if f not in SERIES and q.sql and f"fact_{f} AS" in q.sql]
        if used and not name.startswith("history_") and name not in WITHOUT_HISTORY:
            QUERIES[f"history_{name}"] = Query(_in_history(q.run), q.operators, q.sql)


#: Queries that already hand over a part of a fact, or write it down, before the operator sees it.
WITHOUT_HISTORY = ["storage_fan_out", "health_summary", "insight_text"]


def _in_history(run: Run) -> Run:
    def with_history(spark: SparkSession, folder: str) -> DataFrame:
        token = HISTORY.set(True)
        try:
            return run(spark, folder)
        finally:
            HISTORY.reset(token)

    return with_history


def rnd(x: str, digits: int) -> str:
    """SQL text rounding half to even in double arithmetic, as ``functions.text.rounded`` does."""
    return f"(round_even(CAST({x} AS DOUBLE) * 1e{digits}, 0) / 1e{digits})"


def pct(part: str, whole: str, digits: int = 2) -> str:
    return rnd(f"CAST({part} AS DOUBLE) / CAST(greatest({whole}, 1) AS DOUBLE) * 100.0", digits)
