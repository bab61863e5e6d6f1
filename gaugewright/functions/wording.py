"""Sentences of the reports, as templates, and their rendering as a column or as SQL text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

CPU_RULES = {
    1: "CPU use stayed high over {period}; its peak was {peak}% at {peak_time}.",
    2: "CPU use rose from {start}% to {current}% over {period}, with {peak}% at the highest.",
    3: "CPU use fell from {start}% to {current}% over {period}; the mean is {avg}%.",
    4: "CPU use is {current}% now, well below the {peak}% of {peak_time}.",
    5: "CPU use was low over {period}: {avg}% in the mean.",
    6: "CPU use is {current}% now and {avg}% in the mean over {period}.",
}
IO_RULES = {
    1: "I/O peaked at {peak} operations a second at {peak_time}, against a mean of {avg}.",
    2: "I/O grew by {change}% over {period} and peaked at {peak} operations a second.",
    3: "I/O shrank by {drop}% over {period}, from {start} to {current} operations a second.",
    4: "I/O stands at {current} operations a second, more than the warning level.",
    5: "I/O was heavy all through {period}: {avg} operations a second in the mean.",
    6: "I/O held at {avg} operations a second in the mean over {period}.",
}
BLOCKED_NOW = "Blocking now: {blocked} session(s) wait for locks, {peak} at most over {period}."
BLOCKED_BEFORE = "Blocking earlier: no session waits now, but up to {peak} did over {period}."
BLOCKED_NEVER = "No session waited for a lock over {period}."
CPU_STATE = "CPU is {status} at {cpu}%; over {period} the mean was {avg}% and the peak {peak}%."
QUERY_STATE = "The costliest statement, '{query}', took {ms} ms over {period}."
WAIT_STATE = "Sessions waited longest on '{event}' over {period}."
TABLE_STATE = "The largest table over {period} is '{table}' with {size}."
TOP_CPU = "Statement '{query}' used {ms} ms of CPU, {share}% of the time of the statements listed, in {calls} calls."
TOP_IO = "'{entity}' did {operations} I/O operations, {share}% of those listed."
TOP_WAITS = "Most of the waiting over {period} was on '{first}' ({first_share}%) and '{second}' ({second_share}%)."
TOP_WAIT = "All waiting over {period} was on '{first}' ({first_share}%)."
TOP_NO_WAIT = "There was no waiting worth mention over {period}."
TOP_CACHE = "Of the reads on {server}, {hit}% came from the cache and {miss}% from disk."
TOP_TABLE = "Of all tables '{table}' takes the most room: {size}."


def parts(template: str) -> list[tuple[str, bool]]:
    """Pieces of a template in order, each with whether it is the name of a value."""
    return [(p, k % 2 == 1) for k, p in enumerate(re.split(r"\{(\w+)\}", template)) if p]


def sentence(template: str, **values: Column | str) -> Column:
    """The template with its values put in; null if any of them is."""
    pieces = []
    for piece, is_name in parts(template):
        value = values[piece] if is_name else piece
        pieces.append(value.cast("string") if isinstance(value, Column) else F.lit(value))
    return F.concat(*pieces)


def sentence_sql(template: str, **values: str) -> str:
    """The same as SQL text, from SQL texts of the values."""
    return " || ".join(f"({values[piece]})" if is_name else "'" + piece.replace("'", "''") + "'" for piece, is_name in parts(template))
