"""Peaks of open intervals against counting at every start."""

import random
from datetime import datetime, timedelta

import pytest

from gaugewright.operators import kpi as K
from gaugewright.operators.peaks import open_at_once, peaks

T0 = datetime(2024, 1, 1)
SCHEMA = "server string, s timestamp, e timestamp"


def at(minute):
    return None if minute is None else T0 + timedelta(minutes=minute)


def plain(data, since=None, until=None):
    out = {}
    for server, _, _ in data:
        own = [(max(s, since) if since is not None else s, e) for k, s, e in data if k == server and s is not None and (e is None or e > s) and (since is None or e is None or e > since)]
        own = [(s, e) for s, e in own if until is None or s < until]
        counts = [(sum(a <= t and (b is None or b > t) for a, b in own), -t) for t, _ in own]
        if counts:
            n, t = max(counts)
            out[server] = (n, at(-t))
    return out


@pytest.mark.parametrize("ranges", ["1", "7", "40"])
@pytest.mark.parametrize("since,until", [(None, None), (100, 300)])
def test_same_as_counting(spark, ranges, since, until):
    draw = random.Random(5)
    data = [(draw.choice(["a", "a", "a", "b", None]), draw.randint(0, 400), None) for _ in range(300)]
    data = [(k, s, draw.choice([None, s, s - 3, s + draw.randint(1, 90), s + 5])) for k, s, _ in data] + [("c", 5, 6), ("d", None, 7), ("e", None, None)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        df = spark.createDataFrame([(k, at(s), at(e)) for k, s, e in data], SCHEMA)
        text = lambda m: None if m is None else str(at(m))
        got = {r.server: (r.peak, r.peak_at) for r in peaks(df, ["server"], "s", "e", text(since), text(until)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == plain(data, since, until)


def test_an_end_comes_before_a_start_at_its_time(rows):
    df = rows([("a", at(0), at(5)), ("a", at(5), at(9)), ("a", at(5), at(5))], SCHEMA)
    assert [(r.time, r.open) for r in open_at_once(df, ["server"], "s", "e").orderBy("time").collect()] == [(at(0), 1), (at(5), 1), (at(9), 0)]
    assert peaks(rows([], SCHEMA), ["server"], "s", "e").count() == 0


def test_blocking_with_its_peak(rows):
    locks = rows([("a", "WAITING"), ("a", "GRANTED"), ("b", "GRANTED")], "server string, lock_status string")
    waits = rows([("a", at(0), at(5)), ("a", at(1), at(3)), ("a", at(2), None), ("c", at(0), None)], "server string, start_ts timestamp, end_ts timestamp")
    got = {r.server: (r.blocked, r.peak, r.peak_at) for r in K.blocked_over_period(locks, waits, str(T0), str(at(60))).collect()}
    assert got == {"a": (1, 3, at(2)), "b": (0, 0, None)}
