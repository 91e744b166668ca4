"""Block-wise timelines against brute force, with one key holding most rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lintlake.operators import memory as M, timeline as TL

BASE = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def rows(seed, n, span_seconds, hot=0.5):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if rng.random() < hot else f"k{rng.randrange(5)}"
        out.append((key, BASE + dt.timedelta(seconds=rng.randrange(span_seconds)), i, rng.choice(["OK", "PANIC", "DEGRADED"])))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "component_id string, ts timestamp, event_id long, status string")


def greedy(data, gap):
    last, kept = {}, set()
    for key, ts, i, _ in sorted(data, key=lambda r: (r[1], r[2])):
        if key not in last or (ts - last[key]).total_seconds() >= gap:
            last[key] = ts
            kept.add(i)
    return kept


@pytest.mark.parametrize("gap,seconds,span", [(10, 60, 2000), (7, 7, 600), (10, 86_400, 5000), (50, 60, 400), (1, 20, 300)])
def test_suppress_equals_greedy(spark, gap, seconds, span):
    data = rows(gap, 700, span)
    got = TL.suppress(frame(spark, data), gap, seconds=seconds)
    assert {r.event_id for r in got.collect()} == greedy(data, gap)


def test_suppress_gaps_of_4_6_11(spark):
    data = [("a", BASE + dt.timedelta(seconds=s), s, "PANIC") for s in (0, 4, 6, 11, 20, 22)]
    got = TL.suppress(frame(spark, data), 10)
    assert sorted(r.event_id for r in got.collect()) == [0, 11, 22]


def test_suppress_needs_blocks_longer_than_the_gap(spark):
    with pytest.raises(ValueError):
        TL.suppress(frame(spark, rows(1, 5, 10)), 100, seconds=10)


@pytest.mark.parametrize("seconds", [30, 600, 86_400])
def test_failure_streak(spark, seconds):
    data = rows(3, 500, 3000)
    want, run = {}, {}
    for key, _, i, status in sorted(data, key=lambda r: (r[1], r[2])):
        run[key] = 0 if status == "OK" else run.get(key, 0) + 1
        want[i] = run[key]
    got = {r.event_id: r.streak for r in TL.failure_streak(frame(spark, data), seconds).collect()}
    assert got == want


def test_failure_state_after_fail_fail_ok_fail(spark):
    data = [("a", BASE + dt.timedelta(seconds=i), i, s) for i, s in enumerate(["PANIC", "PANIC", "OK", "PANIC"])]
    events = frame(spark, data).withColumn("error", F.concat(F.lit("e"), "event_id"))
    row = TL.failure_state(events).first()
    assert (row.consecutive_failures, row.healthy, row.last_error) == (1, True, "e3")


def test_running_keeps_null_keys(spark):
    data = [(None, BASE + dt.timedelta(days=d), d) for d in range(4)] + [("a", BASE, 9)]
    df = spark.createDataFrame(data, "k string, ts timestamp, id long")
    got = TL.running(df, ["k"], ["ts", "id"], {"n": F.lit(1).cast("long")}).collect()
    assert sorted((r.k or "", r.n) for r in got) == [("", 1), ("", 2), ("", 3), ("", 4), ("a", 1)]


def test_admission_counts_earlier_repeats_in_the_window(spark):
    hours = [0, 1, 2, 300, 301, 302]
    data = [(i, "Syntax_Error", "a/b.py", BASE + dt.timedelta(hours=h), 60) for i, h in enumerate(hours)]
    data += [(90, "race", "a/b.py", BASE, 50), (91, "race", "a/b.py", BASE, 49)]
    df = spark.createDataFrame(data, "id long, error_type string, file_path string, ts timestamp, pain long")
    assert sorted(r.id for r in M.admit(df).collect()) == [2, 5, 90]
