"""Streams over several micro-batches: long gaps, long silences, result modes; and the work folder."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lintlake import session
from lintlake.operators.timeline import suppress
from lintlake.streaming import live

START = datetime(2024, 1, 1)
SCHEMA = "event_id long, component_id string, status string, ts timestamp"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Every micro-batch starts a worker for each partition of the state."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def stream(spark, path, batches):
    """A file stream that brings each list of (hour, component, status) in a micro-batch of its own."""
    n, everything = 0, []
    for rows in batches:
        made = [(n + k, c, s, START + timedelta(hours=h)) for k, (h, c, s) in enumerate(rows)]
        n += len(rows)
        everything += made
        spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path), everything


def test_suppression_keeps_long_gaps(spark, tmp_path):
    batches = [[(0, "a", "x")], [(1, "b", "x")], [(2, "b", "x")], [(3, "a", "x"), (3.5, "b", "x")], [(6, "a", "x"), (12.5, "b", "x")], [(13, "a", "x")], [(99, None, "x")]]
    events, rows = stream(spark, str(tmp_path / "e"), batches)
    events, rows = events.withColumn("event_id", F.when(F.col("component_id").isNotNull(), F.col("event_id"))), rows[:-1]  # a heartbeat at the end
    got = {r.event_id for r in live.drain(live.stream_suppress(events, 6 * 3600), "gaps").collect()}
    due, want = {}, set()
    for i, c, _, ts in sorted(rows, key=lambda r: r[3]):
        if c not in due or ts >= due[c]:
            want.add(i)
            due[c] = ts + timedelta(hours=6)
    assert got == want


def dealt(spark, path, rows, files, seed):
    """A file stream that brings the rows dealt at random to so many micro-batches, then a heartbeat."""
    rng = random.Random(seed)
    parts = [[] for _ in range(files)]
    for row in rows:
        parts[rng.randrange(files)].append(row)
    for part in [p for p in parts if p] + [[(None, None, None, max(r[3] for r in rows) + timedelta(days=9))]]:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def test_suppression_of_late_rows_is_the_batch_operators(spark, tmp_path):
    """Events in shuffled time order over six files, no row later than the delay."""
    rng = random.Random(2)
    rows = [(k, rng.choice(["a", "b", "c", None]), rng.choice(["PANIC", "DEGRADED"]), START + timedelta(seconds=rng.randrange(2000))) for k in range(300)]
    got = live.drain(live.stream_suppress(dealt(spark, str(tmp_path / "e"), rows, 6, 1), 50, delay="1 hour"), "late")
    want = suppress(spark.createDataFrame(rows, SCHEMA), 50)
    assert sorted(map(tuple, got.select("event_id", "ts").collect())) == sorted(map(tuple, want.select("event_id", "ts").collect()))
    panics = live.drain(live.alerts(dealt(spark, str(tmp_path / "f"), rows, 4, 2), 50, "1 hour"), "late-alerts")
    status = {r[0]: r[2] for r in rows}
    assert sorted(r.event_id for r in panics.collect()) == sorted(r.event_id for r in want.collect() if status[r.event_id] == "PANIC")


def test_suppression_over_advancing_watermarks(spark, tmp_path):
    """Rows are at most five minutes late; state passes from one micro-batch to the next, and rows without a time are dropped."""
    rng = random.Random(3)
    rows = [(k, "a", "x", START + timedelta(seconds=k * 40)) for k in range(200)]
    arrival = sorted(rows, key=lambda r: r[3] + timedelta(seconds=rng.randrange(300)))
    path = str(tmp_path / "e")
    for part in [arrival[k : k + 40] for k in range(0, 200, 40)] + [[(999, "a", "x", None), (None, None, None, START + timedelta(days=9))]]:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    got = live.drain(live.stream_suppress(events, 130, delay="6 minutes"), "advancing")
    want = suppress(spark.createDataFrame(rows, SCHEMA), 130)
    assert sorted(r.event_id for r in got.collect()) == sorted(r.event_id for r in want.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_health_of_late_rows(spark, tmp_path, seed):
    """The same health for every order of the files; a success older than the failures seen does not reset them."""
    rng = random.Random(9)
    rows = [(0, "probe", "PANIC", START + timedelta(seconds=60)), (1, "probe", "PANIC", START + timedelta(seconds=90)), (2, "probe", "OK", START)]
    rows += [(k, rng.choice("abc"), rng.choice(["OK", "PANIC", "PANIC"]), START + timedelta(seconds=rng.randrange(500))) for k in range(3, 150)]
    want = {}
    for _, c, status, _ in sorted(rows, key=lambda r: (r[3], r[0])):
        want[c] = 0 if status == "OK" else want.get(c, 0) + 1
    health = live.stream_health(dealt(spark, str(tmp_path / "e"), rows, 5, seed))
    got = live.drain(health, "late-health", "update", ["component_id"]).filter("component_id is not null").collect()
    assert {r.component_id: r.consecutive_failures for r in got} == want and want["probe"] == 2


def test_passing_rows_of_many_keys(spark):
    """All keys take a step at a time; the same rows pass as one by one."""
    rng = np.random.default_rng(5)
    code, us = np.sort(rng.integers(0, 7, 500)), rng.integers(0, 3000, 500)
    us = us[np.lexsort((us, code))]
    last = np.where(np.arange(9) % 2, live.NEVER, 40)
    want, due = [], {}
    for i, (c, t) in enumerate(zip(code.tolist(), us.tolist(), strict=True)):
        if t >= due.get(c, int(last[c]) + 100):
            want.append(i)
            due[c] = t + 100
    assert live.passing(code, us, last, 100).tolist() == want
    assert live.passing(code[:0], us[:0], last, 100).tolist() == []


def test_many_keys_share_few_groups(spark, tmp_path):
    """The rows reach the state by buckets of keys, so that groups do not grow with the keys."""
    rows = [(k, f"c{k % 2000}", "x", START + timedelta(seconds=k)) for k in range(4000)]
    events = dealt(spark, str(tmp_path / "e"), rows, 2, 1)
    plan = live._timed(events, "component_id", "ts", "event_id", "2 hours", F.lit(""))._df
    assert plan.columns[-1] == "bucket"
    got = live.drain(live.stream_suppress(events, 3600, delay="2 hours"), "many")
    assert sorted(r.event_id for r in got.collect()) == list(range(2000))


def test_health_survives_silence(spark, tmp_path):
    batches = [[(0, "a", "PANIC")], [(1, "b", "OK")], [(2, "b", "OK")], [(3, "a", "PANIC"), (3, "b", "PANIC")], [(90, "c", "OK")], [(200, "a", "PANIC")]]
    events, _ = stream(spark, str(tmp_path / "e"), batches)
    got = {r.component_id: (r.consecutive_failures, r.healthy) for r in live.drain(live.stream_health(events), "health", "update", ["component_id"]).collect()}
    assert got == {"a": (3, False), "b": (1, True), "c": (0, True)}


def test_health_with_a_time_to_live(spark, tmp_path):
    batches = [[(0, "a", "PANIC")], [(5, "b", "OK")], [(6, "b", "OK")], [(7, "b", "OK")], [(8, "a", "PANIC")]]
    events, _ = stream(spark, str(tmp_path / "e"), batches)
    states = live.drain(live.stream_health(events, ttl_seconds=3600), "health", "update", ["component_id"])
    assert {r.component_id: r.consecutive_failures for r in states.collect()}["a"] == 1


def test_complete_mode_gives_the_last_counts(spark, tmp_path):
    events, _ = stream(spark, str(tmp_path / "e"), [[(0, "a", "x")], [(1, "a", "y")], [(2, "b", "z")]])
    counts = events.groupBy(F.col("component_id").alias("level")).agg(F.count("*").alias("errors"))
    assert sorted(map(tuple, live.drain(counts, "counts", "complete").collect())) == [("a", 2), ("b", 1)]


def test_windows_open_and_closed(spark, tmp_path):
    events, _ = stream(spark, str(tmp_path / "e"), [[(0, "a", "x")], [(30, "a", "x")], [(49, "a", "x")], [(50, "a", "x")]])
    metrics = events.select(F.col("component_id").alias("type"), F.lit(1.0).alias("value"), "ts")
    closed = live.drain(live.stream_metrics(metrics), "closed").collect()
    open_ = live.drain(live.stream_metrics(metrics), "open", "update", ["start_us", "type"]).collect()
    assert sorted(r.n for r in closed) == [1, 1] and sorted(r.n for r in open_) == [1, 1, 2]


class _Session:
    """A session on a cluster without a shared folder."""

    class conf:
        get = staticmethod(lambda key, default=None: default)

    class sparkContext:
        master, applicationId = "spark://host:7077", "app"


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.work_dir(_Session)


def test_work_tables_are_deleted(spark, tmp_path):
    import os

    path = session.work_path(spark, "kept")
    spark.range(3).write.parquet(path)
    others, session._MADE[:] = session._MADE[:-1], session._MADE[-1:]
    session.clean_work(spark)
    session._MADE[:] = others
    assert not os.path.exists(path)
