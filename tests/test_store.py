"""Named snapshots and keyed tables: empty and odd names, last deletes, killed writes, other writers, touched buckets, replays."""

import os

import pytest
from pyspark.sql import functions as F

from lintlake.operators import memory as M
from lintlake.sources import sinks
from lintlake.sources.store import Conflict, KeyedTable, Store


def rows(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v long")


def values(df):
    return sorted(r.v for r in df.collect())


def files(path):
    return {os.path.join(top, n) for top, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_snapshots_of_any_name_and_size(spark, tmp_path):
    path = str(tmp_path / "s")
    assert sinks.list_snapshots(spark, path).collect() == []
    for name in ("001", "1", "a/b =", ""):
        sinks.save_snapshot(rows(spark, 1, 2), path, name)
    sinks.save_snapshot(rows(spark).limit(0), path, "1")
    assert {tuple(r) for r in sinks.list_snapshots(spark, path).collect()} == {("001", 2), ("1", 0), ("a/b =", 2), ("", 2)}
    assert values(sinks.get_snapshot(spark, path, "001")) == [1, 2]
    assert values(sinks.get_snapshot(spark, path, "1")) == []
    assert sinks.get_snapshot(spark, path, "none").count() == 0
    assert sinks.all_snapshots(spark, path).groupBy("snapshot_id").count().count() == 3
    assert [sinks.delete_snapshot(spark, path, n) for n in ("001", "001", "1", "a/b =", "")] == [True, False, True, True, True]
    assert sinks.list_snapshots(spark, path).collect() == []
    assert sinks.all_snapshots(spark, path).count() == 0


def test_a_killed_write_changes_nothing(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    store.save("a", rows(spark, 1))
    before = store.read("a")

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Store, "_put", killed)
        with pytest.raises(KeyboardInterrupt):
            store.save("a", rows(spark, 2, 3))
    broken = rows(spark, 5).select(F.raise_error(F.lit("broken")).cast("long").alias("v"))
    with pytest.raises(Exception, match="broken"):
        store.save("a", broken)
    assert values(store.read("a")) == [1] and store.rows() == {"a": 1}
    store.save("a", rows(spark, 4))
    assert values(before) == [1]  # what a reader has opened stays readable
    assert store.vacuum() >= 2
    assert values(store.read("a")) == [4]


def test_two_writers(spark, tmp_path, monkeypatch):
    """Who comes second makes the change anew on what the first one left."""
    one, two = (Store(spark, str(tmp_path / "s")) for _ in range(2))
    put, late = Store._put, []

    def other_first(self, number, tables):
        if self is one and not late:
            late.append(number)
            two.save("b", rows(spark, 2))
        put(self, number, tables)

    monkeypatch.setattr(Store, "_put", other_first)
    one.save("a", rows(spark, 1))
    assert late and one.rows() == {"a": 1, "b": 1}
    with pytest.raises(Conflict):
        put(one, 1, {})


def lessons(spark, ids, mark):
    made = [(f"i{k}", f"h{k}" if k % 10 else "", f"t{k}", mark, 1, k) for k in ids]
    columns = "id string, content_hash string, title string, error_summary string, failure_count long, captured_at long"
    return spark.createDataFrame(made, columns)


def test_upserts_rewrite_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "s")
    table = M.lessons_table(Store(spark, path), buckets=32)
    assert M.store_lessons(table, lessons(spark, range(1000), "old"), batch=0)
    number, tables = table.store.current()
    before, parts = files(path), tables["lessons"]["parts"]
    change = lessons(spark, [3, 13, 23, 1001], "new")
    assert M.store_lessons(table, change, batch=1)
    after = table.store.current()[1]["lessons"]["parts"]
    changed = {k for k in after if after[k] != parts.get(k)}
    assert 1 <= len(changed) <= 4 and len(files(path) - before) <= 4
    want = M.upsert_lessons(lessons(spark, range(1000), "old"), change).select(change.columns)
    assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, want.collect()))
    now = files(path)
    assert not M.store_lessons(table, change, batch=1) and files(path) == now  # a replay
    assert table.store.current()[0] == number + 1
    with pytest.raises(ValueError, match="buckets"):
        M.lessons_table(table.store, buckets=8).read()


def test_stored_deletes_and_retention(spark, tmp_path):
    path = str(tmp_path / "s")
    table = KeyedTable(Store(spark, path), "t", "id", 32)
    made = spark.range(500).select(F.concat(F.lit("x"), "id").alias("id"), F.timestamp_seconds(F.col("id") * 86400).alias("at"), (F.col("id") % 10).alias("importance"))
    assert not M.delete_stored(table, "x1")  # nothing stored yet
    table.merge(made, lambda old, new: old.unionByName(new))
    parts = table.store.current()[1]["t"]["parts"]
    assert M.delete_stored(table, "x499") and not M.delete_stored(table, "x499")
    assert sum(p != parts[k] for k, p in table.store.current()[1]["t"]["parts"].items()) <= 1
    now = F.timestamp_seconds(F.lit(499 * 86400))
    assert M.retain_stored(table, now, "at", 100, 5)
    want = M.retain(made.filter("id <> 'x499'"), now, "at", 100, 5)
    assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, want.collect()))
    assert M.delete_stored(table, "x") and table.read().count() == 0 and table.store.rows() == {"t": 0}
