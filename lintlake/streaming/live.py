"""Streaming operators: log filter, event threshold, suppression, health state, debounce, checks, windows.

Suppression and health decide rows in event time, however they fall into micro-batches: rows wait in the state until the watermark has
passed them (``delay`` behind the newest row seen) and are then taken in time order. Rows later than that are dropped by Spark, as are
rows without a time. A row without ``row_id`` is a heartbeat: it moves the watermark and is nothing else, so a source that falls silent
can have its last rows decided.

State is bounded by what waits for the watermark: a suppressed key is forgotten once its gap is over and the watermark has passed it,
windows close by the watermark, health is one small row per component (kept for good unless a time to live is given, as an old failure
still counts). Stateful streams need the RocksDB state store (``ROCKS``), which ``drain`` sets for its stream.
Keys are dealt to ``BUCKETS`` groups by their hash; a micro-batch costs a few state calls per group it has rows of, whatever its rows and
keys, and writes the settled state of such a group anew. The rows of one micro-batch, and so of one key in it, are bounded by the source's ``maxFilesPerTrigger`` / ``maxBytesPerTrigger``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lintlake.operators.telemetry import OK_REPORT_MS, matching_lines, reportable
from lintlake.session import work_path
from lintlake.sources.sinks import panics

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_errors(lines: DataFrame, regex: str = "ERROR|Traceback") -> DataFrame:
    """Matching log lines with their level."""
    return matching_lines(lines, regex)


def running_errors(errors: DataFrame) -> DataFrame:
    """Error count so far per level (complete mode)."""
    return errors.groupBy("level").agg(F.count("*").alias("errors"))


def stream_events(events: DataFrame, ok_threshold: float = OK_REPORT_MS) -> DataFrame:
    """X2."""
    return reportable(events, ok_threshold)



class _InTimeOrder(StatefulProcessor):
    """Rows (key, us, id, extra) of one bucket of keys wait until the watermark has passed them; the settled state gets them in order.

    A group is a bucket of keys, not a key: its rows wait as Arrow tables, one state value for the rows of a micro-batch, and all keys
    of a bucket are worked on together by array operations. ``settled`` is a table too, a row per key.
    """

    settled_columns: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.settled = handle.getValueState("settled", "rows binary")

    def take(self, rows: Iterator[pd.DataFrame], mark: int) -> tuple[pa.Table, pa.Array]:
        """Let the new rows wait; the new rows and the keys of all rows that came."""
        parts, keys = [_rows([], [], [], [])], []
        for pdf in rows:
            keys.append(pa.array(pdf["key"], pa.string()).unique())
            pdf = pdf[~pdf["beat"].astype(bool) & (pdf["us"] > mark)]
            parts.append(_rows(pdf["key"], pdf["us"], pdf["id"], pdf["extra"]))
        new = pa.concat_tables(parts).combine_chunks()
        if len(new):
            self.waiting.appendList([(_packed(new.slice(at, PACK_ROWS)),) for at in range(0, len(new), PACK_ROWS)])
        return new, pa.chunked_array(keys, pa.string()).unique()

    def all_waiting(self) -> pa.Table:
        return pa.concat_tables([_rows([], [], [], []), *(_unpacked(row[0]) for row in self.waiting.get())]).combine_chunks()

    def due(self, mark: int) -> tuple[pa.Table, int | None]:
        """The waiting rows that the watermark has passed, and the first time among the others, which go on waiting."""
        rows = self.all_waiting()
        late = pc.less_equal(rows["us"], mark)
        rest = rows.filter(pc.invert(late))
        if len(rest):
            self.waiting.put([(_packed(rest.slice(at, PACK_ROWS)),) for at in range(0, len(rest), PACK_ROWS)])
        else:
            self.waiting.clear()
        return rows.filter(late), pc.min(rest["us"]).as_py()

    def wake(self, at_us: int | None) -> None:
        """One timer a bucket, for the earliest thing to come."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if at_us is not None:
            self.handle.registerTimer(-(-at_us // 1000))

    def wake_by(self, at_us: int | None) -> None:
        """A timer for a new row, unless an earlier one is there."""
        timers = list(self.handle.listTimers())
        if at_us is not None and (not timers or min(timers) * 1000 > at_us):
            self.wake(at_us)

    def known(self) -> pa.Table:
        """The settled state: key and numbers."""
        if self.settled.exists():
            return _unpacked(self.settled.get()[0])
        return pa.table({"key": pa.array([], pa.string()), **{c: pa.array([], pa.int64()) for c in self.settled_columns}})

    def settle(self, keys: pa.Array, **numbers: np.ndarray) -> None:
        if len(keys):
            self.settled.update((_packed(pa.table({"key": keys, **numbers})),))
        else:
            self.settled.clear()

    def numbered(self, rows: pa.Table, *more: pa.Array) -> tuple[pa.Array, pa.Table, np.ndarray, np.ndarray, list[np.ndarray]]:
        """The keys of the settled state, the rows and ``more``; the settled table and its keys' numbers, the rows' and those of ``more``."""
        known = self.known()
        chunks = [known["key"].combine_chunks(), rows["key"].combine_chunks(), *more]
        chunks = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in chunks]
        coded = pa.concat_arrays(chunks).dictionary_encode(null_encoding="encode")
        codes = np.split(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum([len(c) for c in chunks])[:-1])
        return coded.dictionary, known, codes[0], codes[1], codes[2:]

    def close(self) -> None:
        pass


def _rows(key, us, ids, extra) -> pa.Table:
    return pa.table({"key": pa.array(key, pa.string()), "us": pa.array(us, pa.int64()), "id": pa.array(ids, pa.int64()), "extra": pa.array(extra, pa.string())})


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(bytes(data))).read_all()


def _timed(events: DataFrame, key: str, ts: str, row_id: str, delay: str, extra: Column) -> GroupedData:
    """The rows as the processors read them, by buckets of keys; names that a named tuple can have."""
    slim = events.filter(F.col(ts).isNotNull()).withWatermark(ts, delay).select(
        F.col(key).cast("string").alias("key"), F.col(ts).alias("ts"), F.unix_micros(ts).alias("us"),
        F.coalesce(F.col(row_id).cast("long"), F.lit(0)).alias("id"), F.col(row_id).isNull().alias("beat"), extra.cast("string").alias("extra"))
    return slim.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS))).groupBy("bucket")


class _Suppress(_InTimeOrder):
    """Settled is the time of the last row that passed."""

    settled_columns = ("last",)

    def __init__(self, gap: int):
        self.gap = gap

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new, _ = self.take(rows, timerValues.getCurrentWatermarkInMs() * 1000)
        self.wake_by(pc.min(new["us"]).as_py())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        rows, first = self.due(mark)
        keys, known, known_at, code, _ = self.numbered(rows)
        last = np.full(len(keys), NEVER, np.int64)
        last[known_at] = known["last"].to_numpy()
        us, ids = rows["us"].to_numpy(), rows["id"].to_numpy()
        order = np.lexsort((ids, us, code))
        code, us = code[order], us[order]
        kept = passing(code, us, last, self.gap)
        np.maximum.at(last, code[kept], us[kept])
        open_ = np.flatnonzero(last > mark - self.gap)  # whatever still comes to the others is due
        self.settle(keys.take(pa.array(open_)), last=last[open_])
        ends = int(last[open_].min()) + self.gap if len(open_) else None
        self.wake(min((t for t in (first, ends) if t is not None), default=None))
        out = rows.take(pa.array(order[kept]))
        if len(out):
            yield pd.DataFrame({f"_{c}": out[c].to_pandas() for c in ("key", "us", "id")} | {"_carry": out["extra"].to_pandas()})


#: Buckets of keys: so many groups share the work. State values hold so many rows at most. Before every time.
BUCKETS, PACK_ROWS, NEVER = 256, 200_000, -(1 << 62)


def passing(code: np.ndarray, us: np.ndarray, last: np.ndarray, gap: int) -> np.ndarray:
    """Indices of the rows that pass, for rows sorted by key number and time: ``gap`` or more after the last of their key that did
    (``last`` by key number). All keys take a step at a time."""
    if not len(us):
        return np.zeros(0, np.int64)
    ends = np.searchsorted(code, np.arange(len(last)), "right")
    begin = ends - np.bincount(code, minlength=len(last))
    at, stop = begin[begin < ends], ends[begin < ends]
    due = last[begin < ends] + gap
    found = []
    while len(at):
        # the first row at or after ``due`` within at .. stop of each key, by halving
        low, high = at.copy(), stop.copy()
        while (low < high).any():
            middle = (low + high) // 2
            early = (low < high) & (us[np.minimum(middle, len(us) - 1)] < due)
            low, high = np.where(early, middle + 1, low), np.where(early | (low >= high), high, middle)
        some = low < stop
        at, stop = low[some], stop[some]
        found.append(at)
        due, at = us[at] + gap, at + 1
    return np.sort(np.concatenate(found))


def stream_suppress(
    events: DataFrame, gap_seconds: float = 10, key: str = "component_id", ts: str = "ts", row_id: str = "event_id",
    delay: str = "10 minutes", carry: str | None = None,
) -> DataFrame:
    """Greedy suppression per key; an event passes when the last one that passed is ``gap_seconds`` before it.

    ``carry`` names one text column to keep. The rows are those of the batch operator (N8), whatever micro-batches bring them, as long
    as none is more than ``delay`` late; a row is decided once the watermark has passed it.
    """
    rows = _timed(events, key, ts, row_id, delay, F.col(carry) if carry else F.lit(""))
    kept = rows.transformWithStateInPandas(
        _Suppress(int(gap_seconds * 1_000_000)), "_key string, _us long, _id long, _carry string", "Append", "EventTime")
    extra = [F.col("_carry").alias(carry)] if carry else []
    return kept.select(F.col("_key").alias(key), F.timestamp_micros("_us").alias(ts), F.col("_id").alias(row_id), *extra)


def alerts(failed: DataFrame, gap_seconds: float = 10, delay: str = "10 minutes") -> DataFrame:
    """K3: the PANICs among the failed events that pass the suppression."""
    return panics(stream_suppress(failed, gap_seconds, carry="status", delay=delay))


def stream_debounce(changes: DataFrame, gap_seconds: float = 2, row_id: str = "event_id", delay: str = "10 minutes") -> DataFrame:
    """Per path, changes at least two seconds after the last one that passed."""
    return stream_suppress(changes, gap_seconds, key="path", row_id=row_id, delay=delay)


class _Health(_InTimeOrder):
    """Settled: failures since the last success, the last success and failure, among the rows behind the watermark."""

    settled_columns = ("fails", "last_ok", "last_fail")

    def __init__(self, threshold: int, ttl: int | None):
        self.threshold, self.ttl = threshold, ttl

    def now(self, rows: pa.Table, *more: pa.Array) -> tuple:
        """The keys and their settled state with further rows, in order, on top; whether a key has any state; the numbers of the keys ``more``."""
        keys, known, known_at, code, asked = self.numbered(rows, *more)
        fails, last_ok, last_fail = (np.zeros(len(keys), np.int64) for _ in self.settled_columns)
        for column, name in zip((fails, last_ok, last_fail), self.settled_columns, strict=True):
            column[known_at] = known[name].to_numpy()
        there = np.zeros(len(keys), bool)
        there[known_at] = there[code] = True
        us, ids, ok = rows["us"].to_numpy(), rows["id"].to_numpy(), pc.equal(rows["extra"], "OK").to_numpy()
        order = np.lexsort((ids, us, code))
        code, us, ok, place = code[order], us[order], ok[order], np.arange(len(order))
        success = np.full(len(keys), -1, np.int64)  # the place of each key's last success
        success[code[ok]] = place[ok]  # the last of several assignments stays
        fails[code[ok]] = 0
        last_ok[code[ok]] = us[ok]
        last_fail[code[~ok]] = us[~ok]
        fails += np.bincount(code[~ok & (place > success[code])], minlength=len(keys))
        return keys, fails, last_ok, last_fail, there, asked

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new, came = self.take(rows, timerValues.getCurrentWatermarkInMs() * 1000)
        self.wake_by(pc.min(new["us"]).as_py())
        keys, fails, last_ok, last_fail, there, (asked,) = self.now(self.all_waiting(), came)
        at = asked[there[asked]]
        if len(at):
            yield pd.DataFrame({
                "component_id": keys.take(pa.array(at)).to_pandas(), "consecutive_failures": fails[at], "last_success": last_ok[at], "last_failure": last_fail[at],
                "healthy": fails[at] < self.threshold})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        rows, first = self.due(mark)
        keys, fails, last_ok, last_fail, there, _ = self.now(rows)
        end = np.maximum(last_ok, last_fail) + (self.ttl or 0)
        at = np.flatnonzero(there if self.ttl is None else end > mark)
        self.settle(keys.take(pa.array(at)), fails=fails[at], last_ok=last_ok[at], last_fail=last_fail[at])
        if self.ttl is not None and len(at):
            first = int(end[at].min()) if first is None else min(first, int(end[at].min()))
        self.wake(first)
        return iter(())


def stream_health(events: DataFrame, threshold: int = 2, delay: str = "10 minutes", ttl_seconds: float | None = None) -> DataFrame:
    """Health per component after each micro-batch it has rows in (update mode).

    Rows not more than ``delay`` late count at their own time, whatever micro-batch brings them. A component's counters live for good, so
    that a streak survives any silence: state grows with the number of components. ``ttl_seconds`` of event time without rows forgets one.
    """
    rows = _timed(events, "component_id", "ts", "event_id", delay, F.when(F.col("status") == "OK", "OK").otherwise(""))
    return rows.transformWithStateInPandas(
        _Health(threshold, None if ttl_seconds is None else int(ttl_seconds * 1_000_000)),
        "component_id string, consecutive_failures long, last_success long, last_failure long, healthy boolean", "Update", "EventTime")


def stream_metrics(metrics: DataFrame, width: str = "24 hours", delay: str = "1 hour") -> DataFrame:
    """Tumbling windows with count and mean value per metric type (``1 day`` gives the trend): closed ones in append mode,
    the open ones too, as far as they have come, in update mode."""
    return (
        metrics.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "type")
        .agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
        .select(F.unix_micros("w.start").alias("start_us"), "type", "n", "mean")
    )


def stream_check(changes: DataFrame, check: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Run a batch check on each micro-batch of changes and add its one status row to a table."""

    def run(batch: DataFrame, batch_id: int) -> None:
        # one directory per micro-batch: a batch replayed after a failure replaces its own row
        check(batch).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(stream: DataFrame, name: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Run a stream over all data there is now and read its result.

    Append: all rows. Complete: what the newest micro-batch gave. Update: of each key (``keys``) the newest row,
    without keys every row given.
    """
    spark = stream.sparkSession
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKS)
    try:
        return _drained(spark, stream, name, mode, keys)
    finally:
        spark.conf.set(STATE_STORE, before)


def _drained(spark: SparkSession, stream: DataFrame, name: str, mode: str, keys: list[str] | None) -> DataFrame:
    path, checkpoint = work_path(spark, name), work_path(spark, f"{name}-checkpoint")
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", path)
    else:
        def keep(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

        writer = stream.writeStream.foreachBatch(keep)
    writer.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    if mode == "append":
        return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(path)
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
    if mode == "complete":
        newest = rows.agg(F.max("batch").alias("batch"))
        return rows.join(F.broadcast(newest), "batch", "left_semi").select(*stream.columns)  # one row
    if not keys:
        return rows.select(*stream.columns)
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*[c if c in keys else f"_r.{c}" for c in stream.columns])
