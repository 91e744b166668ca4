"""Running computations over per-key timelines that hold up when one key has a third of all rows.

A timeline is cut into (key, time block) pieces.  The heavy work is done per
piece; only one summary row per piece (a few for ``suppress``) is combined per
key.  So no task ever holds a whole hot key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Seconds of a time block: short, so that a hot key's busiest day is many pieces. Results do not depend on it.
BLOCK, SUPPRESS_BLOCK = 3_600, 900


def with_block(df: DataFrame, ts: str = "ts", seconds: int = BLOCK) -> DataFrame:
    return df.withColumn("_block", F.floor(F.unix_micros(ts) / (seconds * 1_000_000)).cast("long"))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column],
    seconds: int = BLOCK,
    inclusive: bool = True,
) -> DataFrame:
    """Running sums per key in ``order`` (its first column is the timestamp)."""
    pieces = with_block(df, order[0], seconds)
    here = W.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    totals = pieces.groupBy(*keys, "_block").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    earlier = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(
        *keys, "_block", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_c_{n}") for n in sums]
    )
    local = pieces.select("*", *[F.coalesce(F.sum(c).over(here), F.lit(0)).alias(f"_l_{n}") for n, c in sums.items()])
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in (*keys, "_block")]  # a null key is a key too
    joined = local.join(carried.withColumnsRenamed({k: f"_k_{k}" for k in (*keys, "_block")}), on)
    return joined.select(*df.columns, *[(F.col(f"_l_{n}") + F.col(f"_c_{n}")).alias(n) for n in sums])


def failure_streak(events: DataFrame, seconds: int = BLOCK) -> DataFrame:
    """Failures in a row up to each event of ``events(component_id, ts, event_id, status)``.

    streak = failures so far - failures up to the last success.
    """
    ok = F.col("status") == "OK"
    counted = running(
        events, ["component_id"], ["ts", "event_id"], {"_fails": (~ok).cast("long")}, seconds
    )
    pieces = with_block(counted, "ts", seconds)
    here = W.partitionBy("component_id", "_block").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    at_ok = F.when(ok, F.col("_fails"))
    # the running failure count never falls, so the largest one at a success is the last success's
    local = pieces.withColumn("_ok_here", F.max(at_ok).over(here))
    ends = pieces.groupBy("component_id", "_block").agg(F.max(at_ok).alias("_ok_end"))
    earlier = W.partitionBy("component_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select("component_id", "_block", F.max("_ok_end").over(earlier).alias("_ok_before"))
    base = F.coalesce("_ok_here", "_ok_before", F.lit(0))
    return local.join(carried, ["component_id", "_block"]).select(
        *events.columns, (F.col("_fails") - base).alias("streak")
    )


def failure_state(events: DataFrame, threshold: int = 2) -> DataFrame:
    """N7, final state per component: failures since the last success, last times, health."""
    ok = F.col("status") == "OK"
    last_ok = events.filter(ok).groupBy("component_id").agg(F.max(F.struct("ts", "event_id")).alias("_last_ok"))
    fails = events.filter(~ok)
    after = fails.join(last_ok, "component_id", "left").filter(
        F.col("_last_ok").isNull() | (F.struct("ts", "event_id") > F.col("_last_ok"))
    ).groupBy("component_id").agg(F.count("*").alias("consecutive_failures"))
    seen = events.groupBy("component_id").agg(
        F.max(F.when(ok, F.unix_micros("ts"))).alias("last_success"),
        F.max(F.when(~ok, F.unix_micros("ts"))).alias("last_failure"),
        F.max_by(F.when(~ok, F.col("error")), F.when(~ok, F.struct("ts", "event_id"))).alias("last_error"),
    )
    n = F.coalesce("consecutive_failures", F.lit(0))
    return seen.join(after, "component_id", "left").select(
        "component_id",
        F.coalesce("last_success", F.lit(0)).alias("last_success"),
        F.coalesce("last_failure", F.lit(0)).alias("last_failure"),
        F.coalesce("last_error", F.lit("")).alias("last_error"),
        n.alias("consecutive_failures"),
        (n < threshold).alias("healthy"),
    )


# --- N8: greedy suppression -------------------------------------------------------------------

def _last_reached(times: np.ndarray, gap: int) -> np.ndarray:
    """For each start, the last time emitted when only times >= gap after the previous emission pass."""
    n = len(times)
    step = np.append(np.searchsorted(times, times + gap, side="left"), n)
    last = np.arange(n)
    while True:
        move = step[:n] < n
        if not move.any():
            return times[last]
        target = step[:n][move]
        last[move] = last[target]
        step[:n][move] = step[target]


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int, dict[str, np.ndarray]]]:
    """The contiguous (_key, _block) runs of sorted batches, one at a time; a run may span batches."""
    held: list[pd.DataFrame] = []

    def release():
        run = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
        return run["_key"].iloc[0], int(run["_block"].iloc[0]), {c: run[c].to_numpy() for c in run.columns}

    for pdf in batches:
        if not len(pdf):
            continue
        keys, blocks = pdf["_key"].to_numpy(), pdf["_block"].to_numpy()
        cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (blocks[1:] != blocks[:-1])) + 1
        bounds = [0, *cuts.tolist(), len(pdf)]
        if held and (held[0]["_key"].iloc[0] != keys[0] or held[0]["_block"].iloc[0] != blocks[0]):
            yield release()
            held = []
        columns = {c: pdf[c].to_numpy() for c in pdf.columns}
        for lo, hi in zip(bounds, bounds[1:]):
            if hi == len(pdf):
                held.append(pdf.iloc[lo:hi])
            elif held:
                held.append(pdf.iloc[lo:hi])
                yield release()
                held = []
            else:
                yield keys[lo], int(blocks[lo]), {c: v[lo:hi] for c, v in columns.items()}
    if held:
        yield release()


def _chunks(parts: Iterator[tuple[np.ndarray, ...]], columns: list[str], rows: int = 20_000) -> Iterator[pd.DataFrame]:
    """Many small column tuples as few larger frames."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= rows:
            yield pd.DataFrame({c: np.concatenate([h[i] for h in held]) for i, c in enumerate(columns)})
            held, n = [], 0
    if held:
        yield pd.DataFrame({c: np.concatenate([h[i] for h in held]) for i, c in enumerate(columns)})


def _same(value, n: int, dtype) -> np.ndarray:
    return np.full(n, value, dtype=dtype)


def _block_entries(gap: int, width: int):
    def parts(batches: Iterator[pd.DataFrame]):
        for key, block, piece in _pieces(batches):
            times = piece["_us"]
            # an emission before the block can only delay the start by less than one gap
            n_entry = min(len(times), int(np.searchsorted(times, block * width + gap, side="left")) + 1)
            exits = _last_reached(times, gap)[:n_entry]
            latest = np.append(exits[1:] != exits[:-1], True)  # the last entry leading to each exit
            n = int(latest.sum())
            yield _same(key, n, object), _same(block, n, np.int64), times[:n_entry][latest], exits[latest]

    return lambda batches: _chunks(parts(batches), ["_key", "_block", "entry", "exit"])


def _fold_thresholds(gap: int):
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = block = object()  # unlike any, null too
        due = low = None  # next time that may pass; its value at the block's start
        done = True
        for pdf in batches:
            out = []
            for k, b, entry, exit_ in pdf[["_key", "_block", "entry", "exit"]].itertuples(index=False, name=None):
                if k != key:
                    key, block, due = k, None, -(2**62)
                if b != block:
                    block, low, done = b, due, False
                if not done and entry >= low:
                    out.append((k, b, low))
                    due, done = exit_ + gap, True
            yield pd.DataFrame(out, columns=["_key", "_block", "_us"])

    return fold


def _emit(gap: int):
    """The rows that pass. Of a block only the next due time is kept from batch to batch; a block without a threshold row gives none."""

    def parts(batches: Iterator[pd.DataFrame]):
        at = due = None
        for pdf in batches:
            keys, blocks, rows, times, ids = (pdf[c].to_numpy() for c in ("_key", "_block", "_row", "_us", "_id"))
            starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (blocks[1:] != blocks[:-1]))) if len(pdf) else []
            for lo, hi in zip(starts, [*starts[1:], len(pdf)], strict=True):
                if (keys[lo], blocks[lo]) != at:
                    at, due = (keys[lo], blocks[lo]), None
                    if not rows[lo]:
                        due, lo = int(times[lo]), lo + 1
                if due is None:
                    continue
                found, i = [], lo + int(np.searchsorted(times[lo:hi], due, side="left"))
                while i < hi:
                    found.append(i)
                    due = int(times[i]) + gap
                    i = lo + int(np.searchsorted(times[lo:hi], due, side="left"))
                if found:
                    yield _same(at[0], len(found), object), times[found], ids[found]

    return lambda batches: _chunks(parts(batches), ["_key", "_us", "_id"])


def suppress(
    events: DataFrame, gap_seconds: float = 10, key: str = "component_id", ts: str = "ts", row_id: str = "event_id",
    seconds: int | None = None,
) -> DataFrame:
    """Per key, keep an event only when the last *kept* one is at least ``gap_seconds`` before it."""
    seconds = seconds or max(SUPPRESS_BLOCK, int(-(-gap_seconds // 1)))
    gap, width = int(gap_seconds * 1_000_000), seconds * 1_000_000
    if gap > width:
        raise ValueError("the time block must be at least as long as the gap")
    slim = with_block(events, ts, seconds).select(
        F.col(key).cast("string").alias("_key"), "_block", F.unix_micros(ts).alias("_us"), F.col(row_id).cast("long").alias("_id")
    )
    pieces = slim.repartition("_key", "_block").sortWithinPartitions("_key", "_block", "_us")
    summaries = pieces.mapInPandas(_block_entries(gap, width), "_key string, _block long, entry long, exit long")
    thresholds = (
        summaries.repartition("_key")
        .sortWithinPartitions("_key", "_block", "entry")
        .mapInPandas(_fold_thresholds(gap), "_key string, _block long, _us long")
    )
    # each block's threshold travels as its first row, so no join is needed
    rows = slim.withColumn("_row", F.lit(1)).unionByName(
        thresholds.withColumn("_id", F.lit(0).cast("long")).withColumn("_row", F.lit(0))
    )
    kept = (
        rows.repartition("_key", "_block")
        .sortWithinPartitions("_key", "_block", "_row", "_us", "_id")
        .mapInPandas(_emit(gap), "_key string, _us long, _id long")
    )
    return kept.select(F.col("_key").alias(key), F.timestamp_micros("_us").alias(ts), F.col("_id").alias(row_id))


def occurrences(errors: DataFrame, seconds: int = BLOCK) -> DataFrame:
    """Running count and mean pain per (lower-cased type, file) of ``errors(id, error_type, file_path, ts, pain)``."""
    keyed = errors.withColumn("error_type", F.lower("error_type"))
    out = running(
        keyed, ["error_type", "file_path"], ["ts", "id"],
        {"occurrence": F.lit(1).cast("long"), "_pain_sum": F.col("pain")}, seconds,
    )
    return out.select(*keyed.columns, "occurrence", (F.col("_pain_sum") / F.col("occurrence")).alias("avg_pain"))
