"""Event and log telemetry over ``sensor_events`` and ``log_lines``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lintlake.functions.scalars import log_level

OK_REPORT_MS = 30_000  # fixed value: successful runs are only reported above this duration


def status_count(status: str) -> Column:
    return F.count_if(F.col("status") == status)


def recent(df: DataFrame, n: int, *order: Column, offset: int = 0) -> DataFrame:
    """The ``n`` newest rows (a bounded top-n)."""
    ordered = df.orderBy(*order)
    return (ordered.offset(offset) if offset else ordered).limit(n)


def merge_events(stored: DataFrame, live: DataFrame) -> DataFrame:
    """Both sources, distinct on (ts, component)."""
    return stored.unionByName(live, allowMissingColumns=True).dropDuplicates(["ts", "component_id"])


def component_stats(events: DataFrame) -> DataFrame:
    """A16."""
    last = F.max_by(F.struct("status", "duration_ms", "ts"), F.struct("ts", "event_id"))
    return events.groupBy("component_id").agg(
        F.count("*").alias("total_events"),
        status_count("PANIC").alias("panic_count"),
        status_count("DEGRADED").alias("degraded_count"),
        last.alias("last"),
    ).select(
        "component_id", "total_events", "panic_count", "degraded_count",
        F.col("last.status").alias("last_status"), F.col("last.duration_ms").alias("last_duration_ms"),
        F.unix_micros("last.ts").alias("last_ts"),
    )


def latest_status(events: DataFrame) -> DataFrame:
    return events.groupBy("component_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"))


def health(events: DataFrame) -> DataFrame:
    """Components per latest status."""
    return latest_status(events).groupBy("status").agg(F.count("*").alias("components"))


def component_detail(events: DataFrame) -> DataFrame:
    """Counts, mean of positive durations and success share, unrounded."""
    d = F.col("duration_ms")
    n_pos = F.count_if(d > 0)
    return events.groupBy("component_id").agg(
        F.count("*").alias("total_events"),
        status_count("OK").alias("ok"),
        status_count("DEGRADED").alias("degraded"),
        status_count("PANIC").alias("panic"),
        F.coalesce(F.try_divide(F.sum(F.when(d > 0, d)), n_pos), F.lit(0.0)).alias("avg_duration_ms"),
        (status_count("OK") * 100.0 / F.count("*")).alias("success_rate"),
    )


def overview(events: DataFrame, own_prefix: str, now: Column) -> DataFrame:
    """Own components by latest status, foreign ones, and PANICs of the last hour."""
    own = F.col("component_id").startswith(own_prefix)
    counts = {
        "own_components": own, "healthy": own & (F.col("status") == "OK"), "degraded": own & (F.col("status") == "DEGRADED"),
        "panic": own & (F.col("status") == "PANIC"), "other_components": ~own,
    }
    latest = latest_status(events).agg(*[F.count_if(cond).alias(name) for name, cond in counts.items()])
    last_hour = events.filter((F.col("ts") > now - F.expr("INTERVAL 1 HOUR")) & (F.col("status") == "PANIC"))
    # two one-row aggregates side by side: stacked and summed
    both = latest.unionByName(last_hour.agg(F.count("*").alias("panics_last_hour")), allowMissingColumns=True)
    return both.agg(*[F.sum(c).alias(c) for c in both.columns])


def reportable(events: DataFrame, ok_threshold: float = OK_REPORT_MS) -> DataFrame:
    """Every error, and OK only above the duration threshold; status from (failed, critical)."""
    status = F.when(~F.col("failed"), "OK").when(F.col("critical"), "PANIC").otherwise("DEGRADED")
    return events.filter(F.col("failed") | (F.col("duration_ms") > ok_threshold)).withColumn("status", status)


def matching_lines(lines: DataFrame, regex: str = "ERROR|Traceback") -> DataFrame:
    """Non-blank log lines matching ``regex`` with their level."""
    text = F.regexp_replace("line", r"^\s+|\s+$", "")
    return lines.withColumn("line", text).filter((F.col("line") != "") & F.col("line").rlike(regex)).withColumn(
        "level", log_level(F.col("line"))
    )


def error_count(lines: DataFrame, regex: str = "ERROR|Traceback") -> DataFrame:
    """A52."""
    return lines.agg(F.count_if(F.col("line").rlike(regex)).alias("errors"))
