"""Telemetry, memory and metric tables as views over the given tables, with the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lintlake.plans.corpus import table

SENSOR_CTE = """sensor AS (SELECT event_id, 'app:' || user_id AS component_id,
  CASE event_type WHEN 'error' THEN 'PANIC' WHEN 'signup' THEN 'DEGRADED' ELSE 'OK' END AS status,
  CAST(round(value * 100) AS BIGINT) AS duration_ms, CASE WHEN event_type IN ('error', 'signup') THEN 'e' || (event_id % 13) END AS error, ts
  FROM events)"""
LOG_CTE = """loglines AS (SELECT event_id, ts, CASE event_type WHEN 'error' THEN 'ERROR: ' || props WHEN 'signup' THEN 'WARN slow ' || event_id
  WHEN 'view' THEN ' ' WHEN 'click' THEN 'Traceback (most recent call last) ' || user_id ELSE 'INFO: All good' END AS line FROM events)"""
ERRORS_CTE = """errors AS (SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN upper(event_type) ELSE event_type END AS error_type,
  'mod' || (user_id % 10) || '/u' || (user_id % 40) || '.py' AS file_path, CAST(round(value / 5) AS BIGINT) AS pain, ts, user_id, props FROM events
  WHERE event_type IN ('error', 'signup'))"""


def sensor_events(spark, sf: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        "event_id",
        F.concat(F.lit("app:"), F.col("user_id").cast("string")).alias("component_id"),
        F.when(kind == "error", "PANIC").when(kind == "signup", "DEGRADED").otherwise("OK").alias("status"),
        F.round(F.col("value") * 100).cast("long").alias("duration_ms"),
        F.when(kind.isin("error", "signup"), F.concat(F.lit("e"), (F.col("event_id") % 13).cast("string"))).alias("error"),
        "ts",
    )


def log_lines(spark, sf: str) -> DataFrame:
    kind = F.col("event_type")
    line = (
        F.when(kind == "error", F.concat(F.lit("ERROR: "), "props"))
        .when(kind == "signup", F.concat(F.lit("WARN slow "), F.col("event_id").cast("string")))
        .when(kind == "view", " ")
        .when(kind == "click", F.concat(F.lit("Traceback (most recent call last) "), F.col("user_id").cast("string")))
        .otherwise("INFO: All good")
    )
    return table(spark, sf, "events").select("event_id", "ts", line.alias("line"))


def errors(spark, sf: str) -> DataFrame:
    kind, user = F.col("event_type"), F.col("user_id")
    return table(spark, sf, "events").filter(kind.isin("error", "signup")).select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_id") % 3 == 0, F.upper(kind)).otherwise(kind).alias("error_type"),
        F.concat(F.lit("mod"), (user % 10).cast("string"), F.lit("/u"), (user % 40).cast("string"), F.lit(".py")).alias("file_path"),
        F.round(F.col("value") / 5).cast("long").alias("pain"),
        "ts", "user_id", "props",
    )


def latest_ts(df: DataFrame, ts: str = "ts"):
    """The clock of a query: the newest timestamp, read once (one row)."""
    return F.lit(df.agg(F.max(ts)).first()[0])
