"""Telemetry queries (A16-A19, A52, N7-N9, T2, U2, F8, F9, X1/X2 in batch)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.functions import scalars as fn
from lintlake.operators import telemetry as T, timeline as TL
from lintlake.plans.model import ERRORS_CTE, LOG_CTE, SENSOR_CTE, errors, latest_ts, log_lines, sensor_events
from lintlake.plans.registry import query


@query("a16_component_stats", f"""WITH {SENSOR_CTE} SELECT component_id, count(*) AS total_events,
  count(*) FILTER (WHERE status = 'PANIC') AS panic_count, count(*) FILTER (WHERE status = 'DEGRADED') AS degraded_count,
  arg_max(status, (ts, event_id)) AS last_status, arg_max(duration_ms, (ts, event_id)) AS last_duration_ms, epoch_us(max(ts)) AS last_ts
  FROM sensor GROUP BY component_id""")
def a16_component_stats(spark, sf):
    return T.component_stats(sensor_events(spark, sf))


_LATEST = "latest AS (SELECT component_id, arg_max(status, (ts, event_id)) AS status FROM sensor GROUP BY component_id)"


@query("a17_health_summary", f"WITH {SENSOR_CTE}, {_LATEST} SELECT status, count(*) AS components FROM latest GROUP BY status")
def a17_health_summary(spark, sf):
    return T.health(sensor_events(spark, sf))


@query("a18_component_detail", f"""WITH {SENSOR_CTE} SELECT component_id, count(*) AS total_events, count(*) FILTER (WHERE status = 'OK') AS ok,
  count(*) FILTER (WHERE status = 'DEGRADED') AS degraded, count(*) FILTER (WHERE status = 'PANIC') AS panic,
  coalesce(CAST(sum(duration_ms) FILTER (WHERE duration_ms > 0) AS DOUBLE) / count(*) FILTER (WHERE duration_ms > 0), 0.0) AS avg_duration_ms,
  CAST(count(*) FILTER (WHERE status = 'OK') AS DOUBLE) * 100.0 / count(*) AS success_rate FROM sensor GROUP BY component_id""")
def a18_component_detail(spark, sf):
    return T.component_detail(sensor_events(spark, sf))


@query("a19_sensor_overview", f"""WITH {SENSOR_CTE}, {_LATEST} SELECT count(*) FILTER (WHERE own) AS own_components,
  count(*) FILTER (WHERE own AND status = 'OK') AS healthy, count(*) FILTER (WHERE own AND status = 'DEGRADED') AS degraded,
  count(*) FILTER (WHERE own AND status = 'PANIC') AS panic, count(*) FILTER (WHERE NOT own) AS other_components,
  (SELECT count(*) FROM sensor WHERE status = 'PANIC' AND ts > (SELECT max(ts) FROM sensor) - INTERVAL 1 HOUR) AS panics_last_hour
  FROM (SELECT *, starts_with(component_id, 'app:1') AS own FROM latest)""")
def a19_sensor_overview(spark, sf):
    events = sensor_events(spark, sf)
    return T.overview(events, "app:1", latest_ts(events))


@query("a52_log_error_count", f"WITH {LOG_CTE} SELECT count(*) AS errors FROM loglines WHERE regexp_matches(line, 'ERROR|Traceback')")
def a52_log_error_count(spark, sf):
    return T.error_count(log_lines(spark, sf))


@query("x1_matching_log_lines", f"""WITH {LOG_CTE} SELECT event_id, trim(line, ' ') AS line,
  CASE WHEN contains(line, 'ERROR') OR contains(line, 'Traceback') THEN 'ERROR' WHEN contains(line, 'WARN') THEN 'WARNING' ELSE 'INFO' END AS level
  FROM loglines WHERE regexp_matches(line, 'ERROR|Traceback|WARN')""")
def x1_matching_log_lines(spark, sf):
    return T.matching_lines(log_lines(spark, sf), "ERROR|Traceback|WARN").select("event_id", "line", "level")


@query("f9_log_levels", f"""WITH {LOG_CTE} SELECT level, count(*) AS n FROM (SELECT CASE WHEN contains(line, 'ERROR') OR contains(line, 'Traceback') THEN 'ERROR'
  WHEN contains(line, 'WARN') THEN 'WARNING' ELSE 'INFO' END AS level FROM loglines) GROUP BY level""")
def f9_log_levels(spark, sf):
    return log_lines(spark, sf).groupBy(fn.log_level(F.col("line")).alias("level")).agg(F.count("*").alias("n"))


@query("x2_reportable_events", """SELECT event_id, CASE WHEN NOT failed THEN 'OK' WHEN critical THEN 'PANIC' ELSE 'DEGRADED' END AS status FROM (
  SELECT event_id, event_type IN ('error', 'signup') AS failed, event_type = 'error' AS critical, CAST(round(value * 100) AS BIGINT) AS d FROM events)
  WHERE failed OR d > 30000""")
def x2_reportable_events(spark, sf):
    events = sensor_events(spark, sf).select(
        "event_id", "duration_ms", (F.col("status") != "OK").alias("failed"), (F.col("status") == "PANIC").alias("critical")
    )
    return T.reportable(events).select("event_id", "status")


@query("t2_recent_events", f"""WITH {SENSOR_CTE} SELECT event_id, component_id, status FROM sensor ORDER BY ts DESC, event_id DESC LIMIT 50""")
def t2_recent_events(spark, sf):
    return T.recent(sensor_events(spark, sf), 50, F.desc("ts"), F.desc("event_id")).select("event_id", "component_id", "status")


@query("t2_recent_errors_page", f"""WITH {SENSOR_CTE} SELECT event_id, component_id FROM sensor WHERE status = 'PANIC' ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 40""")
def t2_recent_errors_page(spark, sf):
    panics = sensor_events(spark, sf).filter("status = 'PANIC'")
    return T.recent(panics, 20, F.desc("ts"), F.desc("event_id"), offset=40).select("event_id", "component_id")


@query("u2_merged_events", f"""WITH {SENSOR_CTE} SELECT epoch_us(ts) AS ts_us, component_id FROM (
  SELECT ts, component_id FROM sensor WHERE event_id % 10 < 7 UNION SELECT ts, component_id FROM sensor WHERE event_id % 10 > 3)""")
def u2_merged_events(spark, sf):
    events = sensor_events(spark, sf)
    stored, live = events.filter("event_id % 10 < 7"), events.filter("event_id % 10 > 3")
    return T.merge_events(stored, live).select(F.unix_micros("ts").alias("ts_us"), "component_id")


@query("n7_failure_streaks", f"""WITH {SENSOR_CTE}, g AS (SELECT *, count(*) FILTER (WHERE status = 'OK') OVER (PARTITION BY component_id ORDER BY ts, event_id) AS grp FROM sensor)
  SELECT event_id, component_id, count(*) FILTER (WHERE status <> 'OK') OVER (PARTITION BY component_id, grp ORDER BY ts, event_id) AS streak FROM g""")
def n7_failure_streaks(spark, sf):
    return TL.failure_streak(sensor_events(spark, sf)).select("event_id", "component_id", "streak")


@query("n7_component_state", f"""WITH {SENSOR_CTE}, ok AS (SELECT component_id, max((ts, event_id)) AS k FROM sensor WHERE status = 'OK' GROUP BY component_id)
  SELECT s.component_id, coalesce(max(epoch_us(ts)) FILTER (WHERE status = 'OK'), 0) AS last_success, coalesce(max(epoch_us(ts)) FILTER (WHERE status <> 'OK'), 0) AS last_failure,
  coalesce(arg_max(error, (ts, event_id)) FILTER (WHERE status <> 'OK'), '') AS last_error,
  count(*) FILTER (WHERE status <> 'OK' AND (ok.k IS NULL OR (ts, event_id) > ok.k)) AS consecutive_failures,
  count(*) FILTER (WHERE status <> 'OK' AND (ok.k IS NULL OR (ts, event_id) > ok.k)) < 2 AS healthy
  FROM sensor s LEFT JOIN ok ON ok.component_id = s.component_id GROUP BY s.component_id""")
def n7_component_state(spark, sf):
    return TL.failure_state(sensor_events(spark, sf))


def _greedy_sql(source: str, key: str, gap: str) -> str:
    return f"""WITH RECURSIVE {source}, kept AS (SELECT component_id, min(ts) AS ts FROM e GROUP BY component_id
      UNION ALL SELECT k.component_id, min(e.ts) FROM kept k JOIN e ON e.component_id = k.component_id AND e.ts >= k.ts + INTERVAL {gap} GROUP BY k.component_id)
      SELECT kept.component_id, min(e.event_id) AS event_id FROM kept JOIN e ON e.component_id = kept.component_id AND e.ts = kept.ts GROUP BY kept.component_id, kept.ts"""


@query("n8_suppressed_errors", _greedy_sql(
    f"{SENSOR_CTE}, e AS (SELECT component_id, ts, event_id FROM sensor WHERE status <> 'OK')", "component_id", "6 HOUR"))
def n8_suppressed_errors(spark, sf):
    failed = sensor_events(spark, sf).filter("status <> 'OK'")
    return TL.suppress(failed, 6 * 3600).select("component_id", "event_id")


@query("n8_suppressed_hot_keys", _greedy_sql(
    "e AS (SELECT event_type AS component_id, ts, event_id FROM events)", "component_id", "45 MINUTE"))
def n8_suppressed_hot_keys(spark, sf):
    from lintlake.plans.corpus import table

    events = table(spark, sf, "events").withColumn("component_id", F.col("event_type"))
    return TL.suppress(events, 45 * 60).select("component_id", "event_id")


@query("n9_running_occurrences", f"""WITH {ERRORS_CTE} SELECT id, lower(error_type) AS error_type, file_path, row_number() OVER w AS occurrence,
  CAST(sum(pain) OVER w AS DOUBLE) / row_number() OVER w AS avg_pain FROM errors WINDOW w AS (PARTITION BY lower(error_type), file_path ORDER BY ts, id ROWS UNBOUNDED PRECEDING)""")
def n9_running_occurrences(spark, sf):
    return TL.occurrences(errors(spark, sf)).select("id", "error_type", "file_path", "occurrence", "avg_pain")


@query("f8_relative_age", """SELECT event_id, CASE WHEN d < 60 THEN d || ' s ago' WHEN d < 3600 THEN (d // 60) || ' min ago'
  WHEN d < 86400 THEN (d // 3600) || ' h ago' ELSE (d // 86400) || ' d ago' END AS age
  FROM (SELECT event_id, (epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts)) // 1000000 AS d FROM events)""")
def f8_relative_age(spark, sf):
    from lintlake.plans.corpus import table

    events = table(spark, sf, "events")
    return events.select("event_id", fn.relative_age(F.col("ts"), latest_ts(events)).alias("age"))
