"""Source, sink, streaming and plug-in queries."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from lintlake.operators import gates as G, registry as V, rollups as R, rule_index, scans as S, scoring as SC
from lintlake.plans.corpus import code_files, over_files, over_lines, table
from lintlake.plans.model import LOG_CTE, SENSOR_CTE, log_lines, sensor_events
from lintlake.plans.registry import query, sq, sql_values
from lintlake.plans.rollup_queries import _FINDINGS, findings
from lintlake.plans.scan_queries import matches
from lintlake.plans.scoring_queries import METRICS_CTE, DIMS
from lintlake.plans.telemetry_queries import _greedy_sql
from lintlake.rules import code_rules
from lintlake.session import work_path
from lintlake.sources import readers, sinks
from lintlake.streaming import live

_STATUS = "CASE event_type WHEN 'error' THEN 'PANIC' WHEN 'signup' THEN 'DEGRADED' ELSE 'OK' END"


PARTS, FILE_ROWS = 4, 1_000_000
#: Hours by which rows come late in the streams that take them in event time, and how long these wait.
LATE, DELAY = 6, "7 hours"


def event_stream(spark, sf, late: int = 0):
    """The given events as a stream that brings them in ``PARTS`` micro-batches of files, by the time at which they arrive.

    A file source follows the order in which files were written, so the parts are cut by time and written one after the other, each in
    many tasks. Rows without a time come with the last part. With ``late`` rows arrive up to so many hours after their time, in shuffled
    order, and a heartbeat (a row without an id) ends the stream.
    """
    events = table(spark, sf, "events")
    path, hours = work_path(spark, "events"), 3_600_000_000
    at = F.unix_micros("ts") + (F.pmod(F.xxhash64("event_id"), F.lit(late * hours)) if late else F.lit(0))
    found = events.agg(F.percentile_approx(at, [k / PARTS for k in range(1, PARTS)], 10_000).alias("cuts"), F.count("*").alias("n"), F.max("ts").alias("last")).first()
    cuts, files = found["cuts"] or [], max(1, -(-found["n"] // (PARTS * FILE_ROWS)))
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = events
        if low is not None:
            part = part.filter((at > low) | at.isNull()) if high is None else part.filter(at > low)
        if high is not None:
            part = part.filter(at <= high)
        part.repartitionByRange(files, "ts").write.mode("append").parquet(path)
    if late:
        beat = spark.range(1).select(*[
            (F.lit(found["last"]) + F.make_interval(years=F.lit(1)) if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema])
        beat.write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(path)


def log_stream(spark, sf):
    """The log lines, in several files and micro-batches."""
    path, lines = work_path(spark, "logs"), log_lines(spark, sf)
    files = max(1, -(-lines.count() // (PARTS * FILE_ROWS)))
    lines.select(F.col("line").alias("value")).repartition(PARTS * files).write.text(path)
    return readers.tail_log(spark, path, files)


def sensor_stream(spark, sf, late: int = 0):
    return event_stream(spark, sf, late).select(
        "event_id", F.concat(F.lit("app:"), F.col("user_id").cast("string")).alias("component_id"), F.expr(_STATUS).alias("status"),
        F.round(F.col("value") * 100).cast("long").alias("duration_ms"), "ts", "event_type",
    )


# --- sources and sinks ------------------------------------------------------------------------

@query("s1_corpus_tree", """SELECT source AS repo, CAST(sum(len(text) - len(replace(text, chr(10), '')) + 1) AS BIGINT) AS newlines, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes
  FROM documents WHERE source NOT IN ('src3', 'src7') GROUP BY source""")
def s1_corpus_tree(spark, sf):
    root = work_path(spark, "tree")
    table(spark, sf, "documents").select("source", "text").write.partitionBy("source").text(root)
    files = readers.read_files(spark, root, "*.txt", ["source=src3", "source=src7"])
    newlines = F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit("")))
    return files.groupBy(F.replace("repo", F.lit("source="), F.lit("")).alias("repo")).agg(
        F.sum(newlines).cast("long").alias("newlines"), F.sum("size").alias("bytes"))


@query("s2_recent_json_events", f"WITH {SENSOR_CTE} SELECT event_id, component_id, status FROM sensor WHERE event_id % 5 > 0 ORDER BY ts DESC, event_id DESC LIMIT 200")
def s2_recent_json_events(spark, sf):
    path = work_path(spark, "events-json")
    events = sensor_events(spark, sf).select("event_id", "component_id", "status", F.col("duration_ms").cast("double").alias("duration_ms"), "ts")
    broken = F.when(F.col("event_id") % 5 == 0, "{broken").otherwise(F.to_json(F.struct(*events.columns)))
    events.select(broken.alias("value")).write.text(path)
    return readers.read_events(spark, path, 200).select("event_id", "component_id", "status")


@query("k1_appended_events", f"WITH {SENSOR_CTE} SELECT event_id, component_id, status FROM sensor WHERE status <> 'OK'")
def k1_appended_events(spark, sf):
    path = work_path(spark, "event-log")
    events = sensor_events(spark, sf).select("event_id", "component_id", "status", "ts")
    sinks.append(events.filter("status = 'PANIC'"), path)
    sinks.append(events.filter("status = 'DEGRADED'"), path)
    return readers.read_events(spark, path).select("event_id", "component_id", "status")


@query("k2_replaced_snapshots", over_files("SELECT CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS snapshot_id, path FROM files WHERE doc_id % 2 = 0 OR doc_id % 3 = 0"))
def k2_replaced_snapshots(spark, sf):
    path = work_path(spark, "snapshots")
    files = code_files(spark, sf).select("doc_id", "path")
    sinks.save_snapshot(files.filter("doc_id % 2 = 0").select("path"), path, "a")
    sinks.save_snapshot(files.filter("doc_id % 2 = 1").select("path"), path, "b")
    sinks.save_snapshot(files.filter("doc_id % 2 = 1 AND doc_id % 3 = 0").select("path"), path, "b")
    return sinks.all_snapshots(spark, path).select("snapshot_id", "path")


def _three_snapshots(spark, sf) -> str:
    path = work_path(spark, "named")
    for name, part in (("a", "doc_id % 2 = 0"), ("b", "doc_id % 3 = 0"), ("c", "doc_id % 5 > 0")):
        sinks.save_snapshot(code_files(spark, sf).filter(part).select("path"), path, name)
    return path


@query("m9_listed_snapshots", "SELECT 'a' AS snapshot_id, count(*) AS n FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'c', count(*) FROM documents WHERE doc_id % 5 > 0")
def m9_listed_snapshots(spark, sf):
    path = _three_snapshots(spark, sf)
    sinks.delete_snapshot(spark, path, "b")
    return sinks.list_snapshots(spark, path)


@query("m9_one_snapshot", over_files("SELECT path FROM files WHERE doc_id % 3 = 0"))
def m9_one_snapshot(spark, sf):
    return sinks.get_snapshot(spark, _three_snapshots(spark, sf), "b").select("path")


@query("k4_report_rows", f"""WITH {_FINDINGS} SELECT 'summary' AS kind, level, count(*) AS n FROM findings GROUP BY level UNION ALL SELECT 'finding', level, count(*) FROM findings GROUP BY level""")
def k4_report_rows(spark, sf):
    path = work_path(spark, "report")
    sinks.write_report(findings(spark, sf), path)
    body = F.from_json("body", "level string, n long")
    rows = spark.read.schema("kind string, body string").json(path).select("kind", body.alias("b"))
    return rows.groupBy("kind", F.col("b.level").alias("level")).agg(
        F.sum(F.when(F.col("kind") == "summary", F.col("b.n")).otherwise(1)).alias("n"))


# --- streaming --------------------------------------------------------------------------------

_MATCHED = "regexp_matches(line, 'ERROR|Traceback|WARN')"
_LEVEL = "CASE WHEN contains(line, 'ERROR') OR contains(line, 'Traceback') THEN 'ERROR' WHEN contains(line, 'WARN') THEN 'WARNING' ELSE 'INFO' END"


@query("s3_tailed_log", f"WITH {LOG_CTE} SELECT trim(line, ' ') AS line, count(*) AS n FROM loglines WHERE trim(line, ' ') <> '' GROUP BY 1")
def s3_tailed_log(spark, sf):
    lines = live.drain(log_stream(spark, sf), "tail")
    return lines.groupBy("line").agg(F.count("*").alias("n"))


@query("x1_stream_error_lines", f"WITH {LOG_CTE} SELECT trim(line, ' ') AS line, {_LEVEL} AS level, count(*) AS n FROM loglines WHERE {_MATCHED} GROUP BY ALL")
def x1_stream_error_lines(spark, sf):
    stream = live.stream_errors(log_stream(spark, sf), "ERROR|Traceback|WARN")
    return live.drain(stream, "errors").groupBy("line", "level").agg(F.count("*").alias("n"))


@query("x1_stream_error_counts", f"WITH {LOG_CTE} SELECT {_LEVEL} AS level, count(*) AS errors FROM loglines WHERE {_MATCHED} GROUP BY 1")
def x1_stream_error_counts(spark, sf):
    stream = live.stream_errors(log_stream(spark, sf), "ERROR|Traceback|WARN")
    return live.drain(live.running_errors(stream), "error-counts", "complete")


@query("x2_stream_events", f"SELECT event_id, {_STATUS} AS status FROM events WHERE event_type IN ('error', 'signup') OR CAST(round(value * 100) AS BIGINT) > 30000")
def x2_stream_events(spark, sf):
    events = sensor_stream(spark, sf).select(
        "event_id", "duration_ms", (F.col("status") != "OK").alias("failed"), (F.col("status") == "PANIC").alias("critical"))
    return live.drain(live.stream_events(events), "events").select("event_id", "status")


@query("x3_stream_suppression", _greedy_sql("e AS (SELECT event_type AS component_id, ts, event_id FROM events)", "component_id", "45 MINUTE"))
def x3_stream_suppression(spark, sf):
    events = event_stream(spark, sf, LATE).withColumn("component_id", F.col("event_type"))
    return live.drain(live.stream_suppress(events, 45 * 60, delay=DELAY), "suppressed").select("component_id", "event_id")


@query("x4_stream_health", f"""WITH {SENSOR_CTE}, ok AS (SELECT component_id, max((ts, event_id)) AS k FROM sensor WHERE status = 'OK' GROUP BY component_id),
  s AS (SELECT s.component_id, count(*) FILTER (WHERE status <> 'OK' AND (ok.k IS NULL OR (ts, event_id) > ok.k)) AS consecutive_failures, coalesce(max(epoch_us(ts)) FILTER (WHERE status = 'OK'), 0) AS last_success,
  coalesce(max(epoch_us(ts)) FILTER (WHERE status <> 'OK'), 0) AS last_failure FROM sensor s LEFT JOIN ok ON ok.component_id = s.component_id GROUP BY s.component_id) SELECT *, consecutive_failures < 2 AS healthy FROM s""")
def x4_stream_health(spark, sf):
    health = live.stream_health(sensor_stream(spark, sf, LATE), delay=DELAY)
    return live.drain(health, "health", "update", ["component_id"])


@query("x5_stream_debounce", _greedy_sql("e AS (SELECT 'u' || (user_id % 12) AS component_id, ts, event_id FROM events)", "component_id", "90 MINUTE").replace("SELECT kept.component_id, min", "SELECT kept.component_id AS path, min"))
def x5_stream_debounce(spark, sf):
    changes = event_stream(spark, sf, LATE).withColumn("path", F.concat(F.lit("u"), (F.col("user_id") % 12).cast("string")))
    return live.drain(live.stream_debounce(changes, 90 * 60, delay=DELAY), "debounced").select("path", "event_id")


@query("x6_stream_check", """SELECT CAST(count(*) AS BIGINT) AS error_count, sum(CASE WHEN event_type = 'error' THEN 20 ELSE 0 END) / count(*)::DOUBLE AS mean_score FROM events""")
def x6_stream_check(spark, sf):
    changes = event_stream(spark, sf).select(
        F.when(F.col("event_type") == "error", "api_change").otherwise("note").alias("error_type"), F.lit("lib/x.py").alias("file_path"), F.lit("").alias("message"))
    path = work_path(spark, "status")

    def check(batch):
        return SC.total_pain(SC.pain_score(batch)).select("error_count", "mean_score")

    live.stream_check(changes, check, path, work_path(spark, "status-checkpoint")).awaitTermination()
    rows = spark.read.schema("error_count long, mean_score double").option("recursiveFileLookup", "true").parquet(path)
    # a row per micro-batch; the mean is weighted by each batch's errors
    total = F.sum("error_count")
    return rows.agg(total.alias("error_count"), (F.sum(F.round(F.col("mean_score") * F.col("error_count"))) / total).alias("mean_score"))


@query("x7_stream_windows", f"""WITH {METRICS_CTE} SELECT epoch_us(date_trunc('day', ts)) AS start_us, type, count(*) AS n, avg(value) AS mean FROM metrics
  WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM metrics) - INTERVAL 1 HOUR GROUP BY ALL""")
def x7_stream_windows(spark, sf):
    kind = F.create_map(*[F.lit(x) for kv in DIMS.items() for x in kv])
    metrics = event_stream(spark, sf).select(kind[F.col("event_type")].alias("type"), (F.floor(F.col("value") * 1024 / 500) / 1024.0).alias("value"), "ts")
    return live.drain(live.stream_metrics(metrics), "windows")


@query("x7_open_windows", f"""WITH {METRICS_CTE} SELECT epoch_us(date_trunc('day', ts)) AS start_us, type, count(*) AS n, avg(value) AS mean FROM metrics GROUP BY ALL""")
def x7_open_windows(spark, sf):
    kind = F.create_map(*[F.lit(x) for kv in DIMS.items() for x in kv])
    metrics = event_stream(spark, sf).select(kind[F.col("event_type")].alias("type"), (F.floor(F.col("value") * 1024 / 500) / 1024.0).alias("value"), "ts")
    return live.drain(live.stream_metrics(metrics, delay="2 days"), "open-windows", "update", ["start_us", "type"])


@query("k3_panic_alerts", "SELECT k.* FROM (" + _greedy_sql(f"{SENSOR_CTE}, e AS (SELECT component_id, ts, event_id FROM sensor WHERE status <> 'OK')", "component_id", "6 HOUR")
       + ") k JOIN events v ON v.event_id = k.event_id WHERE v.event_type = 'error'")
def k3_panic_alerts(spark, sf):
    failed = sensor_stream(spark, sf, LATE).filter("status <> 'OK' OR event_id IS NULL")
    return live.drain(live.alerts(failed, 6 * 3600, DELAY), "alerts").select("component_id", "event_id")


# --- plug-ins ---------------------------------------------------------------------------------

def plugged_checks() -> V.Checks:
    checks = V.Checks()
    checks.add("secrets", lambda t: R.finding(S.scan_secrets(t["files"]), F.col("rule"), "fail", F.col("level")))
    checks.add("sql", lambda t: R.finding(S.scan_sql_injection(t["files"]), "SQL-001", "fail", "CRITICAL", F.col("kind")))
    return checks


@query("v1_all_checks", f"WITH {_FINDINGS} SELECT *, CASE WHEN rule_id = 'SQL-001' THEN 'sql' ELSE 'secrets' END AS check_name FROM findings WHERE type = 'fail'")
def v1_all_checks(spark, sf):
    return plugged_checks().run_all({"files": code_files(spark, sf)})


@query("v3_one_check", f"WITH {_FINDINGS} SELECT *, 'sql' AS check_name FROM findings WHERE rule_id = 'SQL-001'")
def v3_one_check(spark, sf):
    return plugged_checks().run("sql", {"files": code_files(spark, sf)})


def _long_lines(path: str, content: str) -> list[tuple[int, str]]:
    return [(i, "long") for i, line in enumerate(content.split("\n"), 1) if len(line) > 90]


def _no_go(path: str, content: str) -> list[tuple[int, str]]:
    if path.endswith(".go"):
        raise ValueError("no go")
    return []


@query("v2_file_rules", over_lines("""SELECT repo, path, line_no, 'long_lines' AS rule_id, 'long' AS message, '' AS error FROM lines WHERE length(line) > 90
  UNION ALL SELECT repo, path, 0, 'no_go', '', 'ValueError: no go' FROM files WHERE ext = 'go'"""))
def v2_file_rules(spark, sf):
    found = V.run_file_rules(code_files(spark, sf), {"long_lines": _long_lines, "no_go": _no_go})
    return found.withColumn("error", F.coalesce("error", F.lit("")))


_PACK = [("P1", r"\bTODO\b", "LOW", True), ("P2", r"print\(", "INFO", True), ("P3", r"return", "INFO", False), ("P4", r"panic\(|requireAuth", "HIGH", True)]


@query("v5_rule_pack", over_lines(" UNION ALL ".join(
    f"SELECT repo, path, line_no, {sq(i)} AS rule_id, {sq(s)} AS level FROM lines WHERE {matches('line', p)}" for i, p, s, on in _PACK if on)))
def v5_rule_pack(spark, sf):
    pack = spark.createDataFrame(_PACK, "rule_id string, pattern string, severity string, enabled boolean")
    return V.run_rule_pack(code_files(spark, sf), V.rule_rows(pack))


#: One rule a word of the benchmark texts; a match is a line with the word and whatever letters follow.
@query("v5_large_rule_pack", over_lines("""SELECT repo, path, line_no, 'W:' || word AS rule_id, 'LOW' AS level FROM lines
  JOIN (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{5,}')) AS word FROM benchmark) ON contains(line, word)"""))
def v5_large_rule_pack(spark, sf):
    words = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{5,}"), F.lit(0))).alias("word")).distinct()
    pack = words.select(
        F.concat(F.lit("W:"), "word").alias("rule_id"), F.concat("word", F.lit("[a-z]*")).alias("pattern"), F.lit("LOW").alias("severity"),
        F.lit(True).alias("enabled"))
    return rule_index.run_large_rule_pack(code_files(spark, sf), pack)
