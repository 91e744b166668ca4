"""Memory queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.operators import memory as M
from lintlake.operators.ranking import rank_within
from lintlake.plans.corpus import spread, table
from lintlake.plans.model import ERRORS_CTE, errors, latest_ts
from lintlake.plans.registry import query, sq, sql_list, sql_values
from lintlake.plans.scan_queries import has_any
from lintlake.plans.scoring_queries import INSIGHTS_CTE, RULES_CTE, _pick, insights
from lintlake.rules import scoring_rules as R
from lintlake.session import work_path
from lintlake.sources.pages import PagedTable
from lintlake.sources.store import KeyedTable, Store

BUGS_CTE = f"""{ERRORS_CTE}, bugs AS (SELECT id, error_type, file_path, pain AS pain_score, ts AS first_seen, CAST(1 + id % 4 AS BIGINT) AS occurrence_count,
  CASE WHEN id % 7 = 0 THEN 'resolved' ELSE 'active' END AS status, CAST(pain + id % 3 AS BIGINT) AS avg_pain FROM errors)"""


def bug_memories(spark, sf):
    i = F.col("id")
    return errors(spark, sf).select(
        "id", "error_type", "file_path", F.col("pain").alias("pain_score"), F.col("ts").alias("first_seen"),
        (i % 4 + 1).alias("occurrence_count"), F.when(i % 7 == 0, "resolved").otherwise("active").alias("status"),
        (F.col("pain") + i % 3).alias("avg_pain"),
    )


@query("s4_store_scan", f"WITH {BUGS_CTE} SELECT id, file_path FROM bugs WHERE status = 'active' AND error_type = 'ERROR'")
def s4_store_scan(spark, sf):
    return M.select_equal(bug_memories(spark, sf), status="active", error_type="ERROR").select("id", "file_path")


_BUG_STATS = """bug_stats AS (SELECT count(*) AS total, avg(pain_score) AS avg_pain, max(pain_score) AS max_pain, min(pain_score) AS min_pain,
  CAST(sum(occurrence_count) AS BIGINT) AS total_occurrences, count(DISTINCT error_type) AS unique_errors, count(DISTINCT file_path) AS affected_files FROM bugs)"""
_INSIGHT_STATS = """insight_stats AS (SELECT count(*) AS total, count(*) FILTER (WHERE applied) AS applied, count(*) FILTER (WHERE NOT applied) AS unapplied,
  avg(confidence) AS avg_confidence FROM insights)"""


@query("a5_bug_stats", f"WITH {BUGS_CTE}, {_BUG_STATS} SELECT * FROM bug_stats")
def a5_bug_stats(spark, sf):
    return M.bug_stats(bug_memories(spark, sf))


@query("a6_insight_stats", f"WITH {INSIGHTS_CTE}, {_INSIGHT_STATS} SELECT * FROM insight_stats")
def a6_insight_stats(spark, sf):
    return M.insight_stats(insights(spark, sf))


@query("a7_top_recurring", f"WITH {BUGS_CTE} SELECT error_type, file_path, count(*) AS n, avg(pain_score) AS avg_pain FROM bugs GROUP BY ALL ORDER BY n DESC, error_type, file_path LIMIT 10")
def a7_top_recurring(spark, sf):
    return M.top_recurring(bug_memories(spark, sf))


@query("a8_daily_trend", f"""WITH {BUGS_CTE} SELECT strftime(first_seen, '%Y-%m-%d') AS day, count(*) AS n, avg(pain_score) AS avg_pain FROM bugs
  WHERE first_seen > (SELECT max(first_seen) FROM bugs) - INTERVAL 7 DAY GROUP BY ALL""")
def a8_daily_trend(spark, sf):
    bugs = bug_memories(spark, sf)
    return M.daily_trend(bugs, latest_ts(bugs, "first_seen"))


@query("a9_new_last_day", f"WITH {BUGS_CTE} SELECT count(*) FILTER (WHERE first_seen > (SELECT max(first_seen) FROM bugs) - INTERVAL 24 HOUR) AS pending FROM bugs")
def a9_new_last_day(spark, sf):
    bugs = bug_memories(spark, sf)
    return M.new_since(bugs, latest_ts(bugs, "first_seen"))


@query("a10_memory_quality", f"""WITH {BUGS_CTE}, {_BUG_STATS}, {INSIGHTS_CTE}, {_INSIGHT_STATS}, s AS (SELECT least(greatest(50.0::DOUBLE + CASE WHEN i.applied > 0 THEN i.applied * 20.0::DOUBLE / greatest(i.total, 1) ELSE 0 END
  + CASE WHEN b.avg_pain > 50 THEN 10 ELSE 0 END - CASE WHEN b.total_occurrences > 100 THEN 10 ELSE 0 END - CASE WHEN b.unique_errors > 50 THEN 10 ELSE 0 END, 0), 100) AS score FROM bug_stats b, insight_stats i)
  SELECT score, CASE WHEN score >= 80 THEN 'excellent' WHEN score >= 60 THEN 'good' WHEN score >= 40 THEN 'fair' ELSE 'poor' END AS level FROM s""")
def a10_memory_quality(spark, sf):
    return M.quality_score(M.bug_stats(bug_memories(spark, sf)), M.insight_stats(insights(spark, sf)))


@query("a11_store_counts", f"""WITH {BUGS_CTE}, {INSIGHTS_CTE} SELECT 'bug_memories' AS table_name, count(*) AS n FROM bugs UNION ALL SELECT 'insights', count(*) FROM insights
  UNION ALL SELECT 'unapplied_insights', count(*) FROM insights WHERE NOT applied UNION ALL SELECT 'lessons', count(*) FROM conversations""")
def a11_store_counts(spark, sf):
    rows = insights(spark, sf)
    return M.store_counts({
        "bug_memories": bug_memories(spark, sf), "insights": rows, "unapplied_insights": rows.filter("NOT applied"),
        "lessons": table(spark, sf, "conversations"),
    })


@query("a12_repeat_stats", f"""WITH {BUGS_CTE} SELECT count(*) AS total_memories, count(*) FILTER (WHERE occurrence_count >= 2) AS repeated_bugs,
  coalesce(avg(avg_pain) FILTER (WHERE status = 'active'), 0) AS avg_pain FROM bugs""")
def a12_repeat_stats(spark, sf):
    return M.repeat_stats(bug_memories(spark, sf))


@query("t3_repeated_bugs", f"WITH {BUGS_CTE} SELECT id, occurrence_count, avg_pain FROM bugs WHERE occurrence_count >= 3 AND status = 'active'")
def t3_repeated_bugs(spark, sf):
    return M.repeated_bugs(bug_memories(spark, sf), 3).select("id", "occurrence_count", "avg_pain")


# --- redlines, lessons, templates -------------------------------------------------------------

REDLINES_CTE = """redlines AS (SELECT p_partkey AS id, p_name AS title, p_type AS description, (['critical', 'warning', 'info'])[1 + (p_size % 3)] AS severity,
  p_partkey * 31 % 5003 AS created_at FROM part)"""
LESSONS_CTE = """lessons AS (SELECT conv_id * 100 + turn AS id, role || ' turn ' || turn AS title, substr(text, 1, 30) AS error_summary, CAST(1 + turn AS BIGINT) AS failure_count,
  CASE WHEN conv_id % 9 = 0 THEN '' ELSE substr(sha256(role || (turn % 4) || (conv_id % 20)), 1, 12) END AS content_hash, (SELECT min(ts) FROM events) + to_hours(CAST(conv_id * 17 % 2500 AS INTEGER)) AS captured_at, conv_id FROM conversations)"""
TEMPLATES_CTE = """templates AS (SELECT p_partkey AS id, p_type AS domain, p_name AS title, p_size % 10 AS importance,
  (SELECT min(ts) FROM events) + to_hours(CAST(p_partkey % 6000 AS INTEGER)) AS created_at FROM part)"""


def redlines(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        k.alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("description"),
        _pick(["critical", "warning", "info"], F.col("p_size") % 3).alias("severity"), (k * 31 % 5003).alias("created_at"),
    )


def _start(spark, sf):
    return F.lit(table(spark, sf, "events").agg(F.min("ts")).first()[0])


def lessons(spark, sf):
    conv, turn = F.col("conv_id"), F.col("turn")
    key = F.concat("role", (turn % 4).cast("string"), (conv % 20).cast("string"))
    return table(spark, sf, "conversations").select(
        (conv * 100 + turn).alias("id"), F.concat("role", F.lit(" turn "), turn.cast("string")).alias("title"),
        F.substring("text", 1, 30).alias("error_summary"), (turn + 1).alias("failure_count"),
        F.when(conv % 9 == 0, "").otherwise(F.substring(F.sha2(key, 256), 1, 12)).alias("content_hash"),
        (_start(spark, sf) + F.make_interval(hours=(conv * 17 % 2500).cast("int"))).alias("captured_at"), "conv_id",
    )


def templates(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        k.alias("id"), F.col("p_type").alias("domain"), F.col("p_name").alias("title"), (F.col("p_size") % 10).alias("importance"),
        (_start(spark, sf) + F.make_interval(hours=(k % 6000).cast("int"))).alias("created_at"),
    )


@query("a51_redline_counts", f"""WITH {REDLINES_CTE} SELECT count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'warning') AS warning,
  count(*) FILTER (WHERE severity = 'info') AS info FROM redlines""")
def a51_redline_counts(spark, sf):
    return M.severity_counts(redlines(spark, sf))


@query("t4_ordered_redlines", f"WITH {REDLINES_CTE} SELECT id, severity, row_number() OVER (ORDER BY severity DESC, created_at DESC, id) AS rank FROM redlines")
def t4_ordered_redlines(spark, sf):
    # ranks come from (severity, time) blocks, so no task sorts the whole table
    ordered = redlines(spark, sf).withColumn("_all", F.lit(0))
    block = F.when(F.col("severity") == "warning", 0).when(F.col("severity") == "info", 1).otherwise(2)
    ranked = rank_within(ordered, ["_all"], [("_b", block), ("_c", -F.floor(F.col("created_at") / 64))], [F.desc("created_at"), F.col("id")])
    return ranked.select("id", "severity", F.col("rank").cast("long").alias("rank"))


@query("t4_ordered_templates", f"WITH {TEMPLATES_CTE} SELECT id, importance FROM templates ORDER BY importance DESC, created_at DESC, id LIMIT 50")
def t4_ordered_templates(spark, sf):
    return templates(spark, sf).orderBy(F.desc("importance"), F.desc("created_at"), "id").limit(50).select("id", "importance")


@query("t4_ordered_skills", """SELECT id, tool, row_number() OVER (PARTITION BY tool ORDER BY priority DESC, id) AS rank FROM (SELECT p_partkey AS id, 'tool' || (p_partkey % 5) AS tool, p_size AS priority, p_partkey % 3 > 0 AS is_active FROM part) WHERE is_active""")
def t4_ordered_skills(spark, sf):
    k = F.col("p_partkey")
    skills = table(spark, sf, "part").select(
        k.alias("id"), F.concat(F.lit("tool"), (k % 5).cast("string")).alias("tool"), F.col("p_size").alias("priority"), (k % 3 > 0).alias("is_active"))
    return M.ordered_skills(skills).select("id", "tool", F.col("rank").cast("long").alias("rank"))


@query("t5_context_pack", f"""WITH {REDLINES_CTE}, {LESSONS_CTE}, {TEMPLATES_CTE} SELECT section, string_agg(text, chr(10) ORDER BY rank) AS text FROM (
  SELECT 'redlines' AS section, title || ': ' || description AS text, row_number() OVER (ORDER BY severity DESC, created_at DESC, id) AS rank, 20 AS lim FROM redlines
  UNION ALL SELECT 'lessons', title, row_number() OVER (ORDER BY captured_at DESC, id), 5 FROM lessons
  UNION ALL SELECT 'templates', '[' || domain || '] ' || title, row_number() OVER (ORDER BY importance DESC, created_at DESC, id), 5 FROM templates) WHERE rank <= lim GROUP BY section""")
def t5_context_pack(spark, sf):
    return M.context_pack(redlines(spark, sf), lessons(spark, sf), templates(spark, sf))


_UPSERTED = f"""WITH {LESSONS_CTE}, l AS (SELECT * FROM lessons) SELECT content_hash, arg_min(id, (captured_at, id)) AS id, arg_max(error_summary, (captured_at, id)) AS error_summary,
  CAST(sum(failure_count) AS BIGINT) AS failure_count, epoch_us(max(captured_at)) AS captured_us FROM l WHERE content_hash <> '' GROUP BY content_hash
  UNION ALL SELECT content_hash, id, error_summary, failure_count, epoch_us(captured_at) FROM l WHERE content_hash = ''"""


@query("m1_upserted_lessons", _UPSERTED)
def m1_upserted_lessons(spark, sf):
    rows = lessons(spark, sf)
    old, new = rows.filter("conv_id % 2 = 0").drop("conv_id"), rows.filter("conv_id % 2 = 1").drop("conv_id")
    return M.upsert_lessons(old, new).select(
        "content_hash", "id", "error_summary", "failure_count", F.unix_micros("captured_at").alias("captured_us")
    )


@query("m1_stored_lessons", _UPSERTED)
def m1_stored_lessons(spark, sf):
    rows = lessons(spark, sf)
    kept = M.lessons_table(Store(spark, work_path(spark, "lessons")), buckets=16)
    for batch in (0, 1, 1):  # the last one is a replay
        M.store_lessons(kept, rows.filter(f"conv_id % 2 = {batch}").drop("conv_id"), batch)
    return kept.read().select("content_hash", "id", "error_summary", "failure_count", F.unix_micros("captured_at").alias("captured_us"))


_REPLACED = """SELECT service, endpoint, arg_max(status_code, (seq, status_code)) AS status_code, max(seq) AS seq FROM (
  SELECT 's' || (l_suppkey % 20) AS service, '/p' || (l_partkey % 300) AS endpoint, 200 + l_linenumber AS status_code, l_orderkey * 10 + l_linenumber AS seq FROM lineitem) GROUP BY ALL"""


def _contract_rows(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.concat(F.lit("s"), (F.col("l_suppkey") % 20).cast("string")).alias("service"),
        F.concat(F.lit("/p"), (F.col("l_partkey") % 300).cast("string")).alias("endpoint"),
        (F.col("l_linenumber") + 200).alias("status_code"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )
    return rows.filter("seq % 3 > 0"), rows.filter("seq % 3 = 0")


@query("m2_replaced_contracts", _REPLACED)
def m2_replaced_contracts(spark, sf):
    return M.replace_by_key(*_contract_rows(spark, sf), ["service", "endpoint"], "seq")


@query("m2_stored_contracts", _REPLACED)
def m2_stored_contracts(spark, sf):
    kept = KeyedTable(Store(spark, work_path(spark, "contracts")), "contracts", "struct(service, endpoint)", 16)
    for rows in _contract_rows(spark, sf):
        M.store_by_key(kept, rows, ["service", "endpoint"], "seq")
    return kept.read()


_ADMIT_ERRORS = """e AS (SELECT event_id AS id, (['syntax_error', 'API_Error', 'import_error', 'race'])[1 + (event_id % 4)] AS error_type,
  'm/u' || (user_id % 25) || '.py' AS file_path, ts, CAST(round(value) AS BIGINT) % 101 AS pain FROM events)"""
_ADMITTED = f"""{_ADMIT_ERRORS}, w AS (SELECT id, lower(error_type) AS error_type, file_path, ts, pain FROM e WHERE pain >= 50), c AS (SELECT *,
  count(*) OVER (PARTITION BY error_type, file_path ORDER BY ts RANGE BETWEEN INTERVAL 168 HOUR PRECEDING AND CURRENT ROW) - 1 AS earlier FROM w),
  admitted AS (SELECT * FROM c WHERE NOT ({has_any('error_type', R.LOW_PRIORITY_TYPES)}) OR earlier >= 2)"""


def _admit_errors(spark, sf):
    e = F.col("event_id")
    return table(spark, sf, "events").select(
        e.alias("id"), _pick(["syntax_error", "API_Error", "import_error", "race"], e % 4).alias("error_type"),
        F.concat(F.lit("m/u"), (F.col("user_id") % 25).cast("string"), F.lit(".py")).alias("file_path"), "ts",
        (F.round("value").cast("long") % 101).alias("pain"),
    )


@query("m3_admitted_errors", f"WITH {_ADMITTED} SELECT id, error_type, file_path, pain FROM admitted")
def m3_admitted_errors(spark, sf):
    return M.admit(_admit_errors(spark, sf)).select("id", "error_type", "file_path", "pain")


@query("m3_remembered_errors", f"WITH {_ADMITTED} SELECT error_type, file_path, min(id) AS id, count(*) AS occurrence_count, avg(pain) AS avg_pain, epoch_us(max(ts)) AS last_us FROM admitted GROUP BY ALL")
def m3_remembered_errors(spark, sf):
    return M.remember(M.admit(_admit_errors(spark, sf))).select(
        "error_type", "file_path", "id", "occurrence_count", "avg_pain", F.unix_micros("last_seen").alias("last_us")
    )


@query("m4_deleted_by_id", "SELECT event_id, 'ev_' || event_id AS id FROM events WHERE NOT contains('ev_' || event_id, '_12')")
def m4_deleted_by_id(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.concat(F.lit("ev_"), F.col("event_id").cast("string")).alias("id"))
    return M.delete_containing(rows, "_12")


@query("m4_stored_delete", "SELECT event_id, 'ev_' || event_id AS id FROM events WHERE NOT contains('ev_' || event_id, '_12')")
def m4_stored_delete(spark, sf):
    kept = KeyedTable(Store(spark, work_path(spark, "event-rows")), "events", "id", 16)
    kept.merge(table(spark, sf, "events").select("event_id", F.concat(F.lit("ev_"), F.col("event_id").cast("string")).alias("id")), lambda old, new: old.union(new))
    M.delete_stored(kept, "_12")
    return kept.read()


@query("m5_retained_lessons", f"WITH {LESSONS_CTE} SELECT id FROM lessons WHERE NOT captured_at < (SELECT max(captured_at) FROM lessons) - INTERVAL 45 DAY")
def m5_retained_lessons(spark, sf):
    rows = lessons(spark, sf)
    return M.retain(rows, latest_ts(rows, "captured_at"), "captured_at", 45).select("id")


@query("m5_stored_retention", f"WITH {LESSONS_CTE} SELECT id FROM lessons WHERE NOT captured_at < (SELECT max(captured_at) FROM lessons) - INTERVAL 45 DAY")
def m5_stored_retention(spark, sf):
    rows = lessons(spark, sf).drop("conv_id")
    kept = M.lessons_table(Store(spark, work_path(spark, "lessons")), buckets=16)
    kept.merge(rows, lambda old, new: old.unionByName(new))
    M.retain_stored(kept, latest_ts(rows, "captured_at"), "captured_at", 45)
    return kept.read().select("id")


@query("m5_retained_templates", f"WITH {TEMPLATES_CTE} SELECT id FROM templates WHERE NOT (created_at < (SELECT max(created_at) FROM templates) - INTERVAL 30 DAY AND importance < 5)")
def m5_retained_templates(spark, sf):
    rows = templates(spark, sf)
    return M.retain(rows, latest_ts(rows, "created_at"), "created_at", 30, 5).select("id")


@query("m5_retention_dry_run", f"WITH {LESSONS_CTE} SELECT count(*) FILTER (WHERE captured_at < (SELECT max(captured_at) FROM lessons) - INTERVAL 30 DAY) AS expired FROM lessons")
def m5_retention_dry_run(spark, sf):
    rows = lessons(spark, sf)
    return M.retain_dry_run(rows, latest_ts(rows, "captured_at"), "captured_at", 30)


# --- proposals --------------------------------------------------------------------------------

PROPOSALS_CTE = """proposals AS (SELECT o_orderkey AS proposal_id, 'Fix ' || o_orderpriority AS title, 'customer ' || o_custkey AS description, 'mod' || (o_custkey % 50) || '.py' AS file_path,
  o_orderpriority AS category, o_orderstatus AS status, CASE WHEN o_totalprice > 300000 THEN 'high' ELSE 'low' END AS risk, o_orderdate AS created_at FROM orders)"""


def proposals(spark, sf):
    cust = F.col("o_custkey")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("proposal_id"), F.concat(F.lit("Fix "), "o_orderpriority").alias("title"),
        F.concat(F.lit("customer "), cust.cast("string")).alias("description"),
        F.concat(F.lit("mod"), (cust % 50).cast("string"), F.lit(".py")).alias("file_path"),
        F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_totalprice") > 300000, "high").otherwise("low").alias("risk"), F.col("o_orderdate").alias("created_at"),
    )


@query("p11_proposal_search", f"""WITH {PROPOSALS_CTE} SELECT proposal_id, title, file_path FROM proposals WHERE (title ILIKE '%mod1%' OR description ILIKE '%mod1%' OR file_path ILIKE '%mod1%')
  AND status = 'F' AND risk = 'high' ORDER BY created_at DESC, proposal_id DESC LIMIT 20 OFFSET 20""")
def p11_proposal_search(spark, sf):
    return M.search(proposals(spark, sf), "Mod1", 20, 20, status="F", risk="high").select("proposal_id", "title", "file_path")


@query("p11_pages_by_cursor", f"""WITH {PROPOSALS_CTE}, f AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, proposal_id DESC) AS rn FROM proposals WHERE (title ILIKE '%mod1%' OR description ILIKE '%mod1%' OR file_path ILIKE '%mod1%')
  AND status = 'F' AND risk = 'high') SELECT CAST(1 + (rn - 1) // 20 AS INTEGER) AS page, proposal_id, title, file_path FROM f WHERE rn <= 60""")
def p11_pages_by_cursor(spark, sf):
    paged = PagedTable(Store(spark, work_path(spark, "proposals")), "proposals", "created_at", "proposal_id")
    paged.write(proposals(spark, sf))
    pages, cursor = None, None
    for number in range(1, 4):
        rows, cursor = M.search_after(paged, "Mod1", 20, cursor, status="F", risk="high")
        page = rows.select(F.lit(number).alias("page"), "proposal_id", "title", "file_path")
        pages = page if pages is None else pages.unionByName(page)
        if cursor is None:
            break
    return pages


@query("a49_proposal_facets", f"""WITH {PROPOSALS_CTE} SELECT 'status' AS facet, status AS value, count(*) AS n FROM proposals GROUP BY ALL
  UNION ALL SELECT 'category', category, count(*) FROM proposals GROUP BY ALL UNION ALL SELECT 'total', 'all', count(*) FROM proposals""")
def a49_proposal_facets(spark, sf):
    return M.facets(proposals(spark, sf))


@query("a49_filtered_facets", f"""WITH {PROPOSALS_CTE}, f AS (SELECT * FROM proposals WHERE file_path ILIKE '%mod2%') SELECT 'status' AS facet, status AS value, count(*) AS n FROM f GROUP BY ALL
  UNION ALL SELECT 'category', category, count(*) FROM f GROUP BY ALL UNION ALL SELECT 'total', 'all', count(*) FROM f""")
def a49_filtered_facets(spark, sf):
    return M.facets(M.filtered(proposals(spark, sf), "mod2"))


# --- domain and principles --------------------------------------------------------------------

CHANGE_PATHS = [
    "api/routes.py", "db/models.py", "tests/test_auth.py", "config/settings.py", "core/memory.py", "web/logger.ts",
    "deploy/docker.yml", "lib/plain.py", "security/errors.go", "ci/run.sh",
]
CHANGES_CTE = f"changes AS (SELECT l_orderkey AS change_id, l_linenumber AS pos, ({sql_list(CHANGE_PATHS)})[1 + (l_partkey % 10)] AS path FROM lineitem)"


def changes(spark, sf):
    return spread(table(spark, sf, "lineitem"), "l_partkey").select(
        F.col("l_orderkey").alias("change_id"), F.col("l_linenumber").alias("pos"), _pick(CHANGE_PATHS, F.col("l_partkey") % 10).alias("path")
    )


@query("a43_inferred_domains", f"""WITH {CHANGES_CTE}, k AS ({sql_values([(i, w, d) for i, (w, d) in enumerate(R.DOMAINS)])}),
  v AS (SELECT change_id, k.col2 AS domain, count(*) AS n, min((pos, k.col0)) AS first FROM changes c JOIN k ON contains(lower(c.path), k.col1) GROUP BY ALL)
  SELECT c.change_id, coalesce(b.domain, 'general') AS domain FROM (SELECT DISTINCT change_id FROM changes) c LEFT JOIN
  (SELECT change_id, domain FROM v QUALIFY row_number() OVER (PARTITION BY change_id ORDER BY n DESC, first) = 1) b ON b.change_id = c.change_id""")
def a43_inferred_domains(spark, sf):
    return M.infer_domain(changes(spark, sf))


@query("a44_inferred_principles", f"""SELECT event_id, CASE WHEN p = '' THEN 'follow_style' ELSE p END AS principles FROM (SELECT event_id, concat_ws(',', """ + ", ".join(
    f"CASE WHEN {has_any('lower(msg)', w)} THEN {sq(n)} END" for w, n in R.PRINCIPLES) + """, CASE WHEN event_id % 2 = 0 AND event_id % 3 > 0 THEN 'run_checks' END) AS p
  FROM (SELECT event_id, (['Fix BUG in view', 'refactor and clean', 'feat: add page', 'remove old', 'upgrade version', 'optimize speed', 'CVE patch', 'tidy'])[1 + (event_id % 8)] || ' ' || event_type AS msg FROM events))""")
def a44_inferred_principles(spark, sf):
    e = F.col("event_id")
    msg = F.concat(_pick(["Fix BUG in view", "refactor and clean", "feat: add page", "remove old", "upgrade version", "optimize speed", "CVE patch", "tidy"], e % 8), F.lit(" "), "event_type")
    return table(spark, sf, "events").select(
        "event_id", F.concat_ws(",", M.infer_principles(msg, e % 2 == 0, e % 3 == 0)).alias("principles")
    )
