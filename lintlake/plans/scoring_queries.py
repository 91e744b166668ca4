"""Scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.functions import scalars as fn
from lintlake.operators import scoring as S
from lintlake.plans.corpus import code_files, over_files, spread, table
from lintlake.plans.model import latest_ts
from lintlake.plans.registry import query, sq, sql_list, sql_values
from lintlake.plans.scan_queries import has_any
from lintlake.rules import scoring_rules as R

TYPES = [
    "syntax_error", "api_error", "race_condition", "doc_missing", "import_error", "module_class", "fire_and_forget",
    "caller_impact", "async_signature_change", "deleted_function", "dedup_issue",
]
PATHS = [
    "auth/login.py", "payment/checkout.py", "web/node_modules/x.js", "core/api/router.py", "lib/util.py",
    "user/profile.py", "venv/lib.py",
]
MESSAGES = [
    "TypeError in handler", "await lock pending", "ImportError: no module", "race condition seen", "unexpected indent",
    "slow query", "plain", "undefined name", "missing endpoint class",
]
REPORTS_CTE = f"""reports AS (SELECT event_id AS id, ({sql_list(TYPES)})[1 + (event_id % 11)] AS error_type, ({sql_list(PATHS)})[1 + (user_id % 7)] AS file_path,
  ({sql_list(MESSAGES)})[1 + (event_id // 11 % 9)] || ' ' || props AS message, ts, user_id FROM events)"""


def _pick(items, index):
    return F.element_at(F.array(*[F.lit(i) for i in items]), (index + 1).cast("int"))


def error_reports(spark, sf):
    event = F.col("event_id")
    return spread(table(spark, sf, "events"), "event_id").select(
        event.alias("id"), _pick(TYPES, event % 11).alias("error_type"), _pick(PATHS, F.col("user_id") % 7).alias("file_path"),
        F.concat(_pick(MESSAGES, F.floor(event / 11) % 9), F.lit(" "), "props").alias("message"), "ts", "user_id",
    )


def _said(words):
    return f"({has_any('error_type', words)} OR {has_any('lower(message)', words)})"


def _factor_sql(adaptive: bool) -> dict[str, str]:
    core, crit = (R.ADAPTIVE_CORE, R.ADAPTIVE_CRITICAL) if adaptive else (R.CORE_WORDS, R.CRITICAL_WORDS)
    race, third = (R.ADAPTIVE_RACE, R.ADAPTIVE_THIRD_PARTY) if adaptive else (R.RACE_WORDS, R.THIRD_PARTY)
    out = {
        "core_business": has_any("file_path", core),
        "auth_payment": f"({has_any('file_path', crit)} OR {_said(crit)})",
        "api_endpoint": _said(R.API_WORDS),
        "race_condition": _said(race),
        "syntax_error": "contains(error_type, 'syntax')",
        "missing_doc": "contains(error_type, 'missing')",
        "third_party": has_any("file_path", third),
    }
    if not adaptive:
        out |= {
            "async_signature_change": "contains(error_type, 'async_signature')",
            "fire_and_forget": "contains(error_type, 'fire_and_forget')",
            "function_deleted": "contains(error_type, 'deleted')",
            "high_caller_impact": "contains(error_type, 'caller_impact')",
        }
    return out


def _score_sql(adaptive: bool, extra: str = "0") -> str:
    terms = " + ".join(f"CASE WHEN {c} THEN {R.PAIN_WEIGHTS[n]} ELSE 0 END" for n, c in _factor_sql(adaptive).items())
    return f"CAST(least(greatest({terms} + {extra}, 0), 100) AS DOUBLE)"


_LEVEL = "CASE WHEN pain_score >= 75 THEN 'CRITICAL' WHEN pain_score >= 50 THEN 'HIGH' WHEN pain_score >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS pain_level"
_SCORED = f"scored AS (SELECT *, {_LEVEL} FROM (SELECT *, {_score_sql(False)} AS pain_score FROM reports))"


@query("f4_pain_score", f"WITH {REPORTS_CTE}, {_SCORED} SELECT id, pain_score, pain_level, concat_ws(',', "
       + ", ".join(f"CASE WHEN {c} THEN {sq(n)} END" for n, c in _factor_sql(False).items()) + ") AS factors FROM scored")
def f4_pain_score(spark, sf):
    return S.pain_score(error_reports(spark, sf)).select("id", "pain_score", "pain_level", F.concat_ws(",", "factors").alias("factors"))


_RATING = "CASE WHEN quality = 1 AND toxic = 0 THEN 'confirmed' WHEN quality = 0 AND toxic = 1 THEN 'false_positive' WHEN quality = 0 THEN 'low_priority' ELSE 'high_priority' END"
FEEDBACK_CTE = f"""feedback AS (SELECT l.doc_id AS id, ({sql_list(TYPES)})[1 + (l.doc_id % 11)] AS error_type, source || '/*' AS file_pattern,
  CASE WHEN l.doc_id % 11 = 4 THEN 'confirmed' WHEN l.doc_id % 11 IN (1, 7) THEN 'false_positive' ELSE {_RATING} END AS user_rating
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""


def feedback(spark, sf):
    q, t, doc = F.col("quality"), F.col("toxic"), F.col("doc_id")
    rating = (
        F.when(doc % 11 == 4, "confirmed").when((doc % 11).isin(1, 7), "false_positive")
        .when((q == 1) & (t == 0), "confirmed").when((q == 0) & (t == 1), "false_positive").when(q == 0, "low_priority")
        .otherwise("high_priority")
    )
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return table(spark, sf, "labels").join(docs, "doc_id").select(
        doc.alias("id"), _pick(TYPES, doc % 11).alias("error_type"), F.concat("source", F.lit("/*")).alias("file_pattern"),
        rating.alias("user_rating"),
    )


def _rates(keys: str) -> str:
    rates = ", ".join(f"CAST(count(*) FILTER (WHERE user_rating = {sq(r)}) AS DOUBLE) / count(*) AS {r}_rate" for r in R.RATINGS)
    return f"SELECT {keys}, count(*) AS n, {rates} FROM feedback GROUP BY {keys}"


@query("a13_feedback_rates", f"WITH {FEEDBACK_CTE} {_rates('error_type, file_pattern')}")
def a13_feedback_rates(spark, sf):
    return S.feedback_rates(feedback(spark, sf), "error_type", "file_pattern")


@query("a13_feedback_rates_by_glob", f"WITH {FEEDBACK_CTE}, g AS (SELECT * FROM feedback WHERE file_pattern GLOB '*[1-5]/[*]'), r AS ({_rates('error_type').replace('FROM feedback', 'FROM g')}) SELECT * FROM r")
def a13_feedback_rates_by_glob(spark, sf):
    rows = feedback(spark, sf)
    return S.feedback_rates(rows.filter(fn.glob_match(F.col("file_pattern"), F.lit("*[1-5]/[*]"))), "error_type")


_BASE_WEIGHTS = [("syntax_error", 15), ("race_condition", 25), ("import_error", 12)]
_CALIBRATED = f"""calibrated AS (SELECT r.error_type, CAST(floor(coalesce(w.weight, 20) * CASE WHEN false_positive_rate > 0.5 THEN 0.7::DOUBLE ELSE 1.3::DOUBLE END) AS BIGINT) AS weight
  FROM ({_rates('error_type')}) r LEFT JOIN ({sql_values(_BASE_WEIGHTS)}) w(error_type, weight) ON w.error_type = r.error_type
  WHERE n >= 3 AND (false_positive_rate > 0.5 OR confirmed_rate > 0.8))"""


@query("a14_calibrated_weights", f"WITH {FEEDBACK_CTE}, {_CALIBRATED} SELECT * FROM calibrated")
def a14_calibrated_weights(spark, sf):
    return S.calibrate(feedback(spark, sf), spark.createDataFrame(_BASE_WEIGHTS, "error_type string, weight int"))


@query("f5_adaptive_pain_score", f"WITH {FEEDBACK_CTE}, {_CALIBRATED}, {REPORTS_CTE} SELECT id, pain_score, {_LEVEL} FROM (SELECT r.id, {_score_sql(True, 'coalesce(c.weight, 0)').replace('error_type', 'r.error_type')} AS pain_score "
       "FROM reports r LEFT JOIN calibrated c ON c.error_type = r.error_type)")
def f5_adaptive_pain_score(spark, sf):
    calibrated = S.calibrate(feedback(spark, sf), spark.createDataFrame(_BASE_WEIGHTS, "error_type string, weight int"))
    return S.adaptive_pain_score(error_reports(spark, sf), calibrated).select("id", "pain_score", "pain_level")


@query("a24_total_pain", f"""WITH {REPORTS_CTE}, {_SCORED} SELECT count(*) AS error_count, sum(pain_score) / count(*) AS mean_score,
  CASE WHEN bool_or(pain_level = 'CRITICAL') THEN 'CRITICAL' WHEN bool_or(pain_level = 'HIGH') THEN 'HIGH' WHEN bool_or(pain_level = 'MEDIUM') THEN 'MEDIUM' ELSE 'LOW' END AS overall_level,
  CASE WHEN bool_or(pain_level = 'CRITICAL') THEN 'fix now' WHEN bool_or(pain_level = 'HIGH') THEN 'fix in this work cycle' WHEN bool_or(pain_level = 'MEDIUM') THEN 'plan for the next iteration' ELSE 'optional' END AS action FROM scored""")
def a24_total_pain(spark, sf):
    return S.total_pain(S.pain_score(error_reports(spark, sf)))


@query("a15_rule_false_positives", """SELECT rule_id, count(*) AS triggered, count(*) FILTER (WHERE outcome = 'fixed') AS fixed, count(*) FILTER (WHERE outcome = 'ignored') AS ignored,
  CAST(count(*) FILTER (WHERE outcome = 'ignored') AS DOUBLE) * 100.0 / count(*) AS false_positive_rate,
  CAST(count(*) FILTER (WHERE outcome = 'ignored') AS DOUBLE) * 100.0 / count(*) > 10 AS flagged
  FROM (SELECT 'R' || (l_suppkey % 40) AS rule_id, CASE WHEN l_discount * 100 < (l_suppkey % 40) / 8.0 THEN 'ignored' ELSE 'fixed' END AS outcome FROM lineitem) GROUP BY rule_id""")
def a15_rule_false_positives(spark, sf):
    k = F.col("l_suppkey") % 40
    outcomes = table(spark, sf, "lineitem").select(
        F.concat(F.lit("R"), k.cast("string")).alias("rule_id"),
        F.when(F.col("l_discount") * 100 < k / 8.0, "ignored").otherwise("fixed").alias("outcome"),
    )
    return S.rule_false_positives(outcomes)


DIMS = {"click": "refactor_success", "view": "performance_improvement", "purchase": "bug_fix_time", "error": "false_positive_rate", "signup": "dev_velocity"}
METRICS_CTE = ("metrics AS (SELECT event_id AS id, CASE event_type " + " ".join(f"WHEN {sq(k)} THEN {sq(v)}" for k, v in DIMS.items())
               + " END AS type, floor(value * 1024 / 500) / 1024 AS value, ts FROM events)")


def metrics(spark, sf):
    kind = F.create_map(*[F.lit(x) for kv in DIMS.items() for x in kv])
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), kind[F.col("event_type")].alias("type"),
        (F.floor(F.col("value") * 1024 / 500) / 1024.0).alias("value"), "ts",
    )


_SCORES = ("scores AS (SELECT " + ", ".join(f"coalesce(least(greatest(avg(value) FILTER (WHERE type = {sq(d)}), 0), 1), 0.5) AS {d}" for d in R.DIMENSION_WEIGHTS)
           + ", count(*) AS metrics_count FROM metrics WHERE ts >= (SELECT max(ts) FROM metrics) - INTERVAL 24 HOUR)")
_X1000 = "CAST(floor({} * 1000 + 0.5) AS BIGINT)"


def _thousandths(col: str):
    return F.floor(F.col(col) * 1000 + 0.5).cast("long").alias(f"{col}_x1000")


@query("a20_dimension_scores", f"WITH {METRICS_CTE}, {_SCORES} SELECT * FROM scores")
def a20_dimension_scores(spark, sf):
    m = metrics(spark, sf)
    return S.dimension_scores(m, latest_ts(m))


_TOTAL = " + ".join(f"{d} * {w}::DOUBLE" for d, w in R.DIMENSION_WEIGHTS.items())


@query("a21_empty_window", "SELECT 'insufficient_data' AS status, 0.0::DOUBLE AS score, count(*) AS metrics_count FROM events WHERE ts > (SELECT max(ts) FROM events) + INTERVAL 9 HOUR")
def a21_empty_window(spark, sf):
    m = metrics(spark, sf)
    return S.evolution_status(S.evolution_total(S.dimension_scores(m, latest_ts(m) + F.make_interval(hours=F.lit(10)), 1)))


@query("a21_evolution_total", f"WITH {METRICS_CTE}, {_SCORES} SELECT {_X1000.format('(' + _TOTAL + ')')} AS total_score_x1000 FROM scores")
def a21_evolution_total(spark, sf):
    m = metrics(spark, sf)
    return S.evolution_total(S.dimension_scores(m, latest_ts(m))).select(_thousandths("total_score"))


_FATIGUE = """f AS (SELECT *, CASE WHEN r >= 0.5 THEN 'critical' WHEN r >= 0.3 THEN 'warning' WHEN r <= 0.15 THEN 'encourage' ELSE 'normal' END AS status FROM (
  SELECT *, (CASE WHEN false_positive_rate > 0.5 THEN 1 ELSE 0 END / 5.0::DOUBLE + false_positive_rate * 0.15::DOUBLE / 1.0::DOUBLE) / 2 AS r FROM scores))"""


@query("a22_fatigue", f"WITH {METRICS_CTE}, {_SCORES}, {_FATIGUE} SELECT {_X1000.format('r')} AS negative_ratio_x1000, status FROM f")
def a22_fatigue(spark, sf):
    m = metrics(spark, sf)
    return S.fatigue(S.dimension_scores(m, latest_ts(m))).select(_thousandths("negative_ratio"), "status")


@query("a23_recommendations", f"""WITH {METRICS_CTE}, {_SCORES}, {_FATIGUE} SELECT a.action, a.priority FROM f, (VALUES ('critical', 'reduce_pain_threshold', 'high'),
  ('critical', 'increase_false_positive_tolerance', 'high'), ('warning', 'adjust_pain_weights', 'medium'), ('encourage', 'enable_innovation_mode', 'low'),
  ('fp', 'review_false_positives', 'medium'), ('slow', 'optimize_check_speed', 'medium')) a(cond, action, priority)
  WHERE a.cond = f.status OR (a.cond = 'fp' AND f.false_positive_rate > 0.5) OR (a.cond = 'slow' AND f.dev_velocity < 0.3)""")
def a23_recommendations(spark, sf):
    m = metrics(spark, sf)
    return S.recommendations(S.fatigue(S.dimension_scores(m, latest_ts(m))))


_RAW_EVENTS = """raw AS (SELECT event_id, (['refactor_success', 'performance_improvement', 'bug_fix_time', 'false_positive_rate'])[1 + (event_id % 4)] AS kind,
  event_id // 4 % 2 = 0 AS tests_passed, user_id % 100 AS pain_before, user_id * 7 % 100 AS pain_after, CAST(round(value * 100) AS BIGINT) AS before,
  event_id * 37 % 50000 AS after, event_id * 997 % 100000 AS fix_seconds, user_id % 100 AS pain FROM events)"""


@query("m7_metric_values", f"""WITH {_RAW_EVENTS} SELECT event_id, kind, CASE kind
  WHEN 'refactor_success' THEN CASE WHEN tests_passed THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN pain_before > 0 THEN least(greatest((pain_before - pain_after) / pain_before::DOUBLE * 0.5::DOUBLE, 0.0::DOUBLE), 0.5::DOUBLE) ELSE 0.0::DOUBLE END
  WHEN 'performance_improvement' THEN CASE WHEN before <= 0 THEN 0.0::DOUBLE ELSE least(greatest((before - after) / before::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) END
  WHEN 'bug_fix_time' THEN least(CASE WHEN fix_seconds <= 3600 THEN 1.0::DOUBLE WHEN fix_seconds >= 86400 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - (fix_seconds - 3600) / 82800.0::DOUBLE END * (1.0::DOUBLE + pain / 100.0::DOUBLE), 1.0::DOUBLE)
  ELSE 1.0::DOUBLE END AS value FROM raw""")
def m7_metric_values(spark, sf):
    e, u = F.col("event_id"), F.col("user_id")
    raw = table(spark, sf, "events").select(
        "event_id", _pick(["refactor_success", "performance_improvement", "bug_fix_time", "false_positive_rate"], e % 4).alias("kind"),
        (F.floor(e / 4) % 2 == 0).alias("tests_passed"), (u % 100).alias("pain_before"), (u * 7 % 100).alias("pain_after"),
        F.round(F.col("value") * 100).cast("long").alias("before"), (e * 37 % 50000).alias("after"),
        (e * 997 % 100000).alias("fix_seconds"), (u % 100).alias("pain"),
    )
    return raw.select("event_id", "kind", S.metric_value(F.col("kind")).alias("value"))


@query("m8_newest_metrics", f"WITH {METRICS_CTE} SELECT id, type, value FROM metrics ORDER BY ts DESC, id DESC LIMIT 1000")
def m8_newest_metrics(spark, sf):
    return S.newest_metrics(metrics(spark, sf)).select("id", "type", "value")


@query("j25_core_areas", over_files(" UNION ALL ".join(
    f"SELECT repo, path, {sq(a)} AS area, {sq(lv)} AS sensitivity, CAST({m} AS DOUBLE) AS pain_multiplier FROM files WHERE {has_any('lower(path)', w)}" for a, w, lv, m in R.CORE_AREAS)))
def j25_core_areas(spark, sf):
    return S.core_areas(code_files(spark, sf))


_FIX = ("fixes AS (SELECT id, s.kind AS strategy, s.fixable AS auto_fixable FROM (SELECT id, CASE "
        + " ".join(f"WHEN error_type = {sq(k)} OR {has_any('lower(message)', p)} THEN {i}" for i, (k, p, _, _) in enumerate(R.FIX_STRATEGIES))
        + f" END AS i FROM reports) r JOIN ({sql_values([(i, k, x) for i, (k, _, x, _) in enumerate(R.FIX_STRATEGIES)])}) s(i, kind, fixable) ON s.i = r.i)")


@query("j26_fix_strategies", f"WITH {REPORTS_CTE}, {_FIX} SELECT * FROM fixes")
def j26_fix_strategies(spark, sf):
    return S.suggest_fix(error_reports(spark, sf)).select("id", "strategy", "auto_fixable")


@query("a54_fix_statistics", f"WITH {REPORTS_CTE}, {_FIX} SELECT count(*) AS processed, count(*) FILTER (WHERE auto_fixable) AS auto_fixable, count(*) FILTER (WHERE NOT auto_fixable) AS suggested FROM fixes")
def a54_fix_statistics(spark, sf):
    return S.fix_statistics(S.suggest_fix(error_reports(spark, sf)))


@query("f6_impact_texts", f"WITH {REPORTS_CTE} SELECT id, coalesce(CASE "
       + " ".join(f"WHEN {has_any('error_type', t)} OR {has_any('lower(message)', w)} THEN {sq(i)}" for t, w, i in R.IMPACTS) + " END, '') AS impact FROM reports")
def f6_impact_texts(spark, sf):
    return error_reports(spark, sf).select("id", F.coalesce(S.impact_text(F.col("error_type"), F.col("message")), F.lit("")).alias("impact"))


# --- insights and rules -----------------------------------------------------------------------

PATTERNS = ["*_error", "race*", "*", "doc_m?ssing", "[ad]*", ""]
MODULES = ["auth", "api", "lib", "", "payment"]
INSIGHTS_CTE = f"""insights AS (SELECT p_partkey AS id, (['repeated_bug', 'architectural_weakness', 'evolution_suggestion', 'note'])[1 + (p_size % 4)] AS type,
  ({sql_list(MODULES)})[1 + (p_partkey % 5)] AS module, ({sql_list(PATTERNS)})[1 + (p_partkey % 6)] AS pattern, (p_size % 8) / 8.0::DOUBLE AS confidence, p_size AS evidence_count,
  p_partkey * 7 % 10007 AS generated_at, p_partkey % 3 = 0 AS applied FROM part)"""
RULES_CTE = """rules AS (SELECT 'rule_' || id AS id, CASE type WHEN 'repeated_bug' THEN 'pain_weight' WHEN 'architectural_weakness' THEN 'check_priority' WHEN 'evolution_suggestion' THEN 'new_check' END AS type,
  module, pattern, confidence, id AS source_insight_id FROM (SELECT * FROM insights WHERE NOT applied ORDER BY generated_at DESC, id DESC LIMIT 50) WHERE type <> 'note')"""


def insights(spark, sf):
    key, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf, "part").select(
        key.alias("id"), _pick(["repeated_bug", "architectural_weakness", "evolution_suggestion", "note"], size % 4).alias("type"),
        _pick(MODULES, key % 5).alias("module"), _pick(PATTERNS, key % 6).alias("pattern"), (size % 8 / 8.0).alias("confidence"),
        size.alias("evidence_count"), (key * 7 % 10007).alias("generated_at"), (key % 3 == 0).alias("applied"),
    )


@query("m6_evolved_rules", f"WITH {INSIGHTS_CTE}, {RULES_CTE} SELECT * FROM rules")
def m6_evolved_rules(spark, sf):
    return S.evolve(insights(spark, sf))


@query("m6_insights_marked_applied", f"WITH {INSIGHTS_CTE}, {RULES_CTE} SELECT id, applied OR id IN (SELECT source_insight_id FROM rules) AS applied FROM insights")
def m6_insights_marked_applied(spark, sf):
    rows = insights(spark, sf)
    return S.mark_applied(rows, S.evolve(rows)).select("id", "applied")


@query("a50_rule_set_summary", f"WITH {INSIGHTS_CTE}, {RULES_CTE} SELECT type, count(*) AS rules, count(DISTINCT module) AS modules FROM rules GROUP BY type")
def a50_rule_set_summary(spark, sf):
    return S.rule_set_summary(S.evolve(insights(spark, sf)))


@query("j24_rescored_errors", f"""WITH {INSIGHTS_CTE}, {RULES_CTE}, {REPORTS_CTE}, {_SCORED}, e AS (SELECT *, string_split(file_path, '/')[-2] AS module FROM scored),
  m AS (SELECT k.module, k.error_type, product(1.0::DOUBLE + r.confidence * CASE r.type WHEN 'pain_weight' THEN 0.5::DOUBLE WHEN 'check_priority' THEN 0.3::DOUBLE ELSE 0 END) AS f
    FROM (SELECT DISTINCT module, error_type FROM e) k JOIN rules r ON (r.module = '' OR r.module = k.module) AND (r.pattern = '' OR k.error_type GLOB r.pattern) GROUP BY ALL)
  SELECT e.id, CAST(floor(least(greatest(pain_score * coalesce(m.f, 1), 0), 100) * 10000 + 0.5) AS BIGINT) AS rescored_x10000
  FROM e LEFT JOIN m ON m.module = e.module AND m.error_type = e.error_type""")
def j24_rescored_errors(spark, sf):
    scored = S.pain_score(error_reports(spark, sf)).select("id", "error_type", "file_path", "pain_score")
    return S.rescore(scored, S.evolve(insights(spark, sf))).select(
        "id", F.floor(F.col("rescored") * 10000 + 0.5).cast("long").alias("rescored_x10000")
    )
