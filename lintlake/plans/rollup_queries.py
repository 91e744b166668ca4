"""Rollup queries (U1, A1-A4, A28-A32, A34, A35, A41, A42, A53, N2-N6) and the flagship matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.operators import rollups as R, scans as S
from lintlake.plans import scan_queries as SQ
from lintlake.plans.corpus import DOC_FILES_CTE, FILES_CTE, LINES_CTE, code_files, doc_files, over_files, over_lines, table
from lintlake.plans.registry import ORACLES, query, sq, sql_in, sql_values
from lintlake.plans.scan_queries import has_any
from lintlake.plans.scoring_queries import _pick
from lintlake.rules import code_rules, gate_rules as G

LEVELS = R.LEVELS


# --- flagship: secrets and contacts of the documents, level by source ---------------------------

_DOC_FINDINGS = f"""f AS (SELECT repo, path, line_no, rule, level FROM ({SQ._SECRET_ROWS}) UNION ALL SELECT repo, path, line_no, rule, CASE rule WHEN 'email' THEN 'MEDIUM' ELSE 'INFO' END
  FROM ({SQ.label_rows('lines', [(code_rules.EMAIL, 'email'), ('(?i)' + '|'.join(code_rules.LICENSE_WORDS), 'license')], 'rule')}))"""
_MATRIX = "count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE level = {sq(v)}) AS {v.lower()}" for v in LEVELS)


@query("flagship_document_matrix", over_lines(f"SELECT repo, {_MATRIX} FROM f GROUP BY repo", docs=True, ctes=f"{SQ._SECRET_LINES}, {_DOC_FINDINGS}"))
def flagship_document_matrix(spark, sf):
    found = S.scan_secrets_and_contacts(doc_files(spark, sf))
    return R.file_level_matrix(found, "repo")


# --- findings of the derived corpus -------------------------------------------------------------

def _body(name: str) -> str:
    """The registered SQL of a scan as a subquery."""
    return f"({ORACLES[name]})"


_FINDINGS = f"""findings AS (SELECT repo, path, line_no, rule AS rule_id, 'fail' AS type, level, '' AS message FROM {_body('r8_secrets')}
  UNION ALL SELECT repo, path, line_no, 'SQL-001', 'fail', 'CRITICAL', kind FROM {_body('r1_sql_injection')}
  UNION ALL SELECT repo, path, line_no, 'AUTH-001', 'warn', 'MEDIUM', framework FROM {_body('r4_route_without_auth')}
  UNION ALL SELECT repo, path, line_no, 'CATCH-001', 'warn', 'LOW', '[TS-003] ' || label FROM {_body('r14_catch_patterns')}
  UNION ALL SELECT repo, path, 0, 'YAGNI-001', 'warn', 'LOW', '[YAGNI-001] imports or todos' FROM {_body('r23_yagni')}
  UNION ALL SELECT repo, path, 0, 'STDLIB-001', 'info', 'INFO', '[STDLIB-001] ' || package FROM {_body('r25_stdlib_alternatives')})"""


def findings(spark, sf):
    return R.quick_findings(code_files(spark, sf))


@query("u1_union_of_findings", f"WITH {_FINDINGS} SELECT * FROM findings")
def u1_union_of_findings(spark, sf):
    return findings(spark, sf)


@query("a1_run_counters", f"""WITH {_FINDINGS} SELECT count(*) AS total, count(*) FILTER (WHERE type = 'pass') AS passed, count(*) FILTER (WHERE type = 'fail') AS failed, count(*) FILTER (WHERE type = 'warn') AS warnings,
  count(*) FILTER (WHERE type = 'skip') AS skipped, count(*) FILTER (WHERE type = 'fail') = 0 AS success FROM findings""")
def a1_run_counters(spark, sf):
    return R.run_counters(findings(spark, sf))


@query("a2_findings_by_level", f"WITH {_FINDINGS} SELECT level, count(*) AS n FROM findings GROUP BY level")
def a2_findings_by_level(spark, sf):
    return R.by_level(findings(spark, sf))


@query("a3_file_level_matrix", f"WITH {_FINDINGS} SELECT path, {_MATRIX} FROM findings GROUP BY path")
def a3_file_level_matrix(spark, sf):
    return R.file_level_matrix(findings(spark, sf))


@query("a3_worst_files", f"WITH {_FINDINGS} SELECT path, {_MATRIX} FROM findings GROUP BY path ORDER BY total DESC, path LIMIT 10")
def a3_worst_files(spark, sf):
    return R.worst_files(R.file_level_matrix(findings(spark, sf)))


@query("a4_findings_of_level", f"WITH {_FINDINGS} SELECT level, row_number() OVER (PARTITION BY level ORDER BY repo, path, line_no, rule_id, message) AS rank, repo, path, line_no, rule_id, message FROM findings")
def a4_findings_of_level(spark, sf):
    return R.findings_of_level(findings(spark, sf)).drop("type")


@query("a41_technical_debt", f"""WITH {_FINDINGS} SELECT CASE WHEN contains(message, '[YAGNI-') THEN 'code_simplification' ELSE 'standard_library' END AS category, count(*) AS n, count(DISTINCT rule_id) AS rules
  FROM findings WHERE contains(message, '[YAGNI-') OR contains(message, '[STDLIB-') OR contains(message, '[TS-') GROUP BY 1""")
def a41_technical_debt(spark, sf):
    return R.technical_debt(findings(spark, sf))


# --- scores -----------------------------------------------------------------------------------

VIOLATIONS_CTE = """v AS (SELECT 'r' || l_partkey AS repo, 'op' || (l_suppkey % 9) AS operator, l_suppkey % 9 > 4 AS passed, (['INFO', 'WARNING', 'ERROR', 'CRITICAL', 'NONE'])[1 + (l_orderkey % 5)] AS severity FROM lineitem)"""


def violations(spark, sf):
    op = F.col("l_suppkey") % 9
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("r"), F.col("l_partkey").cast("string")).alias("repo"), F.concat(F.lit("op"), op.cast("string")).alias("operator"),
        (op > 4).alias("passed"), _pick(["INFO", "WARNING", "ERROR", "CRITICAL", "NONE"], F.col("l_orderkey") % 5).alias("severity"))


@query("a30_penalty_scores", f"WITH {VIOLATIONS_CTE} SELECT repo, CAST(least(greatest(100 - sum(CASE WHEN passed THEN 0 ELSE CASE severity WHEN 'CRITICAL' THEN 20 WHEN 'ERROR' THEN 10 WHEN 'WARNING' THEN 5 WHEN 'INFO' THEN 1 ELSE 0 END END), 0), 100) AS BIGINT) AS score FROM v GROUP BY repo")
def a30_penalty_scores(spark, sf):
    return R.penalty_score(violations(spark, sf))


RESULTS_CTE = """res AS (SELECT 'r' || l_partkey AS repo, 'rule' || l_linenumber || l_suppkey AS rule_id, 1 + l_linenumber % 8 AS step, l_suppkey % 3 > 0 AS auto, l_orderkey % 11 > 0 AS passed,
  (['CRITICAL', 'HIGH', 'RECOMMENDED', 'OTHER'])[1 + (l_suppkey % 4)] AS severity, CASE WHEN l_orderkey % 11 > 0 THEN 0 ELSE l_orderkey % 5 END AS violations FROM lineitem)"""


def acceptance_results(spark, sf):
    o, s = F.col("l_orderkey"), F.col("l_suppkey")
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("r"), F.col("l_partkey").cast("string")).alias("repo"),
        F.concat(F.lit("rule"), F.col("l_linenumber").cast("string"), s.cast("string")).alias("rule_id"),
        (F.col("l_linenumber") % 8 + 1).alias("step"), (s % 3 > 0).alias("auto"), (o % 11 > 0).alias("passed"),
        _pick(["CRITICAL", "HIGH", "RECOMMENDED", "OTHER"], s % 4).alias("severity"), F.when(o % 11 > 0, 0).otherwise(o % 5).alias("violations"))


_ACCEPT = "SELECT repo, CAST(greatest(100 - sum(CASE WHEN auto AND NOT passed THEN CASE severity WHEN 'CRITICAL' THEN 20 WHEN 'HIGH' THEN 10 WHEN 'RECOMMENDED' THEN 5 ELSE 10 END * least(violations + 1, 3) ELSE 0 END), 0) AS BIGINT) AS score FROM res GROUP BY repo"


@query("a31_acceptance_scores", f"WITH {RESULTS_CTE} {_ACCEPT}")
def a31_acceptance_scores(spark, sf):
    return R.acceptance_score(acceptance_results(spark, sf))


@query("a32_acceptance_steps", f"""WITH {RESULTS_CTE} SELECT repo, step, bool_and(passed OR NOT auto) AS all_ok, count(*) FILTER (WHERE auto) AS auto_rules, count(*) FILTER (WHERE NOT auto) AS manual_rules,
  CAST(sum(CASE WHEN severity = 'CRITICAL' THEN violations ELSE 0 END) AS BIGINT) AS critical_violations, CAST(sum(CASE WHEN severity = 'HIGH' THEN violations ELSE 0 END) AS BIGINT) AS high_violations,
  CAST(sum(CASE WHEN severity = 'RECOMMENDED' THEN violations ELSE 0 END) AS BIGINT) AS recommended_violations FROM res GROUP BY ALL""")
def a32_acceptance_steps(spark, sf):
    return R.acceptance_rollup(acceptance_results(spark, sf))


@query("a32_acceptance_gate", f"WITH {RESULTS_CTE}, a AS ({_ACCEPT}) SELECT *, score < 70 AS blocked FROM a")
def a32_acceptance_gate(spark, sf):
    return R.acceptance_gate(acceptance_results(spark, sf))


# --- profiles ---------------------------------------------------------------------------------

_LANGS = sql_values(list(G.LANGUAGES.items()))
_KNOWN = rf"""known AS (SELECT f.*, l.lang FROM files f JOIN ({_LANGS}) l(e, lang) ON l.e = f.ext WHERE NOT regexp_matches(path, '(^|/)\.') AND len(string_split(path, '/')) - 1 <= 4)"""


@query("a28_repo_profiles", f"WITH {FILES_CTE}, {_KNOWN} SELECT repo, count(*) AS files, CAST(sum(CASE WHEN lang IN {sql_in(G.COUNTED_LANGUAGES)} THEN len(string_split(content, chr(10))) ELSE 0 END) AS BIGINT) AS lines, CAST(sum(octet_length(encode(content))) AS BIGINT) AS bytes FROM known GROUP BY repo")
def a28_repo_profiles(spark, sf):
    return R.repo_profile(code_files(spark, sf))


@query("a28_top_languages", f"WITH {FILES_CTE}, {_KNOWN}, c AS (SELECT repo, lang, count(*) AS files FROM known GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY repo ORDER BY files DESC, lang) AS rank FROM c QUALIFY rank <= 8")
def a28_top_languages(spark, sf):
    return R.top_languages(code_files(spark, sf))


def _fw_sql(words, exts):
    case = "CASE " + " ".join(f"WHEN contains(lower(content), {sq(w)}) THEN {sq(w)} END" if i == len(words) - 1 else f"WHEN contains(lower(content), {sq(w)}) THEN {sq(w)}" for i, w in enumerate(words))
    return f"coalesce(arg_min({case}, path) FILTER (WHERE ext IN {sql_in(exts)} AND {case} IS NOT NULL), '')"


@query("a29_project_types", over_files(f"""SELECT repo, bool_or(ext = 'py') AS python, bool_or(ext IN ('ts', 'tsx')) AS typescript, bool_or(ext = 'go') AS go, bool_or(ext = 'rs') AS rust,
  {_fw_sql(G.PY_FRAMEWORKS, ['py'])} AS python_framework, {_fw_sql(G.TS_FRAMEWORKS, ['ts', 'tsx'])} AS typescript_framework FROM files GROUP BY repo"""))
def a29_project_types(spark, sf):
    out = R.project_types(code_files(spark, sf))
    return out.fillna("", ["python_framework", "typescript_framework"])


@query("a29_repo_frameworks", over_lines(r"SELECT DISTINCT repo, f.framework FROM lines, (VALUES ('fastapi'), ('flask'), ('django')) f(framework) WHERE ext = 'py' AND regexp_matches(line, '^\s*(import |from ).*(fastapi|django|flask)') AND contains(line, f.framework)"))
def a29_repo_frameworks(spark, sf):
    return R.repo_frameworks(code_files(spark, sf))


_RF = "rf AS (SELECT repo || '-' || (doc_id % 7) AS repo, path, ext, content FROM files)"


def split_repos(spark, sf):
    """Smaller repos, so that directory sets differ between them."""
    return code_files(spark, sf).withColumn("repo", F.concat("repo", F.lit("-"), (F.col("doc_id") % 7).cast("string")))


@query("a34_structure_health", f"""WITH {FILES_CTE}, {_RF}, t AS (SELECT *, string_split(path, '/')[1] AS top, lower(string_split(path, '/')[-1]) AS name FROM rf), g AS (SELECT repo, count(DISTINCT top) FILTER (WHERE NOT starts_with(top, '.')) AS n,
    count(DISTINCT top) FILTER (WHERE top IN {sql_in(G.UNCLEAR_DIRS)}) AS u, bool_or(top IN {sql_in(G.KNOWN_DIRS)}) AS known, bool_or(top IN ('tests', 'test')) AS tests, bool_or(top IN ('api', 'app')) AS api, bool_or(top = 'services') AS serv,
    bool_or(top IN ('repositories', 'repos')) AS rep, bool_or(top = 'api' AND ext = 'py' AND contains(name, 'router')) AS rt, bool_or(top = 'services' AND ext = 'py' AND contains(name, 'service')) AS sv FROM t GROUP BY repo),
  s AS (SELECT repo, CASE WHEN n >= 3 THEN 5.0::DOUBLE ELSE 0 END + CASE WHEN known THEN 5 ELSE 0 END + CASE WHEN u = 0 THEN 5 WHEN u <= 1 THEN 3 ELSE 0 END + CASE WHEN tests THEN 5 ELSE 0 END AS directories,
    CASE WHEN api OR serv OR rep THEN CASE WHEN api THEN 5.0::DOUBLE ELSE 0 END + CASE WHEN serv THEN 5 ELSE 0 END + CASE WHEN rep THEN 5 ELSE 0 END + CASE WHEN api AND rt THEN 2.5::DOUBLE ELSE 0 END + CASE WHEN serv AND sv THEN 2.5::DOUBLE ELSE 0 END ELSE 10 END AS layers FROM g)
  SELECT *, total >= 70 AS passed, CASE WHEN total >= 80 THEN 'excellent' WHEN total >= 70 THEN 'good' WHEN total >= 60 THEN 'fair' ELSE 'unhealthy' END AS band FROM (SELECT repo, directories, layers, 15.0::DOUBLE AS api_consistency, 10.0::DOUBLE AS framework, 15.0::DOUBLE AS naming, directories + layers + 40 AS total FROM s)""")
def a34_structure_health(spark, sf):
    return R.structure_health(split_repos(spark, sf))


_ROLES = f"""roles AS (SELECT repo, top AS top_dir, count(*) FILTER (WHERE len(string_split(path, '/')) = 2) AS files, coalesce(any_value(r.role), 'unclear') AS role FROM (SELECT *, string_split(path, '/')[1] AS top FROM rf) t
  LEFT JOIN ({sql_values(list(G.DIR_ROLES.items()))}) r(d, role) ON r.d = t.top WHERE NOT starts_with(top, '.') GROUP BY ALL)"""


@query("a35_directory_roles", f"WITH {FILES_CTE}, {_RF}, {_ROLES} SELECT * FROM roles")
def a35_directory_roles(spark, sf):
    return R.directory_roles(split_repos(spark, sf))


@query("a35_directory_clarity", f"WITH {FILES_CTE}, {_RF}, {_ROLES} SELECT *, clarity >= 0.6 AS passed FROM (SELECT repo, count(*) AS directories, CAST(count(*) FILTER (WHERE role <> 'unclear') AS DOUBLE) / count(*) AS clarity FROM roles GROUP BY repo)")
def a35_directory_clarity(spark, sf):
    return R.directory_clarity(split_repos(spark, sf))


# --- file metrics -----------------------------------------------------------------------------

@query("a42_comment_ratio", over_lines(r"""SELECT * FROM (SELECT repo, path, count(*) FILTER (WHERE regexp_matches(line, '^\s*#')) AS comments, count(*) FILTER (WHERE regexp_matches(line, '^\s*[^#\s]')) AS code FROM lines WHERE ext = 'py' GROUP BY ALL)
  WHERE code > 0 AND comments / code::DOUBLE > 0.3"""))
def a42_comment_ratio(spark, sf):
    return R.comment_ratio(code_files(spark, sf))


@query("n2_duplicate_blocks", over_lines(r"""SELECT repo, path, arg_min(line_no, line_no) AS line_no, arg_min(copies, line_no) AS copies FROM (SELECT repo, path, block, min(line_no) AS line_no, count(*) AS copies FROM b WHERE len = 5 AND code GROUP BY ALL HAVING count(*) >= 2) GROUP BY repo, path""",
    ctes=r"""b AS (SELECT repo, path, line_no, string_agg(line, chr(10)) OVER w AS block, count(*) OVER w AS len, bool_or(regexp_matches(line, '^\s*[^#\s]')) OVER w AS code FROM lines WHERE ext = 'py'
    WINDOW w AS (PARTITION BY path ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))"""))
def n2_duplicate_blocks(spark, sf):
    return R.duplicate_blocks(code_files(spark, sf))


@query("n3_comment_runs", over_lines(r"""SELECT repo, path, max(n) AS longest_run FROM (SELECT repo, path, line_no - k AS island, count(*) AS n FROM (SELECT repo, path, line_no, row_number() OVER (PARTITION BY path ORDER BY line_no) AS k FROM lines
  WHERE ext = 'py' AND regexp_matches(line, '^\s*#')) GROUP BY ALL) GROUP BY repo, path HAVING max(n) > 4"""))
def n3_comment_runs(spark, sf):
    return R.comment_runs(code_files(spark, sf), 4)


_FUNCTIONS = r"""l AS (SELECT *, regexp_matches(line, '^\s*(async )?def ') AS is_def, length(regexp_extract(line, '^(\s*)', 1)) AS ind, regexp_matches(line, '^\s*[^#\s]') AS code FROM lines WHERE ext = 'py'),
  d AS (SELECT *, lead(line_no) OVER (PARTITION BY path ORDER BY line_no) AS nxt FROM l WHERE is_def),
  fl AS (SELECT repo, path, line_no, regexp_extract(line, 'def\s+([^(]*)', 1) AS function, CAST(CASE WHEN nxt IS NULL THEN n_lines - line_no ELSE nxt - line_no - 1 END AS BIGINT) AS length FROM d
    WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.path = d.path AND l.line_no > d.line_no AND l.line_no < coalesce(d.nxt, d.n_lines + 1) AND l.code AND l.ind <= d.ind)),
  cls AS (SELECT *, lead(line_no) OVER (PARTITION BY path ORDER BY line_no) AS nxt FROM l WHERE regexp_matches(line, '^\s*class ')),
  cm AS (SELECT repo, path, line_no, regexp_extract(line, 'class ([^(:]*)', 1) AS class_name, (SELECT count(*) FROM d WHERE d.path = cls.path AND d.line_no > cls.line_no AND (cls.nxt IS NULL OR d.line_no < cls.nxt)) AS methods FROM cls)"""


@query("n4_function_lengths", over_lines("SELECT * FROM fl", ctes=_FUNCTIONS))
def n4_function_lengths(spark, sf):
    return R.function_lengths(code_files(spark, sf))


@query("n4_long_functions", over_lines("SELECT * FROM fl WHERE length > 10", ctes=_FUNCTIONS))
def n4_long_functions(spark, sf):
    return R.long_functions(code_files(spark, sf), 10)


@query("n5_large_classes", over_lines("SELECT * FROM cm WHERE methods > 5", ctes=_FUNCTIONS))
def n5_large_classes(spark, sf):
    return R.large_classes(code_files(spark, sf), 5)


@query("n6_brace_functions", over_files(rf"""SELECT repo, path, o.line_no, o.length FROM (SELECT repo, path, unnest(list_reduce(list_prepend({{'no': 0, 'opens': false, 'delta': 0, 'at': 0, 'depth': 0, 'done': []::STRUCT(line_no BIGINT, length BIGINT)[]}},
    list_transform(string_split(content, chr(10)), lambda t, i: {{'no': i, 'opens': regexp_matches(t, {sq(R._TS_FUNCTION)}), 'delta': len(regexp_extract_all(t, '\{{')) - len(regexp_extract_all(t, '\}}')), 'at': 0, 'depth': 0, 'done': []::STRUCT(line_no BIGINT, length BIGINT)[]}})),
    lambda a, s: CASE WHEN a.at = 0 AND NOT s.opens THEN {{'no': 0, 'opens': false, 'delta': 0, 'at': 0, 'depth': 0, 'done': a.done}}
      WHEN (CASE WHEN a.at = 0 THEN s.delta * 2 ELSE a.depth + s.delta END) <= 0 THEN {{'no': 0, 'opens': false, 'delta': 0, 'at': 0, 'depth': 0, 'done': CASE WHEN s.no - (CASE WHEN a.at = 0 THEN s.no ELSE a.at END) + 1 > 5
        THEN list_append(a.done, {{'line_no': CASE WHEN a.at = 0 THEN s.no ELSE a.at END, 'length': s.no - (CASE WHEN a.at = 0 THEN s.no ELSE a.at END) + 1}}::STRUCT(line_no BIGINT, length BIGINT)) ELSE a.done END}}
      ELSE {{'no': 0, 'opens': false, 'delta': 0, 'at': CASE WHEN a.at = 0 THEN s.no ELSE a.at END, 'depth': CASE WHEN a.at = 0 THEN s.delta * 2 ELSE a.depth + s.delta END, 'done': a.done}} END).done) AS o FROM files WHERE ext = 'ts')"""))
def n6_brace_functions(spark, sf):
    return R.brace_functions(code_files(spark, sf), 5)


@query("a53_file_metrics", over_lines(f"""SELECT b.repo, b.path, b.lines, b.functions, b.classes, b.complexity, coalesce(f.mx, 0) AS max_function_length, coalesce(f.mean, 0) AS mean_function_length, coalesce(c.mx, 0) AS max_methods FROM (
    SELECT repo, path, count(*) AS lines, count(*) FILTER (WHERE is_def) AS functions, count(*) FILTER (WHERE regexp_matches(line, '^\\s*class ')) AS classes, CAST(1 + sum("""
    + " + ".join(f"CAST(contains(' ' || regexp_replace(line, '^\\s+|\\s+$', '', 'g') || ' ', {sq(f' {w} ')}) AS INT)" for w in code_rules.COMPLEXITY_WORDS)
    + """) AS BIGINT) AS complexity FROM l GROUP BY ALL) b LEFT JOIN (SELECT path, max(length) AS mx, avg(length) AS mean FROM fl GROUP BY path) f ON f.path = b.path LEFT JOIN (SELECT path, max(methods) AS mx FROM cm GROUP BY path) c ON c.path = b.path""", ctes=_FUNCTIONS))
def a53_file_metrics(spark, sf):
    return R.file_metrics(code_files(spark, sf))
