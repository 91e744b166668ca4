"""Queries for the line/file scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.operators import lines as L, scans as S
from lintlake.plans.corpus import code_files, doc_files, over_files, over_lines, table
from lintlake.plans.registry import query, sq, sql_in, sql_values
from lintlake.rules import code_rules as R


def has_any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {sq(w)})" for w in words) + ")"


def matches(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {sq(pattern)})"


def near(flag: str, lo: int, hi: int) -> str:
    """Whether ``flag`` holds on a line at offsets lo..hi of the same file."""
    def bound(k: int) -> str:
        return "CURRENT ROW" if k == 0 else f"{abs(k)} {'PRECEDING' if k < 0 else 'FOLLOWING'}"

    return (
        f"coalesce(bool_or({flag}) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN {bound(lo)} AND {bound(hi)}), false)"
    )


def joined(value: str, lo: int) -> str:
    """The lines at offsets lo..0 as one text."""
    return (
        f"string_agg({value}, chr(10)) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN {-lo} PRECEDING AND CURRENT ROW)"
    )


def first_of(column: str, labelled) -> str:
    return "CASE " + " ".join(f"WHEN {matches(column, p)} THEN {sq(v)}" for p, v in labelled) + " END"


def label_rows(source: str, labelled, column: str = "label") -> str:
    return " UNION ALL ".join(
        f"SELECT repo, path, line_no, {sq(v)} AS {column} FROM {source} WHERE {matches('line', p)}" for p, v in labelled
    )


NOT_SLASH = f"NOT {matches('line', L.SLASH_COMMENT)}"
NOT_CODE_COMMENT = f"NOT {matches('line', L.CODE_COMMENT)}"
PREVIEW = "substr(trim(line, ' '), 1, 80)"
MASKED = f"regexp_replace(line, {sq(L._QUOTED_OR_OPEN)}, '\"\"', 'g')"


# --- line building blocks ---------------------------------------------------------------------

@query("p1_line_explode", over_lines("SELECT repo, path, line_no, line FROM lines", docs=True))
def p1_line_explode(spark, sf):
    return L.to_lines(doc_files(spark, sf)).select("repo", "path", F.col("line_no").cast("long").alias("line_no"), "line")


@query("p7_comment_lines", over_lines(
    f"SELECT path, count(*) AS comment_lines FROM lines WHERE {matches('line', L.COMMENT)} GROUP BY path"))
def p7_comment_lines(spark, sf):
    found = L.line_hits(code_files(spark, sf), L.is_comment)
    return found.groupBy("path").agg(F.count("*").alias("comment_lines"))


@query("p8_in_string", over_lines(
    "SELECT path, line_no, quote <> '' AS inside FROM walk UNION ALL SELECT path, line_no, false AS inside FROM marks WHERE pos = 0",
    ctes="""marks AS (SELECT path, line_no, line, strpos(line, 'a') - 1 AS pos FROM lines WHERE contains(line, 'a')),
    walk AS (SELECT path, line_no, list_reduce(list_prepend('', string_split(substr(line, 1, pos), '')),
      lambda q, c: CASE WHEN q = '' AND c IN ('"', '''', '`') THEN c WHEN q = c THEN '' ELSE q END) AS quote FROM marks WHERE pos > 0)"""))
def p8_in_string(spark, sf):
    found = L.line_hits(code_files(spark, sf), lambda line: line.contains("a"))
    pos = F.instr("line", "a") - 1
    return found.select("path", "line_no", L.in_string(F.col("line"), pos).alias("inside"))


_FRAMES = [("exec_before", -5, 0), ("why_before", -10, 0), ("auth_after", 1, 10), ("around", -19, 5), ("strictly_before", -10, -1)]


@query("n1_context_flags", over_lines(
    "SELECT path, line_no, " + ", ".join(f"{n}" for n, _, _ in _FRAMES) + " FROM flagged WHERE hit",
    ctes="flagged AS (SELECT path, line_no, contains(line, '(') AS hit, "
    + ", ".join(f"{near(matches('line', 'return|token'), lo, hi)} AS {n}" for n, lo, hi in _FRAMES) + " FROM lines)"))
def n1_context_flags(spark, sf):
    found = L.line_hits(
        code_files(spark, sf), lambda line: line.contains("("), {n: (lo, hi) for n, lo, hi in _FRAMES}
    )
    return found.select(
        "path", "line_no", *[L.any_line(F.col(n), "return|token").alias(n) for n, _, _ in _FRAMES]
    )


# --- SQL --------------------------------------------------------------------------------------

@query("r1_sql_injection", over_lines(
    f"SELECT * FROM (SELECT repo, path, line_no, {first_of('ctx', R.INTERPOLATION)} AS kind FROM c WHERE hit) WHERE kind IS NOT NULL",
    ctes=f"c AS (SELECT repo, path, line_no, {matches('line', L.any_of(R.SQL_EXEC))} AS hit, {joined('line', -5)} AS ctx FROM lines)"))
def r1_sql_injection(spark, sf):
    return S.scan_sql_injection(code_files(spark, sf))


@query("r2_sql_injection_wide", over_lines(
    f"SELECT * FROM (SELECT repo, path, line_no, {first_of('ctx', R.INTERPOLATION)} AS kind FROM c WHERE hit) WHERE kind IS NOT NULL",
    ctes=f"c AS (SELECT repo, path, line_no, {matches('line', '(?i)' + L.any_of(R.SQL_EXEC_WIDE))} AS hit, "
    f"{joined(f'CASE WHEN {NOT_CODE_COMMENT} THEN line END', -5)} AS ctx FROM lines)"))
def r2_sql_injection_wide(spark, sf):
    return S.scan_sql_injection_v2(code_files(spark, sf))


@query("r3_orm_patterns", over_lines(
    label_rows("c", [("(?i)" + p, v) for p, v in R.ORM_DANGER]), ctes=f"c AS (SELECT * FROM lines WHERE {NOT_CODE_COMMENT})"))
def r3_orm_patterns(spark, sf):
    return S.scan_orm(code_files(spark, sf))


def _route_case() -> str:
    whens = [
        f"WHEN ext = {sq(ext)} AND contains(line, {sq(w)}) THEN {sq(fw)}"
        for ext, routes in (("py", R.ROUTES_PY), ("ts", R.ROUTES_TS), ("go", R.ROUTES_GO)) for w, fw in routes
    ]
    return "CASE " + " ".join(whens) + " END"


@query("r4_route_without_auth", over_lines(
    "SELECT repo, path, line_no, framework FROM c WHERE framework IS NOT NULL AND NOT auth AND NOT contains(lower(path), 'test')",
    ctes=f"c AS (SELECT repo, path, line_no, {_route_case()} AS framework, {near(has_any('line', R.AUTH_WORDS), 1, 10)} AS auth FROM lines)"))
def r4_route_without_auth(spark, sf):
    return S.scan_auth(code_files(spark, sf))


@query("r5_view_imports_orm", over_files(
    "SELECT repo, path FROM files WHERE ext = 'py' AND contains(content, 'django.db') AND contains(path, 'views.py')"))
def r5_view_imports_orm(spark, sf):
    return S.scan_view_orm(code_files(spark, sf))


@query("r6_hook_without_deps", over_files(
    "SELECT repo, path FROM files WHERE contains(content, 'useEffect(') AND NOT contains(content, 'eslint-disable') "
    "AND NOT contains(content, 'dependencies')"))
def r6_hook_without_deps(spark, sf):
    return S.scan_hook_deps(code_files(spark, sf))


@query("r7_async_without_try", over_lines(
    "SELECT d.repo, d.path, d.line_no FROM defs d LEFT JOIN stops s ON s.path = d.path "
    "WHERE d.n_lines >= d.line_no + 20 AND (d.next_def IS NULL OR d.next_def > d.line_no + 20) "
    "AND (s.stop IS NULL OR s.stop > d.line_no + 20)",
    ctes="""defs AS (SELECT repo, path, line_no, n_lines, lead(line_no) OVER (PARTITION BY path ORDER BY line_no) AS next_def
      FROM lines WHERE ext = 'py' AND contains(line, 'async def')),
    stops AS (SELECT t.path, min(t.line_no) AS stop FROM lines t JOIN defs d ON d.path = t.path AND d.line_no <= t.line_no
      AND t.line_no < d.line_no + 20 WHERE contains(t.line, 'try:') GROUP BY t.path)"""))
def r7_async_without_try(spark, sf):
    return S.scan_async_no_try(code_files(spark, sf))


# --- leaks ------------------------------------------------------------------------------------

_SECRET_LINES = (
    f"c AS (SELECT * FROM lines WHERE NOT {matches('line', L.COMMENT)} AND NOT {matches('line', R.PLACEHOLDER)})"
)
_SECRET_ROWS = " UNION ALL ".join(
    f"SELECT repo, path, line_no, {sq(n)} AS rule, {sq(lv)} AS level FROM c WHERE {matches('line', p)}" for n, p, lv in R.SECRETS
)


@query("r8_secrets", over_lines(_SECRET_ROWS, ctes=_SECRET_LINES))
def r8_secrets(spark, sf):
    return S.scan_secrets(code_files(spark, sf))


@query("r8_secrets_in_documents", over_lines(_SECRET_ROWS, docs=True, ctes=_SECRET_LINES))
def r8_secrets_in_documents(spark, sf):
    return S.scan_secrets(doc_files(spark, sf))


@query("r8_contacts_in_documents", over_lines(
    label_rows("lines", [(R.EMAIL, "email"), ('(?i)' + '|'.join(R.LICENSE_WORDS), "license")], "rule"), docs=True))
def r8_contacts_in_documents(spark, sf):
    return S.scan_contacts(doc_files(spark, sf))


@query("r9_api_keys", over_lines(
    f"SELECT repo, path, line_no, regexp_extract(line, {sq(R.API_KEY)}) AS key FROM lines WHERE {matches('line', R.API_KEY)}"))
def r9_api_keys(spark, sf):
    return S.scan_api_key(code_files(spark, sf))


@query("r10_sensitive_paths", over_lines(
    "SELECT * FROM (SELECT repo, path, line_no, CASE "
    + " ".join(f"WHEN {matches('line', p)} THEN regexp_extract(line, {sq(p)}, 1)" for p in R.sensitive_paths())
    + f" END AS hit, {PREVIEW} AS preview FROM lines WHERE {NOT_CODE_COMMENT}) WHERE hit IS NOT NULL"))
def r10_sensitive_paths(spark, sf):
    return S.scan_paths(code_files(spark, sf))


@query("r11_tool_traces", over_files(
    f"SELECT DISTINCT repo, string_split(path, '/')[1] AS entry, p.pattern FROM files, ({sql_values([(t,) for t in R.TOOL_TRACES])}) "
    "AS p(pattern) WHERE contains(string_split(path, '/')[1], p.pattern)"))
def r11_tool_traces(spark, sf):
    return S.scan_tool_traces(code_files(spark, sf))


# --- TypeScript -------------------------------------------------------------------------------

_ANY_ROWS = (
    f"SELECT repo, path, line_no, {PREVIEW} AS preview FROM lines WHERE ext = 'ts' AND {matches(MASKED, L.any_of(R.ANY_TYPE))} "
    f"AND NOT {matches('line', '^' + chr(92) + 's*(//|' + chr(92) + '* )')} AND NOT contains(line, '@ts-')"
)


@query("r12_any_types", over_lines(_ANY_ROWS))
def r12_any_types(spark, sf):
    return S.scan_any_type(code_files(spark, sf))


@query("r12_any_type_verdict", over_lines(
    "SELECT repo, count(*) AS total, count(DISTINCT path) AS affected_files, "
    "CASE WHEN count(*) > 20 THEN 'fail' WHEN count(*) > 5 THEN 'warn' ELSE 'info' END AS verdict FROM a GROUP BY repo",
    ctes=f"a AS ({_ANY_ROWS})"))
def r12_any_type_verdict(spark, sf):
    return S.usage_verdict(S.scan_any_type(code_files(spark, sf)), 20, 5)


_NON_NULL_ROWS = (
    f"SELECT repo, path, line_no, {PREVIEW} AS preview FROM lines WHERE ext = 'ts' AND {matches(MASKED, R.NON_NULL)} AND {NOT_SLASH}"
)


@query("r13_non_null_assertions", over_lines(_NON_NULL_ROWS))
def r13_non_null_assertions(spark, sf):
    return S.scan_non_null(code_files(spark, sf))


@query("r13_non_null_verdict", over_lines(
    "SELECT repo, count(*) AS total, count(DISTINCT path) AS affected_files, "
    "CASE WHEN count(*) > 10 THEN 'warn' ELSE 'info' END AS verdict FROM a GROUP BY repo", ctes=f"a AS ({_NON_NULL_ROWS})"))
def r13_non_null_verdict(spark, sf):
    return S.usage_verdict(S.scan_non_null(code_files(spark, sf)), None, 10)


@query("r14_catch_patterns", over_lines(
    label_rows("c", R.CATCH_DANGER), ctes=f"c AS (SELECT * FROM lines WHERE ext = 'ts' AND {NOT_SLASH})"))
def r14_catch_patterns(spark, sf):
    return S.scan_catch(code_files(spark, sf))


@query("r15_undocumented_dedup", over_lines(
    "SELECT repo, path, line_no FROM c WHERE hit AND NOT why AND ext = 'ts'",
    ctes=f"c AS (SELECT *, {matches('line', L.any_of(R.DEDUP_CODE))} AS hit, {near(has_any('lower(line)', R.WHY_WORDS), -10, 0)} AS why FROM lines)"))
def r15_undocumented_dedup(spark, sf):
    return S.scan_dedup_doc(code_files(spark, sf))


@query("r16_critical_identifiers", over_lines(
    " UNION ALL ".join(
        f"SELECT repo, path, line_no, {sq(n)} AS identifier, CAST((length(line) - length(replace(line, {sq(n)}, ''))) // {len(n)} AS BIGINT) AS uses "
        f"FROM (SELECT *, {near(has_any('lower(line)', words), -15, 0)} AS doc FROM lines) WHERE ext = 'ts' AND contains(line, {sq(n)}) AND NOT doc"
        for n, words in R.CRITICAL_IDENTIFIERS)))
def r16_critical_identifiers(spark, sf):
    return S.scan_critical_identifiers(code_files(spark, sf))


_FUNC_RE = rf"(const|function)\s+({'|'.join(R.CRITICAL_FUNCTIONS)})\s*[=(]"


@query("r17_critical_functions", over_lines(
    f"SELECT repo, path, line_no, regexp_extract(line, {sq(_FUNC_RE)}, 2) AS function FROM c WHERE ext = 'ts' AND NOT doc "
    f"AND {matches('line', _FUNC_RE)}",
    ctes=f"c AS (SELECT *, {near(has_any('lower(line)', R.TIMING_WORDS), -20, 0)} AS doc FROM lines)"))
def r17_critical_functions(spark, sf):
    return S.scan_critical_functions(code_files(spark, sf))


def _kinds(source: str, tests) -> str:
    return " UNION ALL ".join(f"SELECT repo, path, line_no, {sq(k)} AS kind FROM {source} WHERE {cond}" for cond, k in tests)


_PERF = _kinds("c", [
    (f"{matches('line', R.ARRAY_OP)} AND looped", "array_op_in_loop"),
    (matches("line", R.DEEP_COPY), "deep_copy_anti_pattern"),
    (matches("line", R.DOM_QUERY), "frequent_dom_query"),
])
_PERF_CTE = (
    f"c AS (SELECT * FROM (SELECT *, {near(matches('line', R.LOOP), -20, 0)} AS looped FROM lines) WHERE ext = 'ts' AND {NOT_SLASH})"
)


@query("r18_perf_patterns", over_lines(_PERF, ctes=_PERF_CTE))
def r18_perf_patterns(spark, sf):
    return S.scan_perf(code_files(spark, sf))


@query("r18_perf_counts", over_lines("SELECT kind, count(*) AS n FROM f GROUP BY kind", ctes=f"{_PERF_CTE}, f AS ({_PERF})"))
def r18_perf_counts(spark, sf):
    return S.scan_perf(code_files(spark, sf)).groupBy("kind").agg(F.count("*").alias("n"))


_THEN, _CATCH, _PROMISE = r"\.then\s*\(", r"\.catch\s*\(", r"new\s+Promise\s*\("


@query("r19_async_races", over_lines(
    _kinds("c", [
        ("(contains(line, 'await') OR contains(line, 'async')) AND looped", "async_loop_race"),
        (f"{matches('line', _PROMISE)} AND NOT contains(line, 'await')", "unhandled_promise"),
        (f"{matches('line', _THEN)} AND NOT caught AND NOT {matches('line', _CATCH)}", "unhandled_then"),
    ]),
    ctes=f"c AS (SELECT * FROM (SELECT *, {near(matches('line', R.LOOP_CALL), -10, -1)} AS looped, "
    f"{near(matches('line', _CATCH), 1, 5)} AS caught FROM lines) WHERE ext = 'ts' AND {NOT_SLASH})"))
def r19_async_races(spark, sf):
    return S.scan_async_race(code_files(spark, sf))


# --- Go ---------------------------------------------------------------------------------------

@query("r20_unlocked_map_writes", over_lines(
    "SELECT c.repo, c.path, c.line_no, d.map_name FROM c JOIN d ON d.path = c.path "
    r"WHERE NOT locked AND regexp_matches(c.line, d.map_name || '\s*\[.*\]\s*=')",
    ctes=f"c AS (SELECT * FROM (SELECT *, {near(matches('line', R.LOCK_WORDS), -19, 5)} AS locked FROM lines WHERE ext = 'go') WHERE {NOT_SLASH}), "
    f"d AS (SELECT DISTINCT path, regexp_extract(line, {sq(R.MAP_DECL)}, 1) AS map_name FROM c WHERE {matches('line', R.MAP_DECL)})"))
def r20_unlocked_map_writes(spark, sf):
    return S.scan_map_write(code_files(spark, sf))


@query("r21_go_errors", over_lines(
    "SELECT l.repo, l.path, l.line_no, 'panic_usage' AS kind FROM g l WHERE " + matches("line", r"\bpanic\s*\(") + " AND " + NOT_SLASH
    + " UNION ALL SELECT l.repo, l.path, l.line_no, 'unchecked_error' FROM g l WHERE " + matches("line", r"err\s+error\s*\)") + f" AND {NOT_SLASH}"
    + " AND NOT coalesce((SELECT arg_min(is_check, n.line_no) FROM g n WHERE n.path = l.path AND n.line_no BETWEEN l.line_no + 1 AND l.line_no + 50 "
    "AND (n.is_check OR n.is_func)), false)",
    ctes=r"g AS (SELECT *, contains(line, 'if err != nil') AS is_check, regexp_matches(line, '^func\s+\w+') AS is_func FROM lines WHERE ext = 'go')"))
def r21_go_errors(spark, sf):
    return S.scan_go_errors(code_files(spark, sf))


_GO_FUNC, _ENDLESS = r"go\s+func\s*\(", r"select\s*\{|for\s*\{"


@query("r22_goroutines", over_lines(
    _kinds("c", [
        (f"{matches('line', _GO_FUNC)} AND NOT has_ctx", "goroutine_without_context"),
        (f"{matches('line', _ENDLESS)} AND spawned AND NOT contains(line, 'default:')", "potential_goroutine_leak"),
    ]),
    ctes=f"c AS (SELECT * FROM (SELECT *, {near(has_any('line', ['context.Context', 'ctx ']), 1, 30)} AS has_ctx, "
    f"{near(matches('line', _GO_FUNC), -9, 0)} AS spawned FROM lines WHERE ext = 'go') WHERE {NOT_SLASH})"))
def r22_goroutines(spark, sf):
    return S.scan_goroutines(code_files(spark, sf))


# --- file-level rules -------------------------------------------------------------------------

def n_matches(column: str, pattern: str) -> str:
    return f"len(regexp_extract_all({column}, {sq(pattern)}))"


@query("r23_yagni", over_files(
    f"""SELECT repo, path, imports, todos, imports > lim AS too_many_imports, todos > 3 AS too_many_todos FROM (
    SELECT repo, path, CAST({n_matches('content', 'import ')} AS BIGINT) AS imports, CAST({n_matches('content', R.TODO_PY)} AS BIGINT) AS todos, 5 AS lim
      FROM files WHERE ext = 'py'
    UNION ALL SELECT repo, path, CAST(len(list_filter(string_split(content, chr(10)), lambda l: contains(l, 'import ') AND contains(l, 'from '))) AS BIGINT),
      CAST({n_matches('content', R.TODO_TS)} AS BIGINT), 10 FROM files WHERE ext = 'ts') WHERE imports > lim OR todos > 3"""))
def r23_yagni(spark, sf):
    return S.scan_yagni(code_files(spark, sf))


@query("r24_over_abstraction", over_lines(
    r"""SELECT repo, path, CAST(sum(n) AS BIGINT) AS definitions FROM (SELECT repo, path, ext,
      CASE WHEN ext = 'py' THEN CAST(regexp_matches(line, '^[ \t]*((async[ \t]+)?def|class)[ \t]') AS INT)
           ELSE len(regexp_extract_all(line, '\b(interface|type)\s+\w+')) END AS n FROM lines WHERE ext IN ('py', 'ts'))
      GROUP BY repo, path, ext HAVING sum(n) > CASE WHEN ext = 'py' THEN 20 ELSE 10 END"""))
def r24_over_abstraction(spark, sf):
    return S.scan_over_abstraction(code_files(spark, sf))


@query("r25_stdlib_alternatives", over_files(
    f"SELECT repo, path, package, alternative FROM files, ({sql_values(R.STDLIB_ALTERNATIVES)}) a(package, alternative) "
    "WHERE ext = 'py' AND (contains(content, 'import ' || package) OR contains(content, 'from ' || package))"))
def r25_stdlib_alternatives(spark, sf):
    return S.scan_stdlib(code_files(spark, sf))


@query("r26_ts_readability", over_lines(
    f"""SELECT repo, path, ternary_depth, any_count, first_any_line, ternary_depth > 2 AS ternary_warn,
      CASE WHEN any_count > 3 THEN 'warn' WHEN any_count > 0 THEN 'info' ELSE 'none' END AS any_level FROM (
      SELECT repo, path, CAST(CASE WHEN max({n_matches('line', R.NESTED_TERNARY)}) > 0 THEN max({n_matches('line', R.NESTED_TERNARY)}) + 1 ELSE 0 END AS BIGINT) AS ternary_depth,
      CAST(sum({n_matches('line', R.ANY_VOLUME)}) AS BIGINT) AS any_count,
      CAST(coalesce(min(line_no) FILTER (WHERE {matches('line', R.ANY_VOLUME)}), 0) AS BIGINT) AS first_any_line
      FROM lines WHERE ext = 'ts' GROUP BY repo, path) WHERE ternary_depth > 2 OR any_count > 0"""))
def r26_ts_readability(spark, sf):
    return S.scan_ts_readability(code_files(spark, sf))


_TOP = "string_split(path, '/')[1]"


@query("r27_directory_words", over_files(
    f"SELECT repo, path, top_dir, word FROM files JOIN ({sql_values([(d, w) for d, ws in R.DIR_FORBIDDEN.items() for w in ws])}) r(top_dir, word) "
    f"ON r.top_dir = {_TOP} AND contains(content, word)"))
def r27_directory_words(spark, sf):
    return S.scan_dir_responsibility(code_files(spark, sf))


@query("r28_directory_conflicts", over_files(
    "SELECT * FROM (SELECT repo, path, CASE "
    + " ".join(f"WHEN {_TOP} IN {sql_in(d)} AND {has_any('content', w)} THEN {sq(n)}" for d, w, n in (R.ROUTING_DIRS, R.SERVICE_DIRS))
    + " END AS conflict FROM files WHERE ext = 'py') WHERE conflict IS NOT NULL"))
def r28_directory_conflicts(spark, sf):
    return S.scan_dir_conflicts(code_files(spark, sf))


@query("r29_router_naming", over_files(
    "SELECT repo, path, name FROM (SELECT *, string_split(path, '/')[-1] AS name FROM files) "
    "WHERE contains(name, 'router.py') AND NOT ends_with(name, '_router.py')"))
def r29_router_naming(spark, sf):
    return S.scan_router_naming(code_files(spark, sf))


@query("r30_manual_json", over_lines(
    r"SELECT repo, path, line_no FROM lines WHERE (contains(line, 'json.loads') OR contains(line, 'request.json()')) "
    r"AND NOT regexp_matches(line, '^\s*(import |from |#)') AND repo IN (SELECT repo FROM files WHERE contains(content, 'fastapi'))"))
def r30_manual_json(spark, sf):
    files = code_files(spark, sf)
    frameworks = files.filter(F.col("content").contains("fastapi")).select("repo", F.lit("fastapi").alias("framework"))
    return S.scan_manual_json(files, frameworks)


_CAUGHT = "contains(content, 'try:') AND contains(content, 'except')"
_FORMS = has_any("content", ["forms.Form", "forms.ModelForm", "serializers."])
_404 = has_any("content", ["get_object_or_404", "get_list_or_404"])
_FEATURES = [
    ("fastapi", "base_model", f"{has_any('content', ['json.loads', 'request.json()'])} AND NOT {has_any('content', ['BaseModel', 'from pydantic import'])}",
     has_any("content", ["BaseModel", "from pydantic import"])),
    ("fastapi", "exception_handler", f"{_CAUGHT} AND NOT contains(content, '@app.exception_handler')", "contains(content, '@app.exception_handler')"),
    ("fastapi", "depends", f"{has_any('content', ['token', 'auth', 'login', 'current_user'])} AND NOT {has_any('content', ['Depends(', 'from fastapi import Depends'])}",
     has_any("content", ["Depends(", "from fastapi import Depends"])),
    ("fastapi", "api_router", f"{has_any('content', ['@app.', '@router.'])} AND NOT contains(content, 'APIRouter') AND {n_matches('content', '@app' + chr(92) + '.(get|post|put|delete)')} > 5",
     "contains(content, 'APIRouter')"),
    ("fastapi", "background_tasks", f"{has_any('content', ['time.sleep', 'asyncio.sleep', 'send_email', 'process_file'])} AND NOT contains(content, 'BackgroundTasks')",
     "contains(content, 'BackgroundTasks')"),
    ("django", "orm", f"{has_any('content', ['cursor()', 'raw('])} AND contains(content, '.objects.')", "contains(content, '.objects.')"),
    ("django", "forms", f"contains(content, 'is_valid()') AND NOT {_FORMS}", _FORMS),
    ("django", "get_object_or_404", f"{has_any('content', ['DoesNotExist', 'try:'])} AND NOT {_404}", _404),
    ("flask", "schema", f"contains(content, 'request.') AND {has_any('content', ['json', 'form'])} AND NOT {has_any('content', ['marshmallow', 'BaseModel'])}",
     has_any("content", ["marshmallow", "BaseModel"])),
    ("flask", "errorhandler", f"{_CAUGHT} AND NOT contains(content, '@app.errorhandler')", "contains(content, '@app.errorhandler')"),
]


@query("r31_framework_usage", over_files(" UNION ALL ".join(
    f"SELECT repo, path, {sq(fw)} AS framework, {sq(f)} AS feature, NOT ({by}) AS used FROM files WHERE ext = 'py' AND (({by}) OR ({use}))"
    for fw, f, by, use in _FEATURES)))
def r31_framework_usage(spark, sf):
    return S.framework_usage(code_files(spark, sf))


@query("r32_large_files", over_files(
    "SELECT repo, path, CAST(len(string_split(content, chr(10))) AS BIGINT) AS n_lines FROM files WHERE len(string_split(content, chr(10))) > 200"))
def r32_large_files(spark, sf):
    return S.scan_simplicity(code_files(spark, sf), 200)


@query("r32_large_documents", over_files(
    "SELECT repo, path, CAST(len(string_split(content, chr(10))) AS BIGINT) AS n_lines FROM files WHERE len(string_split(content, chr(10))) > 50", docs=True))
def r32_large_documents(spark, sf):
    return S.scan_simplicity(doc_files(spark, sf), 50)


@query("r33_keyword_complexity", over_lines(
    "SELECT repo, path, CAST(1 + sum(" + " + ".join(
        f"CAST(contains(' ' || regexp_replace(line, '^\\s+|\\s+$', '', 'g') || ' ', {sq(f' {w} ')}) AS INT)" for w in R.COMPLEXITY_WORDS)
    + ") AS BIGINT) AS complexity FROM lines WHERE ext = 'py' GROUP BY repo, path"))
def r33_keyword_complexity(spark, sf):
    return S.scan_keyword_complexity(code_files(spark, sf))


_NAME = "string_split(path, '/')[-1]"


@query("r34_runtime_evidence", over_files(
    f"SELECT repo, bool_or(ext = 'py' AND {has_any('content', R.HEALTH_PATHS)}) AS has_health, "
    + ", ".join(f"bool_or({_NAME} IN {sql_in(n)}) AS has_{g}" for g, n in R.INFRA_FILES.items()) + " FROM files GROUP BY repo"))
def r34_runtime_evidence(spark, sf):
    return S.runtime_evidence(code_files(spark, sf))


_REQUIRED = ["main.py", "router.py", "README.md", "views.ts"]


@query("r35_missing_key_files", over_files(
    f"SELECT r.repo, k.missing FROM (SELECT DISTINCT repo FROM files) r, ({sql_values([(n,) for n in _REQUIRED])}) k(missing) "
    f"WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.repo = r.repo AND string_split(f.path, '/')[-1] = k.missing)"))
def r35_missing_key_files(spark, sf):
    return S.missing_key_files(code_files(spark, sf), _REQUIRED)


_LOG = """log AS (SELECT CASE event_type WHEN 'error' THEN 'src/m' || user_id || '.ts:(' || (event_id % 97) || ',4):error TS' || (event_id % 7) || ': bad: call'
  WHEN 'click' THEN 'src/m' || user_id || '.ts: error free' WHEN 'view' THEN 'lib/m' || user_id || '.ts:12:error, no column' ELSE event_type || ' ok' END AS line FROM events)"""


@query("r36_compiler_log", f"""WITH {_LOG} SELECT trim(p[1], ' ') AS path,
  CASE WHEN regexp_matches(p[2], '\\(([0-9]+),?.*\\)') THEN CAST(regexp_extract(p[2], '\\(([0-9]+),?.*\\)', 1) AS BIGINT) ELSE -1 END AS line_no,
  trim(array_to_string(p[3:], ':'), ' ') AS message
  FROM (SELECT string_split(line, ':') AS p, line FROM log) WHERE contains(line, 'error') AND len(p) >= 3""")
def r36_compiler_log(spark, sf):
    user, event = F.col("user_id").cast("string"), F.col("event_id")
    line = (
        F.when(F.col("event_type") == "error", F.concat(
            F.lit("src/m"), user, F.lit(".ts:("), (event % 97).cast("string"), F.lit(",4):error TS"),
            (event % 7).cast("string"), F.lit(": bad: call")))
        .when(F.col("event_type") == "click", F.concat(F.lit("src/m"), user, F.lit(".ts: error free")))
        .when(F.col("event_type") == "view", F.concat(F.lit("lib/m"), user, F.lit(".ts:12:error, no column")))
        .otherwise(F.concat("event_type", F.lit(" ok")))
    )
    return S.parse_compiler_log(table(spark, sf, "events").select(line.alias("line")))


NODE_NAMES = ["isDuplicate", "debounceSave", "throttle", "handleStop", "pendingRequest", "setState", "isLoading", "render"]
NODES_CTE = """nodes AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'class' ELSE 'function' END AS kind,
  (['isDuplicate','debounceSave','throttle','handleStop','pendingRequest','setState','isLoading','render'])[1 + (doc_id % 8)] AS name,
  source || '/m' || (doc_id % 50) || CASE doc_id % 3 WHEN 0 THEN '.py' ELSE '.ts' END AS file_path, doc_id % 300 AS start_line,
  CASE doc_id % 3 WHEN 0 THEN 'python' ELSE 'typescript' END AS language, doc_id % 4 = 1 AS is_async,
  CASE WHEN doc_id % 7 = 0 THEN 'f(timestamp)' ELSE 'f(' || lang || ')' END AS signature,
  CASE WHEN doc_id % 11 < 3 THEN 'why: timing ' ELSE '' END || substr(text, 1, 40) AS docstring FROM documents)"""
GEDGES_CTE = """gedges AS (SELECT DISTINCT l_partkey % n AS source, l_suppkey * 7 % n AS target,
  CASE WHEN l_linenumber = 1 THEN 'contains' ELSE 'calls' END AS kind FROM lineitem, (SELECT count(*) AS n FROM documents))"""


def graph_nodes(spark, sf):
    doc = F.col("doc_id")
    py = doc % 3 == 0
    return table(spark, sf, "documents").select(
        doc.alias("id"),
        F.when(doc % 5 == 0, "class").otherwise("function").alias("kind"),
        F.element_at(F.array(*[F.lit(n) for n in NODE_NAMES]), (doc % 8 + 1).cast("int")).alias("name"),
        F.concat("source", F.lit("/m"), (doc % 50).cast("string"), F.when(py, ".py").otherwise(".ts")).alias("file_path"),
        (doc % 300).alias("start_line"),
        F.when(py, "python").otherwise("typescript").alias("language"),
        (doc % 4 == 1).alias("is_async"),
        F.when(doc % 7 == 0, "f(timestamp)").otherwise(F.concat(F.lit("f("), "lang", F.lit(")"))).alias("signature"),
        F.concat(F.when(doc % 11 < 3, "why: timing ").otherwise(""), F.substring("text", 1, 40)).alias("docstring"),
    )


def graph_edges(spark, sf):
    """Edges between node ids, made from order lines; node ids are the documents' 0..n-1."""
    n = table(spark, sf, "documents").count()
    return table(spark, sf, "lineitem").select(
        (F.col("l_partkey") % n).alias("source"),
        (F.col("l_suppkey") * 7 % n).alias("target"),
        F.when(F.col("l_linenumber") == 1, "contains").otherwise("calls").alias("kind"),
    ).distinct()


def _node_rule_sql() -> str:
    parts = []
    for w in R.NODE_DEDUP_WORDS:
        if w == "isDuplicate":
            parts.append((w, "fixed_window", f"NOT {has_any('signature', R.NODE_DYNAMIC_WORDS)}"))
        parts.append((w, "no_reason", f"NOT {has_any('lower(docstring)', R.NODE_WHY_WORDS)}"))
    parts += [(w, "no_timing", f"NOT {has_any('lower(docstring)', R.NODE_TIMING_WORDS)}") for w in R.NODE_RACE_WORDS]
    return " UNION ALL ".join(
        f"SELECT id, file_path, start_line, {sq(w)} AS keyword, {sq(k)} AS kind FROM nodes WHERE ends_with(file_path, '.ts') AND contains(name, {sq(w)}) AND {c}"
        for w, k, c in parts)


@query("r37_node_rules", f"WITH {NODES_CTE} {_node_rule_sql()}")
def r37_node_rules(spark, sf):
    return S.node_rules(graph_nodes(spark, sf))


@query("r37_async_setter_callers", f"""WITH {NODES_CTE}, {GEDGES_CTE} SELECT id, file_path, start_line FROM nodes WHERE is_async AND language = 'typescript'
  AND id IN (SELECT e.source FROM gedges e JOIN nodes t ON t.id = e.target WHERE e.kind = 'calls' AND t.name = 'setState')""")
def r37_async_setter_callers(spark, sf):
    return S.async_setter_callers(graph_nodes(spark, sf), graph_edges(spark, sf))
