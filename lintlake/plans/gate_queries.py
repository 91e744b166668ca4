"""Gate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.functions import scalars as fn
from lintlake.operators import gates as G, scans as S
from lintlake.plans.corpus import FILES_CTE, code_files, over_files, over_lines, table
from lintlake.plans.registry import query, sq, sql_in, sql_list, sql_values
from lintlake.plans.scan_queries import has_any
from lintlake.plans.scoring_queries import _pick
from lintlake.rules import code_rules, gate_rules as R

_IGNORES = ["core/m1", "views", "utils/.*/main", "[bad"]
_NAME = "string_split(path, '/')[-1]"


@query("p2_ignored_files", over_files(
    f"SELECT repo, path, ({has_any('path', _IGNORES)} OR " + " OR ".join(f"regexp_matches(path, {sq('^(?:' + p + ')')})" for p in _IGNORES[:-1])
    + f" OR {has_any('path', code_rules.IGNORED_PARTS)} OR contains(lower({_NAME}), 'test') OR list_contains(string_split(path, '/'), 'tests')) AS ignored FROM files"))
def p2_ignored_files(spark, sf):
    return code_files(spark, sf).select("repo", "path", G.should_ignore(F.col("path"), _IGNORES).alias("ignored"))


@query("p3_ignore_patterns", r"""SELECT regexp_replace(line, '^\s+|\s+$', '', 'g') AS pattern FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)
  WHERE regexp_replace(line, '^\s+|\s+$', '', 'g') <> '' AND NOT regexp_matches(line, '^\s*#')""")
def p3_ignore_patterns(spark, sf):
    lines = table(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return G.ignore_patterns(lines)


@query("p4_glob_matches", over_files(" UNION ALL ".join(
    f"SELECT path, {sq(g)} AS pattern, regexp_matches(path, {sq(rx)}) AS hit FROM files" for g, rx in [
        ("*/m1*/[vr]*.py", r"^.*/m1.*/[vr].*\.py$"), ("core/*", r"^core/.*$"), ("*/m?/*", r"^.*/m./.*$"), ("[!a]*.go", r"^[^a].*\.go$")])))
def p4_glob_matches(spark, sf):
    globs = F.array(*[F.lit(g) for g in ("*/m1*/[vr]*.py", "core/*", "*/m?/*", "[!a]*.go")])
    rows = code_files(spark, sf).select("path", F.explode(globs).alias("pattern"))
    return rows.withColumn("hit", fn.glob_match(F.col("path"), F.col("pattern")))


def _core_case(column: str) -> str:
    parts = []
    for name, patterns, _ in code_rules.CORE_FILES:
        for p in patterns:
            cond = f"regexp_matches({column}, {sq('(?i)' + p.replace('*', '.*'))})" if "*" in p else f"lower({column}) = {sq(p.lower())}"
            parts.append(f"WHEN {cond} THEN {sq(name)}")
    return "CASE " + " ".join(parts) + " END"


@query("p5_core_files", over_files(
    f"SELECT * FROM (SELECT repo, path, coalesce({_core_case('path')}, {_core_case(_NAME)}) AS rule FROM files) WHERE rule IS NOT NULL"))
def p5_core_files(spark, sf):
    rule = F.coalesce(G.core_file_match(F.col("path")).getField("name"), G.core_file_match(S.file_name(F.col("path"))).getField("name"))
    return code_files(spark, sf).select("repo", "path", rule.alias("rule")).filter("rule IS NOT NULL")


def changed_lists(spark, sf):
    docs = code_files(spark, sf).select("repo", "path", "doc_id")
    return docs.filter("doc_id % 4 = 0"), docs.filter("doc_id % 6 = 0")


@query("p6_changed_files_only", over_files("SELECT repo, path, length(content) AS n_chars FROM files WHERE doc_id % 4 = 0 OR doc_id % 6 = 0"))
def p6_changed_files_only(spark, sf):
    files = code_files(spark, sf)
    return G.only_changed(files, G.changed_union(*changed_lists(spark, sf))).select("repo", "path", F.length("content").cast("long").alias("n_chars"))


@query("u3_changed_union", over_files("SELECT repo, path FROM files WHERE doc_id % 4 = 0 UNION SELECT repo, path FROM files WHERE doc_id % 6 = 0"))
def u3_changed_union(spark, sf):
    return G.changed_union(*changed_lists(spark, sf))


@query("p9_size_cut", over_files("SELECT repo, path, octet_length(encode(content)) AS size FROM files WHERE octet_length(encode(content)) <= 2000"))
def p9_size_cut(spark, sf):
    sized = code_files(spark, sf).withColumn("size", F.octet_length("content").cast("long"))
    return G.max_size(sized, 2000).select("repo", "path", "size")


@query("p9_skipped_files", over_files("SELECT repo, path, 'file-size' AS rule, 'skip' AS level FROM files WHERE octet_length(encode(content)) > 2000"))
def p9_skipped_files(spark, sf):
    return G.skipped_files(code_files(spark, sf).withColumn("size", F.octet_length("content").cast("long")), 2000)


_SECRET_FINDINGS = " UNION ALL ".join(
    f"SELECT repo, path, {sq(lv)} AS level FROM c WHERE regexp_matches(line, {sq(p)})" for _, p, lv in code_rules.SECRETS)


@query("p10_gate", over_lines(f"SELECT repo, path, bool_or(level IN ('CRITICAL', 'ERROR')) AS blocked, count(*) AS findings FROM ({_SECRET_FINDINGS}) GROUP BY ALL",
       ctes=rf"c AS (SELECT * FROM lines WHERE NOT regexp_matches(line, '^\s*(#|//|/\*|\* )') AND NOT regexp_matches(line, {sq(code_rules.PLACEHOLDER)}))"))
def p10_gate(spark, sf):
    return G.gate(S.scan_secrets(code_files(spark, sf)))


@query("j28_core_file_changes", over_files(f"SELECT repo, path, rule, 'critical' AS severity FROM (SELECT repo, path, {_core_case('path')} AS rule FROM files WHERE doc_id % 4 = 0) WHERE rule IS NOT NULL"))
def j28_core_file_changes(spark, sf):
    return G.core_file_changes(changed_lists(spark, sf)[0])


@query("j28_core_change_verdict", over_files(f"SELECT repo, count(*) AS checked, count(rule) AS core_changes, CASE WHEN count(rule) > 0 THEN 'fail' ELSE 'pass' END AS verdict FROM (SELECT repo, {_core_case('path')} AS rule FROM files WHERE doc_id % 4 = 0) GROUP BY repo"))
def j28_core_change_verdict(spark, sf):
    return G.core_change_verdict(changed_lists(spark, sf)[0])


# --- suppressions -----------------------------------------------------------------------------

_MARK = "# lint-ignore:"
_SUPPRESSED = f"""WITH {FILES_CTE}, raw AS (SELECT doc_id, repo, path, string_split(content, chr(10)) AS l FROM files),
  lines AS (SELECT doc_id, repo, path, unnest(l) AS line0, unnest(range(1, len(l) + 1)) AS line_no FROM raw),
  marked AS (SELECT *, CASE WHEN (line_no + doc_id) % 23 = 0 THEN '{_MARK} todo' WHEN (line_no + doc_id) % 29 = 0 THEN '{_MARK} paren' END AS mark FROM lines),
  f AS (SELECT repo, path, line_no, 'todo' AS rule_id FROM lines WHERE contains(line0, 'TODO') UNION ALL SELECT repo, path, line_no, 'paren' FROM lines WHERE contains(line0, '()'))
  SELECT * FROM f WHERE NOT (rule_id = 'paren' AND starts_with(path, 'api/'))
  AND NOT EXISTS (SELECT 1 FROM marked m WHERE m.path = f.path AND m.mark = '{_MARK} ' || f.rule_id AND (m.line_no BETWEEN f.line_no - 4 AND f.line_no + 5 OR m.line_no <= 10))"""


@query("j27_suppressed_findings", _SUPPRESSED)
def j27_suppressed_findings(spark, sf):
    files = code_files(spark, sf)
    doc = F.col("doc_id")

    def mark(line, i):
        at = (i + 1 + doc) % 23 == 0
        other = (i + 1 + doc) % 29 == 0
        return F.when(at, F.concat(line, F.lit(f" {_MARK} todo"))).when(other, F.concat(line, F.lit(f" {_MARK} paren"))).otherwise(line)

    marked = files.withColumn("content", F.array_join(F.transform(F.split("content", "\n"), mark), "\n"))
    todo = S.L.line_hits(files, lambda line: line.contains("TODO")).withColumn("rule_id", F.lit("todo"))
    paren = S.L.line_hits(files, lambda line: line.contains("()")).withColumn("rule_id", F.lit("paren"))
    findings = todo.unionByName(paren).select("repo", "path", F.col("line_no").cast("long").alias("line_no"), "rule_id")
    return G.apply_suppressions(findings, marked, _MARK, {"paren": ["api/*"]})


# --- dependencies -----------------------------------------------------------------------------

PACKAGES = ["requests", "Django", "flask", "pillow", "numpy", "axios", "lodash", "pyyaml"]
_VERSION = "(p_size % 9) || '.' || (p_partkey % 30) || '.' || (p_partkey % 4)"


def manifests(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size")
    version = F.concat_ws(".", (size % 9).cast("string"), (k % 30).cast("string"), (k % 4).cast("string"))
    pkg, other = _pick(PACKAGES, k % 8), _pick(PACKAGES, (k + 3) % 8)
    req = F.concat(F.lit("# deps\n-r base.txt\n  "), pkg, F.lit("=="), version, F.lit("\nplain\n"), other, F.lit(">=1.0"))
    js = F.concat(F.lit('{"name":"x","dependencies":{"'), pkg, F.lit('":"^'), version, F.lit('"},"devDependencies":{"'), pkg, F.lit('":"~9.9","local":"file:x"}}'))
    even = k % 2 == 0
    return table(spark, sf, "part").select(
        F.concat(F.lit("r"), k.cast("string")).alias("repo"), F.when(even, "app/requirements.txt").otherwise("package.json").alias("path"),
        F.when(even, req).otherwise(js).alias("content"),
    )


DEPS_CTE = f"""deps AS (SELECT 'r' || p_partkey AS repo, 'app/requirements.txt' AS path, 'python' AS ecosystem, ({sql_list(PACKAGES)})[1 + (p_partkey % 8)] AS package, {_VERSION} AS version, 3::BIGINT AS line_no FROM part WHERE p_partkey % 2 = 0
  UNION ALL SELECT 'r' || p_partkey, 'app/requirements.txt', 'python', ({sql_list(PACKAGES)})[1 + ((p_partkey + 3) % 8)], '1.0', 5 FROM part WHERE p_partkey % 2 = 0
  UNION ALL SELECT 'r' || p_partkey, 'package.json', 'node', ({sql_list(PACKAGES)})[1 + (p_partkey % 8)], '9.9', 0 FROM part WHERE p_partkey % 2 = 1)"""


@query("s7_dependencies", f"WITH {DEPS_CTE} SELECT * FROM deps")
def s7_dependencies(spark, sf):
    return G.extract_dependencies(manifests(spark, sf))


@query("s7_pyproject_dependencies", """SELECT 'r' || p_brand AS repo, 'svc' || p_partkey || '/pyproject.toml' AS path, unnest(['lib' || (p_size % 7), 'web-kit']) AS package, unnest(['1.' || p_size, '2.0']) AS version FROM part""")
def s7_pyproject_dependencies(spark, sf):
    k, size = F.col("p_partkey").cast("string"), F.col("p_size")
    content = F.concat(
        F.lit('[build]\ndependencies = ["no==1.0"]\n[project]\nname = "x"\ndependencies = [\n  "lib'), (size % 7).cast("string"), F.lit("=="), F.lit("1."),
        size.cast("string"), F.lit("\",\n  'web-kit>=2.0,<3',\n  \"bare\"\n]\n[tool.x]\ndependencies = [\"other==3\"]\n"),
    )
    files = table(spark, sf, "part").select(
        F.concat(F.lit("r"), "p_brand").alias("repo"), F.concat(F.lit("svc"), k, F.lit("/pyproject.toml")).alias("path"), content.alias("content"))
    return G.extract_dependencies(files).select("repo", "path", "package", "version")


def plain_dependencies(spark, sf):
    k = F.col("p_partkey")
    version = F.concat_ws(".", (F.col("p_size") % 9).cast("string"), (k % 30).cast("string"), (k % 4).cast("string"))
    return table(spark, sf, "part").select(
        k.alias("id"), F.when(k % 8 > 4, "node").otherwise("python").alias("ecosystem"), _pick(PACKAGES, k % 8).alias("package"), version.alias("version"))


_NUM = "(string_split(regexp_replace({0}, '(\\.0+)+$', ''), '.')::INT[])"


def _version_case(op: str) -> str:
    a, b = _NUM.format("d.version"), _NUM.format("a.v")
    return f"(a.op = {sq(op)} AND {a} {op if op != '==' else '='} {b})"


_VULN = f"""d AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 8 > 4 THEN 'node' ELSE 'python' END AS ecosystem, ({sql_list(PACKAGES)})[1 + (p_partkey % 8)] AS package, {_VERSION} AS version FROM part),
  a(eco, pkg, op, v, severity, summary) AS ({sql_values(R.ADVISORIES)})"""


@query("j18_vulnerabilities", f"WITH {_VULN} SELECT d.id, d.package, d.version, a.severity, a.summary FROM d JOIN a ON a.eco = d.ecosystem AND a.pkg = lower(d.package) WHERE " + " OR ".join(_version_case(o) for o in ("<=", "<", ">=", ">", "==")))
def j18_vulnerabilities(spark, sf):
    advisories = spark.createDataFrame(R.ADVISORIES, "ecosystem string, package string, range_op string, range_version string, severity string, summary string")
    return G.vulnerabilities(plain_dependencies(spark, sf), advisories).select("id", "package", "version", "severity", "summary")


@query("f7_version_compare", f"SELECT p_partkey AS id, {_NUM.format(_VERSION)} >= [4, 15]::INT[] AS recent FROM part")
def f7_version_compare(spark, sf):
    return plain_dependencies(spark, sf).select("id", fn.version_matches(F.col("version"), F.lit(">="), F.lit("4.15.0")).alias("recent"))


# --- permissions ------------------------------------------------------------------------------

COMMANDS = ["Bash(scp ", "Bash(curl https://github.com ", "Bash(curl http://x.y ", "Bash(git push ", "Bash(rm -rf ", "sshpass -p ", "Bash(nc ", "Deploy(", "Read(", "Upload --password ", "Query sk-abcdefghijklmnopqrstuvwx ", "Zip(", "Bash(tar -czf "]
USED = ["Bash(Zip it)", "ran Bash(Deploy now) and Bash(ls)", "nothing", "Bash(Upload --password x)"]


def grants(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        F.concat(F.lit("tool"), (k % 3).cast("string")).alias("tool"),
        F.concat(_pick(COMMANDS, k % 13), k.cast("string"), F.lit(")")).alias("entry"),
    )


def usage(spark, sf):
    p = F.col("l_partkey")
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("tool"), (p % 3).cast("string")).alias("tool"), _pick(USED, (p % 3 + F.col("l_linenumber")) % 4).alias("text"))


_SAFE = " OR ".join(f"starts_with(entry, {sq(p)})" for p in code_rules.SAFE_PREFIXES)
_RISK = ("CASE " + " ".join(
    f"WHEN contains(entry, {sq(p)}) THEN " + (f"CASE WHEN {has_any('entry', code_rules.TRUSTED_HOSTS)} THEN 'LOW' ELSE {sq(lv)} END" if "curl" in p else sq(lv))
    for p, lv in sorted(code_rules.RISK_COMMANDS, key=lambda r: -len(r[0])))
    + f" WHEN {_SAFE} THEN 'LOW' WHEN {has_any('entry', code_rules.PLAINTEXT_PASSWORD)} THEN 'CRITICAL' WHEN regexp_matches(entry, {sq(code_rules.API_KEY)}) THEN 'CRITICAL' ELSE 'INFO' END")
GRANTS_CTE = f"""g AS (SELECT 'tool' || (p_partkey % 3) AS tool, ({sql_list(COMMANDS)})[1 + (p_partkey % 13)] || p_partkey || ')' AS entry FROM part),
  graded AS (SELECT tool, entry, CASE WHEN contains(entry, '(') THEN string_split(entry, '(')[1] ELSE 'unknown' END AS type, {_RISK} AS risk FROM g),
  u AS (SELECT DISTINCT 'tool' || (l_partkey % 3) AS tool, ({sql_list(USED)})[1 + ((l_partkey % 3 + l_linenumber) % 4)] AS text FROM lineitem),
  used AS (SELECT DISTINCT tool, trim(string_split(c, '(')[1]) AS used FROM (SELECT tool, unnest(regexp_extract_all(text, 'Bash\\(([^)]+)\\)', 1)) AS c FROM u)),
  idle AS (SELECT * FROM graded g WHERE risk <> 'LOW' AND NOT EXISTS (SELECT 1 FROM used WHERE used.tool = g.tool AND contains(used.used, g.type)))"""


@query("r42_command_risk", f"WITH {GRANTS_CTE} SELECT * FROM graded")
def r42_command_risk(spark, sf):
    return G.classified_grants(grants(spark, sf))


@query("j19_idle_grants", f"WITH {GRANTS_CTE} SELECT * FROM idle")
def j19_idle_grants(spark, sf):
    return G.idle_grants(grants(spark, sf), usage(spark, sf))


@query("a46_permission_audit", f"""WITH {GRANTS_CTE} SELECT *, CAST(floor(idle * 100.0::DOUBLE / total + 0.5) AS BIGINT) AS idle_pct FROM (SELECT tool, count(*) AS total, count(*) FILTER (WHERE risk = 'CRITICAL') AS critical, count(*) FILTER (WHERE risk = 'HIGH') AS high,
  count(*) FILTER (WHERE risk = 'MEDIUM') AS medium, count(*) FILTER (WHERE risk = 'LOW') AS low, count(*) FILTER (WHERE risk = 'INFO') AS info, (SELECT count(*) FROM idle i WHERE i.tool = g.tool) AS idle FROM graded g GROUP BY tool)""")
def a46_permission_audit(spark, sf):
    return G.permission_audit(grants(spark, sf), usage(spark, sf))


@query("a46_idle_suggestions", f"WITH {GRANTS_CTE} SELECT tool, entry, risk FROM idle ORDER BY tool, entry LIMIT 10")
def a46_idle_suggestions(spark, sf):
    return G.idle_suggestions(grants(spark, sf), usage(spark, sf)).select("tool", "entry", "risk")


# --- leaks ------------------------------------------------------------------------------------

ROOT_NAMES = R.SENSITIVE_FILES + ["README.md", "main.py"]
IGNORE_TEXT = [".env*", "# .env.prod", "credentials.json", "*.pyc", "secrets/", ".ssh", "id_rsa", "", ".aws and .config"]
ROOTS_CTE = f"""rootf AS (SELECT DISTINCT 'r' || p_brand AS repo, ({sql_list(ROOT_NAMES)})[1 + (p_partkey % {len(ROOT_NAMES)})] AS name FROM part),
  ign AS (SELECT 'r' || p_brand AS repo, ({sql_list(IGNORE_TEXT)})[1 + (p_size % {len(IGNORE_TEXT)})] AS line FROM part WHERE p_partkey % 9 = 0 AND p_brand <> 'Brand#3')"""


def root_tables(spark, sf):
    part = table(spark, sf, "part")
    repo = F.concat(F.lit("r"), "p_brand").alias("repo")
    files = part.select(repo, _pick(ROOT_NAMES, F.col("p_partkey") % len(ROOT_NAMES)).alias("path"))
    ignores = part.filter("p_partkey % 9 = 0 AND p_brand <> 'Brand#3'").select(repo, _pick(IGNORE_TEXT, F.col("p_size") % len(IGNORE_TEXT)).alias("line"))
    return files, ignores


@query("j20_exposed_files", rf"""WITH {ROOTS_CTE} SELECT repo, name FROM rootf r WHERE name IN {sql_in(R.SENSITIVE_FILES)} AND NOT EXISTS (SELECT 1 FROM ign i WHERE i.repo = r.repo AND NOT regexp_matches(i.line, '^\s*(#|$)') AND contains(i.line, r.name))""")
def j20_exposed_files(spark, sf):
    return G.exposed_files(*root_tables(spark, sf))


@query("j20_ignore_gaps", f"WITH {ROOTS_CTE} SELECT r.repo, m.missing FROM (SELECT DISTINCT repo FROM rootf) r, ({sql_values([(x,) for x in R.MUST_IGNORE])}) m(missing) WHERE NOT EXISTS (SELECT 1 FROM ign i WHERE i.repo = r.repo AND contains(i.line, m.missing))")
def j20_ignore_gaps(spark, sf):
    return G.ignore_gaps(*root_tables(spark, sf))


TARGETS = ["/work/r1/lib", "/home/u/.ssh/id", "/home/u/docs", "/etc/secrets/.config/x", "/home/u/.aws"]


@query("j21_leaking_links", f"""SELECT * FROM (SELECT p_partkey AS id, target, CASE {' '.join(f"WHEN contains(target, {sq(s)}) THEN {sq(s)}" for s in R.SENSITIVE_DIRS)} END AS sensitive
  FROM (SELECT p_partkey, ({sql_list(TARGETS)})[1 + (p_partkey % 5)] AS target, CASE WHEN p_size % 2 = 0 THEN '/home/u' ELSE '/work/r1' END AS root FROM part) WHERE NOT starts_with(target, root)) WHERE sensitive IS NOT NULL""")
def j21_leaking_links(spark, sf):
    links = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), _pick(TARGETS, F.col("p_partkey") % 5).alias("target"),
        F.when(F.col("p_size") % 2 == 0, "/home/u").otherwise("/work/r1").alias("root"))
    return G.leaking_links(links).drop("root")


_PATH_HITS = " OR ".join(f"regexp_matches(line, {sq(p)})" for p in code_rules.sensitive_paths())


@query("a47_leak_rollup", over_lines(rf"""SELECT 'tool_traces' AS check_name, count(*) AS findings, true AS passed FROM (SELECT DISTINCT repo, string_split(path, '/')[1] AS e FROM files) WHERE {has_any('e', code_rules.TOOL_TRACES)}
  UNION ALL SELECT 'hardcoded_paths', count(*), false FROM lines WHERE NOT regexp_matches(line, '^\s*(#|//)') AND ({_PATH_HITS})"""))
def a47_leak_rollup(spark, sf):
    files = code_files(spark, sf)
    traces = S.scan_tool_traces(files).select(F.lit("tool_traces").alias("check_name"), F.lit("WARNING").alias("level"))
    paths = S.scan_paths(files).select(F.lit("hardcoded_paths").alias("check_name"), F.lit("CRITICAL").alias("level"))
    return G.leak_rollup(traces.unionByName(paths))


# --- tests and coverage -----------------------------------------------------------------------

TEST_DIRS = ["services", "core", "api", "lib", "models", "services"]
TFILES_CTE = f"""tf AS (SELECT DISTINCT repo, path FROM (SELECT 'r' || (l_suppkey % 7) AS repo, CASE WHEN l_linenumber < 4 THEN ({sql_list(TEST_DIRS)})[1 + (l_partkey % 6)] || '/x/f' || (l_partkey % 400) || '.py'
  WHEN l_linenumber = 4 THEN ({sql_list(TEST_DIRS)})[1 + (l_partkey % 6)] || '/__init__.py' ELSE 'tests/unit/' || ({sql_list(TEST_DIRS)})[1 + (l_partkey % 6)] || '/test_f' || (l_partkey % 400) || '.py' END AS path FROM lineitem))"""


def test_tree(spark, sf):
    d, n = _pick(TEST_DIRS, F.col("l_partkey") % 6), (F.col("l_partkey") % 400).cast("string")
    path = (
        F.when(F.col("l_linenumber") < 4, F.concat(d, F.lit("/x/f"), n, F.lit(".py"))).when(F.col("l_linenumber") == 4, F.concat(d, F.lit("/__init__.py")))
        .otherwise(F.concat(F.lit("tests/unit/"), d, F.lit("/test_f"), n, F.lit(".py")))
    )
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("r"), (F.col("l_suppkey") % 7).cast("string")).alias("repo"), path.alias("path")).distinct()


@query("j22_missing_tests", f"""WITH {TFILES_CTE}, w AS (SELECT repo, path, 'tests/unit/' || string_split(path, '/')[1] || '/test_' || string_split(path, '/')[-1] AS expected FROM tf
  WHERE string_split(path, '/')[1] IN {sql_in(R.MONITORED_DIRS)} AND NOT ends_with(path, '__init__.py')) SELECT * FROM w WHERE (repo, expected) NOT IN (SELECT (repo, path) FROM tf)""")
def j22_missing_tests(spark, sf):
    files = test_tree(spark, sf)
    return G.missing_tests(files, files)


COVERAGE_CTE = """cov AS (SELECT 'r' || l_suppkey AS repo, 'src/f' || (l_partkey % 50) || '.py' AS path, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS statements, CAST(sum(CAST(l_quantity AS BIGINT) * (l_linenumber + 3) // 10) AS BIGINT) AS covered FROM lineitem GROUP BY ALL)"""


def coverage_reports(spark, sf):
    """One coverage document per (repo, file) with a single entry, so no document gathers a repo."""
    q = F.col("l_quantity").cast("long")
    rows = table(spark, sf, "lineitem").groupBy(
        F.concat(F.lit("r"), F.col("l_suppkey").cast("string")).alias("repo"),
        F.concat(F.lit("src/f"), (F.col("l_partkey") % 50).cast("string"), F.lit(".py")).alias("path"),
    ).agg(F.sum(q).alias("num_statements"), F.sum(F.expr("CAST(l_quantity AS BIGINT) * (l_linenumber + 3) DIV 10")).alias("covered_lines"))
    pct = F.floor(F.col("covered_lines") * 100 / F.col("num_statements")).cast("double")
    summary = F.struct("num_statements", "covered_lines", pct.alias("percent_covered"))
    doc = F.to_json(F.struct(F.create_map("path", F.struct(summary.alias("summary"))).alias("files")))
    return rows.select("repo", doc.alias("doc"))


@query("s8_coverage", f"WITH {COVERAGE_CTE} SELECT repo, path, statements, covered, CAST(floor(covered * 100 / statements) AS DOUBLE) AS pct FROM cov")
def s8_coverage(spark, sf):
    return G.read_coverage(coverage_reports(spark, sf))


@query("j23_coverage_gate", f"WITH {COVERAGE_CTE}, c AS (SELECT repo, path, CAST(floor(covered * 100 / statements) AS DOUBLE) AS pct, path IN ('src/f1.py', 'src/f7.py', 'src/f12.py') AS is_new FROM cov) "
       "SELECT *, CASE WHEN is_new THEN 85.0::DOUBLE ELSE 80.0::DOUBLE END AS threshold FROM c WHERE pct < CASE WHEN is_new THEN 85 ELSE 80 END")
def j23_coverage_gate(spark, sf):
    coverage = G.read_coverage(coverage_reports(spark, sf))
    changed = coverage.filter("path IN ('src/f1.py', 'src/f7.py', 'src/f12.py')").select("repo", "path")
    return G.coverage_gate(coverage, changed)


_GROUPS = [("scoring", "src/f1.py"), ("scoring", "src/f2.py"), ("gates", "src/f3.py"), ("graph", "src/f40.py")]


@query("a48_critical_coverage", f"""WITH {COVERAGE_CTE}, g AS (SELECT group_name, CAST(sum(covered) AS BIGINT) AS covered, CAST(sum(statements) AS BIGINT) AS statements FROM cov JOIN ({sql_values(_GROUPS)}) k(group_name, path) USING (path) GROUP BY group_name)
  SELECT *, CASE WHEN pct >= 80 THEN 'A' WHEN pct >= 60 THEN 'B' WHEN pct >= 40 THEN 'C' ELSE 'D' END AS grade FROM (SELECT *, covered * 100.0::DOUBLE / statements AS pct FROM g)""")
def a48_critical_coverage(spark, sf):
    groups = spark.createDataFrame(_GROUPS, "group_name string, path string")
    return G.critical_coverage(G.read_coverage(coverage_reports(spark, sf)), groups)


# --- scalar functions -------------------------------------------------------------------------

@query("f2_line_counts", over_files("SELECT path, CAST(len(string_split(content, chr(10))) AS BIGINT) AS n, substr(md5(path), 1, 8) AS key FROM files", docs=True))
def f2_line_counts(spark, sf):
    from lintlake.plans.corpus import doc_files

    return doc_files(spark, sf).select("path", fn.line_count(F.col("content")).alias("n"), fn.short_md5(F.col("path")).alias("key"))


@query("f3_error_keys", over_files("SELECT path, ext || ':' || array_to_string(string_split(path, '/')[-2:], '/') AS error_key, string_split(path, '/')[-2] AS module FROM files"))
def f3_error_keys(spark, sf):
    return code_files(spark, sf).select("path", fn.error_key(F.col("ext"), F.col("path")).alias("error_key"), fn.module_of(F.col("path")).alias("module"))


@query("f10_json_lists", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'a|' || event_type WHEN 1 THEN 'plain' ELSE '' END AS items FROM events""")
def f10_json_lists(spark, sf):
    e = F.col("event_id")
    text = F.when(e % 3 == 0, F.concat(F.lit('["a","'), "event_type", F.lit('"]'))).when(e % 3 == 1, "plain").otherwise("[]")
    return table(spark, sf, "events").select("event_id", F.concat_ws("|", fn.json_list(text)).alias("items"))
