"""Graph and code-fact queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.operators import facts as V, graph as G, lines as L
from lintlake.plans.corpus import code_files, over_files, over_lines, table
from lintlake.plans.registry import query, sq, sql_list, sql_in, sql_values
from lintlake.plans.scan_queries import GEDGES_CTE, NODES_CTE, graph_edges, graph_nodes
from lintlake.plans.scoring_queries import _pick
from lintlake.rules import code_rules, graph_rules as R


# --- facts of the derived corpus, checked by patterns that fit its templates --------------------

_IMPORT = r"^(?:import\s+([\w.]+)|from\s+([\w.]+)\s+import\s+(.+))$"


@query("v4_import_facts", over_lines(rf"""SELECT path, line_no, CASE WHEN m[2] <> '' THEN m[2] ELSE m[3] END AS module, CASE WHEN m[2] <> '' THEN m[2] ELSE trim(unnest(string_split(m[4], ','))) END AS imported
  FROM (SELECT path, line_no, [''] || [regexp_extract(line, {sq(_IMPORT)}, 1), regexp_extract(line, {sq(_IMPORT)}, 2), regexp_extract(line, {sq(_IMPORT)}, 3)] AS m FROM lines WHERE ext = 'py' AND regexp_matches(line, {sq(_IMPORT)}))"""))
def v4_import_facts(spark, sf):
    return V.import_facts(code_files(spark, sf)).select("path", "line_no", "module", "imported")


#: Plain imports of the corpus in other forms: indented, with an alias, a list, a comment; in brackets over several lines.
_FORMS = [
    (r"(?m)^import ([\w.]+)$", "if ready:\n    import $1 as short, os.path  # import none"),
    (r"(?m)^from ([\w.]+) import ([\w, ]+)$", "text = '''\nimport nothing\n'''\nfrom $1 import (  # (\n    $2 as kept,\n    other,\n); from . \\\\\n  import near"),
]


@query("v4_import_forms", over_lines(rf"""SELECT path, module, imported, alias, count(*) AS n FROM (
  SELECT path, unnest([{{'module': i, 'imported': i, 'alias': 'short'}}, {{'module': 'os.path', 'imported': 'os.path', 'alias': NULL}}], recursive := true)
    FROM (SELECT path, regexp_extract(line, {sq(_IMPORT)}, 1) AS i FROM lines WHERE ext = 'py') WHERE i <> ''
  UNION ALL SELECT path, m, trim(unnest(string_split(names, ','))), unnest(list_append(list_transform(range(len(string_split(names, ',')) - 1), lambda x: NULL::VARCHAR), 'kept'))
    FROM (SELECT path, regexp_extract(line, {sq(_IMPORT)}, 2) AS m, regexp_extract(line, {sq(_IMPORT)}, 3) AS names FROM lines WHERE ext = 'py') WHERE m <> ''
  UNION ALL SELECT path, unnest([m, '.']), unnest(['other', 'near']), NULL FROM (SELECT path, regexp_extract(line, {sq(_IMPORT)}, 2) AS m FROM lines WHERE ext = 'py') WHERE m <> '')
  GROUP BY ALL"""))
def v4_import_forms(spark, sf):
    content = F.col("content")
    for pattern, form in _FORMS:
        content = F.regexp_replace(content, pattern, form)
    return V.import_facts(code_files(spark, sf).withColumn("content", content)).groupBy("path", "module", "imported", "alias").agg(F.count("*").alias("n"))


@query("v4_definition_facts", over_lines(r"""SELECT path, line_no, regexp_extract(line, '^\s*(?:async\s+)?(def|class)\s+(\w+)', 1) AS kind, regexp_extract(line, '^\s*(?:async\s+)?(def|class)\s+(\w+)', 2) AS name,
  regexp_matches(line, '^\s*async') AS is_async FROM lines WHERE ext = 'py' AND regexp_matches(line, '^\s*(?:async\s+)?(def|class)\s+\w+')"""))
def v4_definition_facts(spark, sf):
    return V.definition_facts(L.to_lines(code_files(spark, sf))).select("path", F.col("line_no").cast("long").alias("line_no"), "kind", "name", "is_async")


# --- a relational fact table from the order lines -----------------------------------------------

CALLED = ["print", "len", "breakpoint", "exit", "reduce", "__import__", "fetch_rows", "create_task", "pytest", "ValueError"]
FACTS_CTE = f"""facts AS (SELECT 'r' || (l_suppkey % 5) AS repo, 'd' || (l_suppkey % 10) || '/m' || l_suppkey || '.py' AS path,
  (['def', 'call', 'import', 'assign', 'call', 'export', 'use'])[1 + ((l_linenumber + l_partkey) % 7)] AS kind, CASE WHEN l_partkey % 700 < 40 THEN ({sql_list(CALLED)})[1 + (l_partkey % 700 % {len(CALLED)})] ELSE 'n' || (l_partkey % 700) END AS name,
  (['name', 'attribute', 'subscript', 'other'])[1 + (l_orderkey % 4)] AS qualifier, l_linenumber AS line_no, l_returnflag = 'A' AS is_async, 'fn' || (l_orderkey % 30) AS enclosing,
  (['self', 'obj', 'n' || (l_orderkey % 300)])[1 + (l_orderkey % 3)] AS signature FROM lineitem)"""


def fact_table(spark, sf):
    def s(c):
        return c.cast("string")

    o, p, k = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("r"), s(k % 5)).alias("repo"), F.concat(F.lit("d"), s(k % 10), F.lit("/m"), s(k), F.lit(".py")).alias("path"),
        _pick(["def", "call", "import", "assign", "call", "export", "use"], (F.col("l_linenumber") + p) % 7).alias("kind"),
        F.when(p % 700 < 40, _pick(CALLED, p % 700 % len(CALLED))).otherwise(F.concat(F.lit("n"), s(p % 700))).alias("name"), _pick(["name", "attribute", "subscript", "other"], o % 4).alias("qualifier"),
        F.col("l_linenumber").alias("line_no"), (F.col("l_returnflag") == "A").alias("is_async"),
        F.concat(F.lit("fn"), s(o % 30)).alias("enclosing"),
        F.when(o % 3 == 0, "self").when(o % 3 == 1, "obj").otherwise(F.concat(F.lit("n"), s(o % 300))).alias("signature"),
        F.lit(False).alias("is_awaited"), F.lit("").alias("body_hash"),
    )


_MISSING = f"""called AS (SELECT repo, path, line_no, CASE WHEN qualifier = 'name' THEN name WHEN qualifier = 'attribute' AND signature NOT IN ('self', '') THEN signature END AS name FROM facts WHERE kind = 'call'),
  bound AS (SELECT repo, path, name FROM facts WHERE kind IN ('def', 'assign', 'import') UNION SELECT repo, path, qualifier FROM facts WHERE kind = 'import'),
  missing AS (SELECT repo, path, name, line_no FROM called c WHERE name IS NOT NULL AND name NOT IN {sql_in(R.NEEDS_NO_IMPORT)} AND NOT EXISTS (SELECT 1 FROM bound b WHERE b.repo = c.repo AND b.path = c.path AND b.name = c.name))"""


@query("j8_missing_imports", f"WITH {FACTS_CTE}, {_MISSING} SELECT * FROM missing")
def j8_missing_imports(spark, sf):
    return G.missing_imports(fact_table(spark, sf))


ASYNC_CTE = """af AS (SELECT 'r' || (l_suppkey % 5) AS repo, 'd/m' || l_suppkey || '.py' AS path, CASE WHEN l_linenumber < 4 THEN 'call' ELSE 'def' END AS kind,
  (['create_task', 'fetch_rows', 'loadItems', 'n' || (l_partkey % 40)])[1 + (l_partkey % 4)] AS name, (['name', 'attribute', 'other'])[1 + (l_orderkey % 3)] AS qualifier, l_linenumber AS line_no,
  l_returnflag = 'A' AS is_async, l_linestatus = 'O' AS is_awaited, CASE WHEN l_orderkey % 5 = 0 THEN '' ELSE 'n' || (l_orderkey % 40) END AS enclosing, CASE WHEN l_discount > 0.05 THEN 'dropped' ELSE '' END AS body FROM lineitem)"""


def async_facts(spark, sf):
    def s(c):
        return c.cast("string")

    o, p, k = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("r"), s(k % 5)).alias("repo"), F.concat(F.lit("d/m"), s(k), F.lit(".py")).alias("path"),
        F.when(F.col("l_linenumber") < 4, "call").otherwise("def").alias("kind"),
        F.when(p % 4 == 0, "create_task").when(p % 4 == 1, "fetch_rows").when(p % 4 == 2, "loadItems").otherwise(F.concat(F.lit("n"), s(p % 40))).alias("name"),
        _pick(["name", "attribute", "other"], o % 3).alias("qualifier"), F.col("l_linenumber").alias("line_no"),
        (F.col("l_returnflag") == "A").alias("is_async"), (F.col("l_linestatus") == "O").alias("is_awaited"),
        F.when(o % 5 == 0, "").otherwise(F.concat(F.lit("n"), s(o % 40))).alias("enclosing"),
        F.when(F.col("l_discount") > 0.05, "dropped").otherwise("").alias("body_hash"),
    )


@query("r38_async_safety", f"""WITH {ASYNC_CTE}, c AS (SELECT * FROM af WHERE kind = 'call'), d AS (SELECT DISTINCT repo, path, name, is_async FROM af WHERE kind = 'def')
  SELECT repo, path, line_no, name, 'fire_and_forget' AS rule FROM c WHERE qualifier = 'attribute' AND name = 'create_task' AND body = 'dropped' AND NOT is_awaited
  UNION ALL SELECT repo, path, line_no, name, 'discarded_await' FROM c WHERE is_awaited AND body = 'dropped' AND regexp_matches(lower(name), '{'|'.join(R.FETCH_WORDS)}')
  UNION ALL SELECT repo, path, line_no, name, 'sync_calls_async' FROM c WHERE NOT is_awaited AND enclosing <> '' AND qualifier IN ('name', 'attribute')
    AND EXISTS (SELECT 1 FROM d WHERE d.repo = c.repo AND d.path = c.path AND d.name = c.name AND is_async) AND EXISTS (SELECT 1 FROM d WHERE d.repo = c.repo AND d.path = c.path AND d.name = c.enclosing AND NOT is_async)""")
def r38_async_safety(spark, sf):
    return G.async_safety(async_facts(spark, sf))


@query("j9_definition_hints", f"""WITH {FACTS_CTE}, {_MISSING}, w AS (SELECT DISTINCT repo, path, name FROM missing) SELECT repo, path, name,
  coalesce((SELECT min(f.path) FROM facts f WHERE f.kind = 'def' AND f.repo = w.repo AND f.name = w.name AND string_split(f.path, '/')[1] = string_split(w.path, '/')[1] AND f.path <> w.path), '') AS defined_in FROM w""")
def j9_definition_hints(spark, sf):
    facts = fact_table(spark, sf)
    return G.definition_hint(G.missing_imports(facts), facts).withColumn("defined_in", F.coalesce("defined_in", F.lit("")))


@query("j10_unused_exports_python", f"""WITH {FACTS_CTE} SELECT repo, path, name, min(line_no) AS line_no FROM facts e WHERE kind = 'export'
  AND EXISTS (SELECT 1 FROM facts d WHERE d.repo = e.repo AND d.path = e.path AND d.name = e.name AND d.kind IN ('def', 'assign'))
  AND NOT EXISTS (SELECT 1 FROM facts d WHERE d.repo = e.repo AND d.path = e.path AND d.name = e.name AND d.kind IN ('use', 'assign')) GROUP BY ALL""")
def j10_unused_exports_python(spark, sf):
    return G.unused_exports_python(fact_table(spark, sf))


_EXPORTED = f"CASE WHEN ext = 'go' THEN regexp_extract(line, {sq(R.GO_EXPORT)}, 1) || regexp_extract(line, {sq(R.GO_EXPORT)}, 2) ELSE regexp_extract(line, {sq(R.TS_EXPORT)}, 1) END"


@query("j10_unused_exports_text", over_lines(
    r"""SELECT DISTINCT repo, path, name FROM x e WHERE name <> '' AND (ext = 'ts' OR NOT commented) AND NOT EXISTS (SELECT 1 FROM x u WHERE u.path = e.path AND NOT u.commented
      AND (CASE WHEN e.ext = 'go' THEN u.line_no <> e.line_no ELSE u.name <> e.name END) AND regexp_matches(u.line, '\b' || e.name || '\b'))""",
    ctes=rf"x AS (SELECT *, {_EXPORTED} AS name, regexp_matches(line, '^\s*(//|/\*)') AS commented FROM lines WHERE ext IN ('ts', 'go'))"))
def j10_unused_exports_text(spark, sf):
    return G.unused_exports_text(code_files(spark, sf))


@query("j11_unused_exports_repo", over_lines(
    r"""SELECT DISTINCT repo, name FROM x e WHERE name <> '' AND NOT EXISTS (SELECT 1 FROM t WHERE t.repo = e.repo AND t.word = e.name)""",
    ctes=rf"""x AS (SELECT repo, line, CASE WHEN regexp_matches(line, '^\s*//') THEN '' ELSE regexp_extract(line, {sq(R.TS_EXPORT_WIDE)}, 1) END AS name FROM lines WHERE ext = 'ts'),
    t AS (SELECT DISTINCT repo, word FROM (SELECT repo, name, unnest(regexp_extract_all(line, '\w+')) AS word FROM x) WHERE word <> name)"""))
def j11_unused_exports_repo(spark, sf):
    return G.unused_exports_repo(L.to_lines(code_files(spark, sf)))


# --- call graph -------------------------------------------------------------------------------

_CALLS = """calls AS (SELECT repo, path || '::' || enclosing AS src, CASE qualifier WHEN 'attribute' THEN signature || '.' || name ELSE name END AS dst,
  CASE qualifier WHEN 'name' THEN 'direct_call' ELSE 'direct_call' END AS edge_type, CASE qualifier WHEN 'name' THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END AS confidence FROM facts WHERE kind = 'call' AND qualifier IN ('name', 'attribute'))"""


def call_table(spark, sf):
    return G.call_edges(fact_table(spark, sf).filter("kind = 'call'"))


@query("g2_call_edges", f"WITH {FACTS_CTE}, {_CALLS} SELECT * FROM calls")
def g2_call_edges(spark, sf):
    return call_table(spark, sf)


@query("f11_call_confidence", f"WITH {FACTS_CTE} SELECT qualifier, CASE qualifier WHEN 'name' THEN 1.0::DOUBLE WHEN 'attribute' THEN 0.9::DOUBLE WHEN 'subscript' THEN 0.3::DOUBLE ELSE 0.7::DOUBLE END AS confidence, count(*) AS n FROM facts WHERE kind = 'call' GROUP BY ALL")
def f11_call_confidence(spark, sf):
    from lintlake.functions.scalars import call_confidence

    return fact_table(spark, sf).filter("kind = 'call'").groupBy("qualifier", call_confidence(F.col("qualifier")).alias("confidence")).agg(F.count("*").alias("n"))


@query("a38_graph_stats", f"""WITH {FACTS_CTE}, {_CALLS} SELECT f.repo, f.functions, coalesce(e.edges, 0) AS edges, coalesce(e.callers, 0) AS callers, CAST(floor(coalesce(e.m, 0) * 100 + 0.5) AS BIGINT) AS mean_confidence_x100
  FROM (SELECT repo, count(*) AS functions FROM facts WHERE kind = 'def' GROUP BY repo) f LEFT JOIN (SELECT repo, count(*) AS edges, count(DISTINCT src) AS callers, avg(confidence) AS m FROM calls GROUP BY repo) e ON e.repo = f.repo""")
def a38_graph_stats(spark, sf):
    stats = G.graph_stats(call_table(spark, sf), fact_table(spark, sf).filter("kind = 'def'"))
    return stats.withColumn("mean_confidence_x100", F.floor(F.col("mean_confidence") * 100 + 0.5).cast("long")).drop("mean_confidence")


_EDGE_FORMS = """cf AS (SELECT repo, path || '::' || enclosing AS src, name AS dst, max(CASE qualifier WHEN 'name' THEN 4 WHEN 'attribute' THEN 4 WHEN 'subscript' THEN 1 ELSE 2 END) / 4.0::DOUBLE AS confidence FROM facts WHERE kind = 'call' GROUP BY ALL)"""


def confident_edges(spark, sf):
    form = F.col("qualifier")
    quarter = F.when(form.isin("name", "attribute"), 1.0).when(form == "subscript", 0.25).otherwise(0.5)
    return fact_table(spark, sf).filter("kind = 'call'").select(
        "repo", F.concat_ws("::", "path", "enclosing").alias("src"), F.col("name").alias("dst"), quarter.alias("confidence")
    )


@query("j13_change_impact", f"""WITH {FACTS_CTE}, {_EDGE_FORMS} SELECT repo, dst, count(*) FILTER (WHERE confidence >= 0.8) AS direct_callers, count(*) FILTER (WHERE confidence < 0.8) AS indirect_callers, count(*) AS total_callers,
  CASE WHEN count(*) FILTER (WHERE confidence >= 0.8) >= 5 OR sum(confidence) >= 4 THEN 'high' WHEN count(*) FILTER (WHERE confidence >= 0.8) >= 2 OR count(*) >= 5 THEN 'medium' ELSE 'low' END AS risk
  FROM cf WHERE (repo, dst) IN (SELECT (repo, name) FROM facts WHERE kind = 'def' AND is_async) GROUP BY repo, dst""")
def j13_change_impact(spark, sf):
    changed = fact_table(spark, sf).filter("kind = 'def' AND is_async").select("repo", "name")
    return G.impact(changed, confident_edges(spark, sf))


_PREFLIGHT_CTE = r"""chg AS (SELECT source AS repo, (['load_', 'helper_', 'missing_call_', 'fetch', 'compute', 'calculate_'])[1 + (doc_id % 6)] || CASE WHEN doc_id % 6 IN (3, 4) THEN '' ELSE CAST(doc_id % 7 AS VARCHAR) END AS name,
  max((['modified', 'deleted', 'async_signature'])[1 + (doc_id % 3)]) AS change_type FROM documents GROUP BY ALL),
  txt AS (SELECT DISTINCT repo, name, path || ':' || line_no AS caller FROM (SELECT repo, path, line_no, line, unnest(regexp_extract_all(line, '([A-Za-z_][A-Za-z0-9_]*)[(]', 1)) AS name FROM lines WHERE NOT contains(line, '#'))
    WHERE NOT contains(line, 'def ' || name) AND NOT contains(line, 'class ' || name)),
  gr AS (SELECT DISTINCT source AS repo, 'fetch' AS name, 'g' || (doc_id % 9) AS caller FROM documents),
  n AS (SELECT repo, name, count(DISTINCT caller) AS n FROM (SELECT * FROM txt UNION ALL SELECT * FROM gr) GROUP BY ALL)"""


@query("j14_preflight_risk", over_lines("""SELECT * FROM (SELECT repo, name, change_type, coalesce(n.n, 0) AS callers, CASE WHEN change_type = 'async_signature' THEN CASE WHEN coalesce(n.n, 0) > 0 THEN 'critical' ELSE 'high' END
  WHEN change_type = 'deleted' THEN CASE WHEN coalesce(n.n, 0) > 5 THEN 'critical' ELSE 'high' END WHEN coalesce(n.n, 0) > 3 THEN 'high' WHEN coalesce(n.n, 0) > 0 THEN 'medium' ELSE 'low' END AS risk
  FROM chg LEFT JOIN n USING (repo, name)) WHERE callers > 0 OR change_type = 'async_signature'""", ctes=_PREFLIGHT_CTE))
def j14_preflight_risk(spark, sf):
    doc = F.col("doc_id")
    docs = table(spark, sf, "documents")
    digit = F.when((doc % 6).isin(3, 4), "").otherwise((doc % 7).cast("string"))
    name = F.concat(_pick(["load_", "helper_", "missing_call_", "fetch", "compute", "calculate_"], doc % 6), digit)
    changes = docs.groupBy(F.col("source").alias("repo"), name.alias("name")).agg(
        F.max(_pick(["modified", "deleted", "async_signature"], doc % 3)).alias("change_type")
    )
    graph = docs.select(F.col("source").alias("repo"), F.lit("fetch").alias("name"), F.concat(F.lit("g"), (doc % 9).cast("string")).alias("caller")).distinct()
    found = G.text_callers(L.to_lines(code_files(spark, sf)), changes)
    return G.preflight(changes, graph, found)


@query("j12_callers", f"WITH {NODES_CTE}, {GEDGES_CTE} SELECT id, name, file_path FROM nodes WHERE id IN (SELECT e.source FROM gedges e JOIN nodes t ON t.id = e.target WHERE e.kind = 'calls' AND t.name = 'handleStop' AND t.language = 'typescript')")
def j12_callers(spark, sf):
    return G.callers(graph_nodes(spark, sf), graph_edges(spark, sf), "handleStop").select("id", "name", "file_path")


@query("j15_two_hop_impact", f"""WITH {NODES_CTE}, {GEDGES_CTE}, d AS (SELECT DISTINCT s.file_path FROM gedges e JOIN nodes t ON t.id = e.target JOIN nodes s ON s.id = e.source WHERE e.kind = 'calls' AND t.name = 'isDuplicate' AND t.language = 'typescript'),
  i AS (SELECT DISTINCT s.file_path FROM gedges e JOIN nodes t ON t.id = e.target JOIN nodes s ON s.id = e.source WHERE e.kind = 'calls' AND t.language = 'typescript'
    AND t.name IN (SELECT name FROM nodes WHERE kind IN ('function', 'method') AND file_path IN (SELECT file_path FROM d)))
  SELECT *, CASE WHEN direct_files + indirect_files > 10 THEN 'high' WHEN direct_files + indirect_files > 3 THEN 'medium' ELSE 'low' END AS risk FROM (SELECT (SELECT count(*) FROM d) AS direct_files, (SELECT count(*) FROM i) AS indirect_files)""")
def j15_two_hop_impact(spark, sf):
    return G.impact_2hop(graph_nodes(spark, sf), graph_edges(spark, sf), "isDuplicate")


@query("p12_node_filter", f"WITH {NODES_CTE} SELECT id, name, file_path FROM nodes WHERE kind = 'function' AND name ILIKE '%debounce%' AND file_path ILIKE '%.TS%'")
def p12_node_filter(spark, sf):
    return G.graph_filter(graph_nodes(spark, sf), "function", "debounce", ".TS").select("id", "name", "file_path")


@query("p12_edge_filter", f"WITH {GEDGES_CTE} SELECT source, target, kind FROM gedges WHERE kind = 'calls'")
def p12_edge_filter(spark, sf):
    return G.edge_filter(graph_edges(spark, sf), kind="calls")


# --- import graph -----------------------------------------------------------------------------

IMPORTS_CTE = """imports AS (SELECT 'r' || (l_suppkey % 4) AS repo, 'pkg.m' || (l_suppkey % 200) AS src, CASE WHEN l_linenumber < 5 THEN 'pkg' ELSE 'pkg.m' || (l_partkey % 90) END AS qualifier,
    CASE WHEN l_linenumber < 5 THEN 'm' || (l_partkey % 150) ELSE 'x' END AS name FROM lineitem),
  modules AS (SELECT DISTINCT repo, src AS module FROM imports),
  edges AS (SELECT DISTINCT i.repo, i.src, m.module AS dst FROM imports i JOIN modules m ON m.repo = i.repo AND (m.module = i.qualifier || '.' || i.name OR m.module = i.qualifier))"""


def import_table(spark, sf):
    def s(c):
        return c.cast("string")

    low = F.col("l_linenumber") < 5
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("r"), s(F.col("l_suppkey") % 4)).alias("repo"), F.concat(F.lit("pkg.m"), s(F.col("l_suppkey") % 200)).alias("src"),
        F.when(low, "pkg").otherwise(F.concat(F.lit("pkg.m"), s(F.col("l_partkey") % 90))).alias("qualifier"),
        F.when(low, F.concat(F.lit("m"), s(F.col("l_partkey") % 150))).otherwise("x").alias("name"),
    )


def module_edges(spark, sf):
    imports = import_table(spark, sf)
    return G.import_edges(imports, imports.select("repo", F.col("src").alias("module")))


@query("g1_import_edges", f"WITH {IMPORTS_CTE} SELECT * FROM edges")
def g1_import_edges(spark, sf):
    return module_edges(spark, sf)


@query("a25_dependency_hubs", f"""WITH {IMPORTS_CTE}, c AS (SELECT repo, qualifier || '.' || name AS dst, count(*) AS n FROM imports GROUP BY ALL HAVING count(*) >= 5)
  SELECT repo, dst, n, row_number() OVER (PARTITION BY repo ORDER BY n DESC, dst) AS rank FROM c QUALIFY rank <= 10""")
def a25_dependency_hubs(spark, sf):
    return G.hubs(import_table(spark, sf).select("repo", F.concat_ws(".", "qualifier", "name").alias("dst")))


_CORE = """counted AS (SELECT repo, dst, count(DISTINCT src) AS importers FROM edges GROUP BY ALL), core AS (SELECT repo, dst AS module, importers FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY importers DESC, dst) AS k,
  count(*) OVER (PARTITION BY repo) AS n FROM counted) WHERE k <= greatest(3, n // 10))"""


@query("a26_core_modules", f"WITH {IMPORTS_CTE}, {_CORE} SELECT * FROM core")
def a26_core_modules(spark, sf):
    return G.core_modules(module_edges(spark, sf))


@query("g4_core_depends_on_edge", f"WITH {IMPORTS_CTE}, {_CORE} SELECT repo, src, dst FROM edges WHERE (repo, src) IN (SELECT (repo, module) FROM core) AND (repo, dst) NOT IN (SELECT (repo, module) FROM core)")
def g4_core_depends_on_edge(spark, sf):
    edges = module_edges(spark, sf)
    return G.core_depends_on_edge(edges, G.core_modules(edges))


@query("g3_import_cycles", f"""WITH RECURSIVE {IMPORTS_CTE}, e AS (SELECT repo, src, dst FROM edges), reach AS (SELECT repo, src, dst FROM e UNION SELECT r.repo, r.src, e.dst FROM reach r JOIN e ON e.repo = r.repo AND e.src = r.dst),
  parts AS (SELECT a.repo, a.src AS module, min(a.dst) AS cycle FROM reach a JOIN reach b ON b.repo = a.repo AND b.src = a.dst AND b.dst = a.src GROUP BY a.repo, a.src)
  SELECT repo, module, cycle, count(*) OVER (PARTITION BY repo, cycle) AS modules FROM parts""")
def g3_import_cycles(spark, sf):
    return G.cycle_groups(module_edges(spark, sf))


# --- layers -----------------------------------------------------------------------------------

LAYER_DIRS = ["api", "services", "db", "models", "utils", "app/core", "lib", "tests", "src/service", "handlers"]
LAYER_MODULES = ["db", "service.x", "api", "model", "repositories.y", "os", "routes", "util"]
LAYER_IMPORTS_CTE = f"""imports AS (SELECT 'r' || (l_orderkey % 6) AS repo, ({sql_list(LAYER_DIRS)})[1 + (l_suppkey % 10)] || '/f' || (l_orderkey % 500) || '.py' AS path, ({sql_list(LAYER_MODULES)})[1 + (l_partkey % 8)] AS qualifier FROM lineitem)"""


def layer_imports(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("r"), (F.col("l_orderkey") % 6).cast("string")).alias("repo"),
        F.concat(_pick(LAYER_DIRS, F.col("l_suppkey") % 10), F.lit("/f"), (F.col("l_orderkey") % 500).cast("string"), F.lit(".py")).alias("path"),
        _pick(LAYER_MODULES, F.col("l_partkey") % 8).alias("qualifier"),
    )


_LAYER_DIM = f"ld AS ({sql_values([(n, d) for n, ds, _ in R.LAYERS for d in ds])}), lf AS ({sql_values([(n, w, w.rstrip('s')) for n, _, ws in R.LAYERS for w in ws])})"
_IN_FILES = """i AS (SELECT *, string_split(qualifier, '.')[1] AS mod FROM imports WHERE NOT contains(path, '/test') AND NOT starts_with(path, 'test')),
  il AS (SELECT i.*, l.layer FROM i, (SELECT DISTINCT col0 AS layer FROM ld) l WHERE EXISTS (SELECT 1 FROM ld WHERE ld.col0 = l.layer AND (starts_with(i.path, ld.col1) OR contains(i.path, '/' || ld.col1 || '/'))))"""


@query("j16_layer_violations", f"WITH {LAYER_IMPORTS_CTE}, {_LAYER_DIM}, {_IN_FILES} SELECT DISTINCT repo, path, layer, lf.col1 AS forbidden FROM il JOIN lf ON lf.col0 = il.layer AND mod IN (lf.col1, lf.col2, lf.col1 || 's')")
def j16_layer_violations(spark, sf):
    return G.layer_violations(layer_imports(spark, sf))


@query("a36_layer_crosstab", f"WITH {LAYER_IMPORTS_CTE}, {_LAYER_DIM}, {_IN_FILES} SELECT il.layer AS src_layer, l.layer AS dst_layer, count(*) AS imports FROM il, (SELECT DISTINCT col0 AS layer FROM ld) l WHERE l.layer <> il.layer AND EXISTS (SELECT 1 FROM ld WHERE ld.col0 = l.layer AND mod IN (ld.col1, rtrim(ld.col1, 's'))) GROUP BY ALL")
def a36_layer_crosstab(spark, sf):
    return G.layer_crosstab(layer_imports(spark, sf))


@query("j17_forbidden_import_lines", over_lines(rf"""SELECT repo, path, line_no, top_dir, module FROM lines JOIN ({sql_values([(d, w) for d, ws in code_rules.CANNOT_IMPORT.items() for w in ws])}) r(top_dir, module)
  ON r.top_dir = string_split(path, '/')[1] WHERE regexp_matches(line, '^\s*(import |from )') AND (contains(line, 'import ' || module) OR contains(line, 'from ' || module))"""))
def j17_forbidden_import_lines(spark, sf):
    return G.forbidden_import_lines(L.to_lines(code_files(spark, sf))).withColumn("line_no", F.col("line_no").cast("long"))
