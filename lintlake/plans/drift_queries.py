"""Drift and contract queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.operators import contracts as C, drift as D
from lintlake.plans.corpus import FILES_CTE, code_files, spread, table
from lintlake.plans.registry import query
from lintlake.plans.scoring_queries import _pick
from lintlake.session import work_path
from lintlake.sources.trees import store_tree, tree_changes

CUR_CTE = f"""{FILES_CTE}, cur_files AS (SELECT repo, path, ext, CASE doc_id % 6 WHEN 0 THEN content || chr(10) || content WHEN 1 THEN content || chr(10) || content || chr(10) || content || chr(10) || content
  WHEN 3 THEN substr(content, 1, CAST(length(content) // 3 AS BIGINT)) WHEN 5 THEN content || chr(10) || '# x' ELSE content END AS content FROM files WHERE doc_id % 6 NOT IN (2, 3, 4) OR repo > 'src15'),
  base AS (SELECT repo, path, substr(sha256(content), 1, 16) AS content_hash, CAST(len(string_split(content, chr(10))) AS BIGINT) AS line_count FROM files),
  cur AS (SELECT repo, path, substr(sha256(content), 1, 16) AS content_hash, CAST(len(string_split(content, chr(10))) AS BIGINT) AS line_count FROM cur_files)"""
_GROWTH = """growth AS (SELECT repo, path, b.line_count AS base_lines, c.line_count AS cur_lines, (c.line_count - b.line_count) * 100.0::DOUBLE / b.line_count AS change_pct
  FROM cur c JOIN base b USING (repo, path) WHERE b.line_count > 0)"""


def base_and_cur(spark, sf):
    files = code_files(spark, sf)
    doc, text = F.col("doc_id"), F.col("content")

    def twice(n):
        return F.array_join(F.array_repeat("content", n), "\n")

    content = (
        F.when(doc % 6 == 0, twice(2)).when(doc % 6 == 1, twice(4))
        .when(doc % 6 == 3, F.substring(text, F.lit(1), F.floor(F.length(text) / 3).cast("int")))
        .when(doc % 6 == 5, F.concat(text, F.lit("\n# x"))).otherwise(text)
    )
    cur = files.filter("doc_id % 6 NOT IN (2, 3, 4) OR repo > 'src15'").withColumn("content", content)
    return files, cur


def snapshots(spark, sf):
    base, cur = base_and_cur(spark, sf)
    return D.snapshot(base), D.snapshot(cur)


@query("f1_content_snapshot", f"WITH {CUR_CTE} SELECT * FROM cur")
def f1_content_snapshot(spark, sf):
    return snapshots(spark, sf)[1]


@query("j1_changed_files", f"WITH {CUR_CTE} SELECT repo, path, b.content_hash AS base_hash, c.content_hash AS cur_hash FROM cur c JOIN base b USING (repo, path) WHERE b.content_hash <> c.content_hash")
def j1_changed_files(spark, sf):
    base, cur = snapshots(spark, sf)
    return D.changed_files(cur, base)


@query("j1_tree_changes", f"""WITH {CUR_CTE} SELECT * FROM (SELECT repo, path, CASE WHEN b.content_hash IS NULL THEN 'added' WHEN c.content_hash IS NULL THEN 'removed' WHEN b.content_hash <> c.content_hash THEN 'modified' END AS change,
  b.content_hash AS base_hash, c.content_hash AS cur_hash FROM cur c FULL JOIN base b USING (repo, path)) WHERE change IS NOT NULL""")
def j1_tree_changes(spark, sf):
    base, cur = (store_tree(snap, work_path(spark, "tree")) for snap in snapshots(spark, sf))
    return tree_changes(base, cur)


@query("j2_grown_files", f"""WITH {CUR_CTE}, {_GROWTH} SELECT repo, path, base_lines, cur_lines, change_pct, CASE WHEN change_pct > 100 THEN 'high' ELSE 'medium' END AS level,
  CASE WHEN change_pct > 200 THEN 'split into modules now' WHEN change_pct > 100 THEN 'review the file''s responsibilities' ELSE 'refactor regularly' END AS advice FROM growth WHERE change_pct > 50""")
def j2_grown_files(spark, sf):
    base, cur = snapshots(spark, sf)
    return D.growth(cur, base)


_SUBSYSTEM = r"""subs AS (SELECT repo, path, trim(regexp_extract(h, 'class\s+([^(]+?)\s*\(', 1)) AS class_name FROM (SELECT repo, path,
  list_filter(string_split(content, chr(10)), lambda l: regexp_matches(l, '^\s*class [^_(][^(]*\('))[1] AS h FROM files
  WHERE regexp_matches(lower(regexp_replace(path, '\.[^./]*$', '')), 'manager|engine|bridge|handler|service|provider|agent')) WHERE h IS NOT NULL)"""


@query("j3_subsystem_spikes", f"""WITH {CUR_CTE}, {_GROWTH}, {_SUBSYSTEM}
  SELECT repo, path, base_lines, cur_lines, change_pct, class_name FROM growth JOIN subs USING (repo, path) WHERE abs(change_pct) > 50""")
def j3_subsystem_spikes(spark, sf):
    files, _ = base_and_cur(spark, sf)
    base, cur = snapshots(spark, sf)
    return D.subsystem_spikes(files, cur, base)


_TOTALS = """b AS (SELECT repo, count(*) AS base_files, CAST(sum(line_count) AS BIGINT) AS base_lines FROM base GROUP BY repo), c AS (SELECT repo, count(*) AS file_count, CAST(sum(line_count) AS BIGINT) AS total_lines FROM cur GROUP BY repo)"""


@query("a27_snapshot_drift", f"""WITH {CUR_CTE}, {_TOTALS} SELECT * FROM (SELECT repo, file_count, base_files, total_lines, base_lines, unnest([CASE WHEN file_count < base_files * 0.9 THEN 'file_count_drop'
  WHEN file_count > base_files * 1.3 THEN 'file_count_surge' END, CASE WHEN total_lines < base_lines * 0.9 THEN 'line_count_drop' END]) AS kind FROM b JOIN c USING (repo)) WHERE kind IS NOT NULL""")
def a27_snapshot_drift(spark, sf):
    base, cur = snapshots(spark, sf)
    return D.totals_drift(cur, base)


@query("a27_snapshot_totals", f"WITH {CUR_CTE}, {_TOTALS} SELECT * FROM c")
def a27_snapshot_totals(spark, sf):
    return D.snapshot_totals(snapshots(spark, sf)[1])


@query("t1_capped_growth_report", f"""WITH {CUR_CTE}, {_GROWTH}, g AS (SELECT *, CASE WHEN change_pct > 100 THEN 'high' ELSE 'medium' END AS level FROM growth WHERE change_pct > 50),
  r AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY change_pct DESC, path) AS k, count(*) OVER (PARTITION BY level) AS n FROM g)
  SELECT level, path, 0::BIGINT AS more FROM r WHERE k <= 3 UNION ALL SELECT DISTINCT level, '', n - 3 FROM r WHERE n > 3""")
def t1_capped_growth_report(spark, sf):
    base, cur = snapshots(spark, sf)
    return D.capped_report(D.growth(cur, base), "level", {"high": 3, "medium": 3}, [F.desc("change_pct"), F.col("path")])


@query("a33_drift_score", f"""WITH {CUR_CTE}, {_GROWTH}, k AS (SELECT repo, CASE WHEN change_pct > 100 THEN 20 ELSE 10 END AS cost FROM growth WHERE change_pct > 50
  UNION ALL SELECT repo, 2 FROM cur c JOIN base b USING (repo, path) WHERE b.content_hash <> c.content_hash)
  SELECT repo, CAST(greatest(100 - sum(cost), 0) AS BIGINT) AS score FROM k GROUP BY repo""")
def a33_drift_score(spark, sf):
    base, cur = snapshots(spark, sf)
    grown = D.growth(cur, base).select("repo", F.concat("level", F.lit("_entropy")).alias("kind"))
    changed = D.changed_files(cur, base).select("repo", F.lit("file_content_changed").alias("kind"))
    return D.drift_score(grown.unionByName(changed))


# --- symbols ----------------------------------------------------------------------------------

SYMBOLS_CTE = """symbols AS (SELECT 'r' || (l_suppkey % 5) AS repo, 'm' || l_suppkey || '.py' AS path, 'f' || (l_partkey % 400) AS name, l_discount > 0.03 AS in_old, l_discount < 0.07 AS in_new,
    l_linenumber AS line_no, l_returnflag = 'A' AS is_async, CAST(CAST(l_quantity AS BIGINT) % 9 AS VARCHAR) AS sig, CAST(l_orderkey % 10 AS VARCHAR) AS body FROM lineitem),
  olds AS (SELECT repo, path, name, max(line_no) AS line_no, bool_or(is_async) AS is_async, max(sig) AS signature, max(body) AS body_hash FROM symbols WHERE in_old GROUP BY ALL),
  news AS (SELECT repo, path, name, max(line_no) AS line_no, bool_or(is_async) AS is_async, max(sig) AS signature, max(body) AS body_hash FROM symbols WHERE in_new GROUP BY ALL)"""


def symbol_tables(spark, sf):
    def s(c):
        return F.col(c).cast("string")

    rows = spread(table(spark, sf, "lineitem"), "l_orderkey").select(
        F.concat(F.lit("r"), (F.col("l_suppkey") % 5).cast("string")).alias("repo"),
        F.concat(F.lit("m"), s("l_suppkey"), F.lit(".py")).alias("path"),
        F.concat(F.lit("f"), (F.col("l_partkey") % 400).cast("string")).alias("name"),
        "l_discount", "l_linenumber", (F.col("l_returnflag") == "A").alias("is_async"),
        (F.col("l_quantity").cast("long") % 9).cast("string").alias("sig"), (F.col("l_orderkey") % 10).cast("string").alias("body"),
    )

    def side(cond):
        return rows.filter(cond).groupBy("repo", "path", "name").agg(
            F.max("l_linenumber").alias("line_no"), F.bool_or("is_async").alias("is_async"), F.max("sig").alias("signature"),
            F.max("body").alias("body_hash"),
        )

    return side("l_discount > 0.03"), side("l_discount < 0.07")


_DIFF = """d AS (SELECT repo, path, name, o.path IS NULL AS no_old, n.path IS NULL AS no_new, o.is_async AS oa, n.is_async AS na, o.line_no AS ol, n.line_no AS nl,
  o.body_hash AS ob, n.body_hash AS nb, o.signature AS os, n.signature AS ns FROM olds o FULL JOIN news n USING (repo, path, name))"""


@query("j4_symbol_diff", f"""WITH {SYMBOLS_CTE}, {_DIFF} SELECT * FROM (SELECT repo, path, name, CASE WHEN no_old THEN 'added' WHEN no_new THEN 'deleted' WHEN oa <> na THEN 'async_signature'
  WHEN ol <> nl OR ob <> nb THEN 'modified' END AS change_type FROM d) WHERE change_type IS NOT NULL""")
def j4_symbol_diff(spark, sf):
    return D.diff_symbols(*symbol_tables(spark, sf))


_FUNCS = """fx AS (SELECT *, CASE WHEN detail IN ('signature', 'body') THEN 'modified' ELSE detail END AS change_type FROM (SELECT repo, path, name, CASE WHEN no_old THEN 'added' WHEN no_new THEN 'deleted'
  WHEN os <> ns THEN 'signature' WHEN ob <> nb THEN 'body' END AS detail FROM d) WHERE detail IS NOT NULL)"""


@query("j5_function_diff", f"WITH {SYMBOLS_CTE}, {_DIFF}, {_FUNCS} SELECT * FROM fx")
def j5_function_diff(spark, sf):
    return D.diff_functions(*symbol_tables(spark, sf))


@query("j5_global_diff", f"""WITH {SYMBOLS_CTE} SELECT *, 'added' AS change_type, 'global' AS detail FROM (SELECT repo, path, name FROM news EXCEPT SELECT repo, path, name FROM olds)
  UNION ALL SELECT *, 'deleted', 'global' FROM (SELECT repo, path, name FROM olds EXCEPT SELECT repo, path, name FROM news)""")
def j5_global_diff(spark, sf):
    return D.diff_names(*symbol_tables(spark, sf), "global")


@query("j5_import_diff", f"""WITH {SYMBOLS_CTE}, oi AS (SELECT repo, path, 'pkg' || signature AS module, name, NULLIF(body_hash, '3') AS alias FROM olds), ni AS (SELECT repo, path, 'pkg' || signature AS module, name, NULLIF(body_hash, '3') AS alias FROM news)
  SELECT repo, path, module AS name, 'added' AS change_type, 'import' AS detail FROM (SELECT repo, path, module FROM ni EXCEPT SELECT repo, path, module FROM oi)
  UNION ALL SELECT repo, path, module, 'deleted', 'import' FROM (SELECT repo, path, module FROM oi EXCEPT SELECT repo, path, module FROM ni)
  UNION ALL SELECT repo, path, module || '.' || name, 'added', 'import' FROM (SELECT repo, path, module, name, alias FROM ni EXCEPT SELECT repo, path, module, name, alias FROM oi) x
    WHERE EXISTS (SELECT 1 FROM oi WHERE oi.path = x.path AND oi.repo = x.repo AND oi.module = x.module)""")
def j5_import_diff(spark, sf):
    def imports(df):
        return df.select("repo", "path", F.concat(F.lit("pkg"), "signature").alias("module"), "name", F.nullif("body_hash", F.lit("3")).alias("alias"))

    old, new = symbol_tables(spark, sf)
    return D.diff_imports(imports(old), imports(new))


@query("a39_change_rollup", f"""WITH {SYMBOLS_CTE}, {_DIFF}, {_FUNCS} SELECT repo, count(*) AS total, count(*) FILTER (WHERE change_type = 'added') AS added, count(*) FILTER (WHERE change_type = 'modified') AS modified,
  count(*) FILTER (WHERE change_type = 'deleted') AS deleted, count(DISTINCT path) AS affected_files, CASE WHEN count(*) FILTER (WHERE change_type = 'modified') > 10 THEN 'high'
  WHEN count(*) FILTER (WHERE change_type = 'modified') > 5 THEN 'medium' ELSE 'low' END AS risk FROM fx GROUP BY repo""")
def a39_change_rollup(spark, sf):
    return D.change_rollup(D.diff_functions(*symbol_tables(spark, sf)))


# --- diff statistics --------------------------------------------------------------------------

NUMSTAT_CTE = """ns AS (SELECT l_orderkey AS change_id, CASE WHEN l_linenumber % 5 = 0 THEN '-' ELSE CAST(CAST(l_quantity AS BIGINT) * 2 % 70 AS VARCHAR) END AS a,
    CASE WHEN l_linenumber % 5 = 0 THEN '-' ELSE CAST(l_partkey % 3 * 25 AS VARCHAR) END AS r, 'src/f' || l_partkey || '.py' AS path FROM lineitem),
  stats AS (SELECT *, CASE WHEN removed = 0 THEN 'added' WHEN added = 0 THEN 'deleted' ELSE 'modified' END AS change_type FROM (
    SELECT change_id, coalesce(TRY_CAST(a AS BIGINT), 0) AS added, coalesce(TRY_CAST(r AS BIGINT), 0) AS removed, path FROM ns) WHERE added > 0 OR removed > 0)"""


def numstat_lines(spark, sf):
    binary = F.col("l_linenumber") % 5 == 0
    a = F.when(binary, "-").otherwise((F.col("l_quantity").cast("long") * 2 % 70).cast("string"))
    r = F.when(binary, "-").otherwise((F.col("l_partkey") % 3 * 25).cast("string"))
    path = F.concat(F.lit("src/f"), F.col("l_partkey").cast("string"), F.lit(".py"))
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("change_id"), F.concat_ws("\t", a, r, path).alias("line"))


@query("s6_numstat", f"WITH {NUMSTAT_CTE} SELECT * FROM stats")
def s6_numstat(spark, sf):
    return D.read_numstat(numstat_lines(spark, sf))


@query("a40_diff_size_gate", f"""WITH {NUMSTAT_CTE} SELECT change_id, '' AS path, 'too_many_files' AS kind, count(*) AS n FROM stats GROUP BY change_id HAVING count(*) > 3
  UNION ALL SELECT change_id, path, 'too_many_lines', added + removed FROM stats WHERE added + removed > 100""")
def a40_diff_size_gate(spark, sf):
    return D.diff_size_gate(D.read_numstat(numstat_lines(spark, sf)))


@query("m9_compared_snapshots", """WITH s AS (SELECT 'r' || l_partkey AS repo, 'v' || (l_linenumber % 3) AS snapshot_id, CAST(max(CAST(l_quantity AS BIGINT)) AS VARCHAR) AS score,
    CAST(min(l_discount) < 0.01 AS VARCHAR) AS passed, max(l_returnflag) AS description FROM lineitem GROUP BY ALL),
  u AS (SELECT repo, snapshot_id, unnest(['score', 'passed', 'description']) AS field, unnest([score, passed, description]) AS value FROM s)
  SELECT a.repo, a.field, a.value AS from_value, b.value AS to_value FROM u a JOIN u b ON a.repo = b.repo AND a.field = b.field WHERE a.snapshot_id = 'v0' AND b.snapshot_id = 'v1' AND a.value <> b.value""")
def m9_compared_snapshots(spark, sf):
    snaps = table(spark, sf, "lineitem").groupBy(
        F.concat(F.lit("r"), F.col("l_partkey").cast("string")).alias("repo"),
        F.concat(F.lit("v"), (F.col("l_linenumber") % 3).cast("string")).alias("snapshot_id"),
    ).agg(
        F.max(F.col("l_quantity").cast("long")).alias("score"), (F.min("l_discount") < 0.01).alias("passed"),
        F.max("l_returnflag").alias("description"),
    )
    return D.compare_named(snaps, "v0", "v1")


# --- contracts --------------------------------------------------------------------------------

FIELDS_CTE = """raw_fields AS (SELECT 's' || (l_suppkey % 20) AS service, (['GET', 'POST', 'PUT'])[1 + (l_partkey % 3)] AS method, '/p' || (l_partkey % 60) AS endpoint,
    CASE WHEN l_linenumber % 2 = 0 THEN 'request' ELSE 'response' END AS side, 'f' || (l_orderkey % 12) AS field, l_returnflag, l_linestatus, l_discount, l_tax, l_linenumber FROM lineitem),
  of AS (SELECT service, method, endpoint, side, field, max(l_returnflag) AS type, NULLIF(min(l_linestatus), 'F') AS format, bool_or(l_tax > 0.05) AS required, 200 + max(l_linenumber) % 2 AS status_code FROM raw_fields WHERE l_discount > 0.01 GROUP BY ALL),
  nf AS (SELECT service, method, endpoint, side, field, min(l_returnflag) AS type, NULLIF(max(l_linestatus), 'O') AS format, bool_or(l_tax > 0.06) AS required, 200 + min(l_linenumber) % 2 AS status_code FROM raw_fields WHERE l_discount < 0.09 AND endpoint <> '/p7' GROUP BY ALL)"""


def field_tables(spark, sf):
    def s(c):
        return c.cast("string")

    raw = spread(table(spark, sf, "lineitem"), "l_orderkey").select(
        F.concat(F.lit("s"), s(F.col("l_suppkey") % 20)).alias("service"), _pick(["GET", "POST", "PUT"], F.col("l_partkey") % 3).alias("method"),
        F.concat(F.lit("/p"), s(F.col("l_partkey") % 60)).alias("endpoint"),
        F.when(F.col("l_linenumber") % 2 == 0, "request").otherwise("response").alias("side"),
        F.concat(F.lit("f"), s(F.col("l_orderkey") % 12)).alias("field"), "l_returnflag", "l_linestatus", "l_discount", "l_tax", "l_linenumber",
    )
    key = ["service", "method", "endpoint", "side", "field"]
    old = raw.filter("l_discount > 0.01").groupBy(*key).agg(
        F.max("l_returnflag").alias("type"), F.nullif(F.min("l_linestatus"), F.lit("F")).alias("format"),
        F.bool_or(F.col("l_tax") > 0.05).alias("required"), (F.max("l_linenumber") % 2 + 200).alias("status_code"),
    )
    new = raw.filter("l_discount < 0.09 AND endpoint <> '/p7'").groupBy(*key).agg(
        F.min("l_returnflag").alias("type"), F.nullif(F.max("l_linestatus"), F.lit("O")).alias("format"),
        F.bool_or(F.col("l_tax") > 0.06).alias("required"), (F.min("l_linenumber") % 2 + 200).alias("status_code"),
    )
    return old, new


#: The count and sums of four parts of the leaf hashes ``h``.
_MULTISET = "substr(sha256(concat_ws('|', count(h), " + ", ".join(f"sum(CAST('0x' || substr(h, {at}, 15) AS BIGINT))" for at in (1, 16, 31, 46)) + ")), 1, 16)"


def _digest_sql(source: str) -> str:
    leaf = "sha256(concat_ws('|', side, field, coalesce(type, ''), coalesce(format, ''), CAST(required AS VARCHAR)))"
    return f"""(SELECT service, method, endpoint, {_MULTISET} AS schema_hash, max(status_code) AS status_code FROM (SELECT *, {leaf} AS h FROM {source}) GROUP BY service, method, endpoint)"""


#: The hash of all leaf hashes ``h`` in order, in buckets of their first digits ``b``.
_ORDERED = "substr(sha256(string_agg(h, '' ORDER BY b)), 1, 16)"


def _tree_sql(source: str) -> str:
    leaf = "sha256(concat_ws('|', side, field, coalesce(type, ''), coalesce(format, ''), CAST(required AS VARCHAR)))"
    return f"""(SELECT service, method, endpoint, {_ORDERED} AS schema_hash, max(status_code) AS status_code FROM (
      SELECT service, method, endpoint, substr(h, 1, 3) AS b, sha256(string_agg(h, '' ORDER BY h)) AS h, max(status_code) AS status_code FROM (SELECT *, {leaf} AS h FROM {source}) GROUP BY ALL) GROUP BY service, method, endpoint)"""


def contract_table(fields):
    leafed = fields.withColumn("_leaf", C.field_digest())
    hashes = C.tree_hash(leafed, C.ENDPOINT, "_leaf", "schema_hash")
    return hashes.join(fields.groupBy(*C.ENDPOINT).agg(F.max("status_code").alias("status_code")), C.ENDPOINT)


@query("j6_contract_diff", f"""WITH {FIELDS_CTE}, o AS {_digest_sql('of')}, n AS {_digest_sql('nf')} SELECT * FROM (SELECT service, method, endpoint, CASE WHEN o.schema_hash IS NULL THEN 'added' WHEN n.schema_hash IS NULL THEN 'removed'
  WHEN o.schema_hash <> n.schema_hash THEN 'modified' END AS change_type FROM o FULL JOIN n USING (service, method, endpoint)) WHERE change_type IS NOT NULL""")
def j6_contract_diff(spark, sf):
    old, new = field_tables(spark, sf)
    return C.diff_contracts(contract_table(old), contract_table(new))


@query("a45_baseline_hash", f"""WITH {FIELDS_CTE}, o AS {_tree_sql('of')}, l AS (SELECT service, sha256(concat_ws('|', method, endpoint, CAST(status_code AS VARCHAR), schema_hash)) AS h FROM o)
  SELECT service, {_ORDERED} AS baseline_hash FROM (SELECT service, substr(h, 1, 3) AS b, sha256(string_agg(h, '' ORDER BY h)) AS h FROM l GROUP BY ALL) GROUP BY service""")
def a45_baseline_hash(spark, sf):
    return C.baseline_hash(contract_table(field_tables(spark, sf)[0]))


@query("j7_contract_breaks", f"""WITH {FIELDS_CTE}, j AS (SELECT o.service, o.method, o.endpoint, o.side, o.field, n.field IS NULL AS lost, o.type AS ot, n.type AS nt, o.format AS ofm, n.format AS nfm, o.required AS orq, coalesce(n.required, false) AS nrq
    FROM of o LEFT JOIN nf n ON n.service = o.service AND n.method = o.method AND n.endpoint = o.endpoint AND n.side = o.side AND n.field = o.field
    WHERE EXISTS (SELECT 1 FROM nf x WHERE x.service = o.service AND x.method = o.method AND x.endpoint = o.endpoint)),
  st AS (SELECT service, method, endpoint FROM (SELECT service, method, endpoint, max(status_code) AS a FROM of GROUP BY ALL) JOIN (SELECT service, method, endpoint, max(status_code) AS b FROM nf GROUP BY ALL) USING (service, method, endpoint) WHERE a <> b)
  SELECT service, method, endpoint, field, 'request_field_removed' AS reason FROM j WHERE lost AND side = 'request'
  UNION ALL SELECT service, method, endpoint, field, 'required_removed' FROM j WHERE side = 'request' AND orq AND NOT nrq
  UNION ALL SELECT service, method, endpoint, field, 'response_field_removed' FROM j WHERE lost AND side = 'response'
  UNION ALL SELECT service, method, endpoint, field, side || '_type_changed' FROM j WHERE NOT lost AND ot <> nt
  UNION ALL SELECT service, method, endpoint, field, 'format_changed' FROM j WHERE NOT lost AND side = 'request' AND ofm IS NOT NULL AND ofm IS DISTINCT FROM nfm
  UNION ALL SELECT service, method, endpoint, '', 'status_changed' FROM st""")
def j7_contract_breaks(spark, sf):
    return C.contract_breaks(*field_tables(spark, sf))


@query("u4_removed_fields", f"""WITH {FIELDS_CTE}, d AS (SELECT service, method, endpoint, field FROM of WHERE side = 'request' EXCEPT SELECT service, method, endpoint, field FROM nf WHERE side = 'request')
  SELECT service, method, endpoint, string_agg(field, ',' ORDER BY field) AS removed FROM d WHERE EXISTS (SELECT 1 FROM nf x WHERE x.side = 'request' AND x.service = d.service AND x.method = d.method AND x.endpoint = d.endpoint) GROUP BY ALL""")
def u4_removed_fields(spark, sf):
    return C.removed_fields(*field_tables(spark, sf)).withColumn("removed", F.concat_ws(",", "removed"))


def openapi_docs(spark, sf):
    k = F.col("p_partkey")
    key = k.cast("string")
    schema = F.concat(F.lit('{"application/json":{"schema":{"properties":{"name":{"type":"string"},"size'), (k % 4).cast("string"),
                      F.lit('":{"type":"integer","format":"int64"}},"required":["name"]}}}'))
    doc = F.concat(
        F.lit('{"openapi":"3.0","paths":{"/parts/'), key, F.lit('":{"get":{"summary":"'), "p_name", F.lit('","responses":{"200":{"content":'), schema,
        F.lit('}}},"post":{"requestBody":{"content":'), schema, F.lit('},"responses":{"201":{"content":'), schema,
        F.lit('}}},"head":{"responses":{"200":{}}}},"/size/'), (k % 7).cast("string"), F.lit('":{"delete":{"responses":{"204":{}}}}}}'),
    )
    return table(spark, sf, "part").select("p_brand", F.concat("p_brand", F.lit("-"), key).alias("service"), F.lit("v1").alias("version"), doc.alias("doc"))


@query("s5_openapi_contracts", """SELECT service, 'v1' AS version, method, endpoint, status_code, summary, request_fields, response_fields FROM (
  SELECT p_brand || '-' || p_partkey AS service, 'GET' AS method, '/parts/' || p_partkey AS endpoint, 200 AS status_code, p_name AS summary, 0 AS request_fields, 2 AS response_fields FROM part
  UNION ALL SELECT p_brand || '-' || p_partkey, 'POST', '/parts/' || p_partkey, 201, '', 2, 2 FROM part
  UNION ALL SELECT p_brand || '-' || p_partkey, 'DELETE', '/size/' || (p_partkey % 7), 200, '', 0, 0 FROM part)""")
def s5_openapi_contracts(spark, sf):
    return C.contracts_from_openapi(openapi_docs(spark, sf))


@query("s5_openapi_fields", """WITH o AS (SELECT p_partkey, p_brand || '-' || p_partkey AS service, '/parts/' || p_partkey AS endpoint FROM part),
  m AS (SELECT * FROM o, (VALUES ('GET', 'response'), ('POST', 'request'), ('POST', 'response')) t(method, side))
  SELECT service, method, endpoint, side, 'name' AS field, 'string' AS type, '' AS format, true AS required FROM m UNION ALL SELECT service, method, endpoint, side, 'size' || (p_partkey % 4), 'integer', 'int64', false FROM m""")
def s5_openapi_fields(spark, sf):
    return C.contract_fields(openapi_docs(spark, sf)).drop("version").withColumn("format", F.coalesce("format", F.lit("")))
