"""Model tables derived from the given tables, in Spark and as SQL CTEs.

``code_files`` turns every document into one source file: each sentence picks a
template line by its length, position and document id, so the corpus holds as
many lines as the documents hold sentences.  It is one map over ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lintlake.plans.registry import sql_list

# ``{n}`` is replaced by a digit, ``{t}`` by the sentence itself.
PY_LINES = [
    "import os",
    "import requests",
    "from django.db import models",
    "from services.billing import charge_{n}",
    "from fastapi import APIRouter, Depends",
    "import json",
    "# TODO {t}",
    "# FIXME tidy step {n}",
    "# {t}",
    'password = "hunter{n}secret"',
    'aws_key = "AKIAABCDEFGHIJKLMNO{n}"',
    'token = "ghp_abcdefghijklmnopqrstuvwxyz012345678{n}"',
    'cursor.execute(f"SELECT * FROM t{n} WHERE id = {item}")',
    'cursor.execute("SELECT 1")',
    'sql_{n} = "SELECT a FROM t WHERE b = " + str({n})',
    'rows_{n} = User.objects.raw(f"SELECT {name}")',
    'User.objects.filter("x = %s" % {n})',
    'db.execute("SELECT {}".format({n}))',
    '# cursor.execute(f"skip {x}")',
    '@app.route("/items/{n}")\ndef list_{n}():\n    return json.loads("[]")',
    '@router.get("/users/{n}")\nasync def get_user_{n}(user=Depends(get_current_user)):\n    return await fetch_user(user)',
    "async def load_{n}(x):\n    y = await fetch(x)\n    return y",
    "async def safe_{n}(x):\n    try:\n        return await fetch(x)\n    except ValueError:\n        return None",
    "def helper_{n}(a, b=1):\n    if a and b:\n        return a\n    return missing_call_{n}(b)",
    "class Scheduler{n}:\n    def run(self):\n        pass\n    def stop(self):\n        return helper_{n}(1, 2)",
    'api_key = "sk-abcdefghijklmnopqrstuv{n}"',
    'path = "~/.ssh/"',
    'home = "/srv/data/.aws/"',
    "asyncio.create_task(load_{n}(1))",
    'print("ok", {n})',
    "value_{n} = compute(1) if True else 2",
    "for i in range({n}):\n    if i > 1 or i < 0:\n        print(i)\nwhile False:\n    pass",
    'r = httpx.get("/health")',
    "data = json.loads(body_{n})",
    '__all__ = ["helper_{n}", "gone_{n}"]',
    "",
    'secret = "your_secret_{n}"',
    'key = os.environ["API_KEY"]',
    "answer = JSONResponse(status_code=200)",
    "# step one\n# step two\n# step three\n# step four",
    "def heavy_{n}(a):\n" + "".join(f"    if a == {i} and a:\n        for b in a:\n            print(b)\n" for i in range(6)) + "    return a",
    "def early_{n}(a):\n    if a: print(a); return 1\n    return 2",
    "async def drop_{n}():\n    await fetch_rows(1)\n    load_{n}(2)",
    "def sync_{n}():\n    load_{n}(3)",
    "from core.store import Store\nfrom utils.text import clean",
    "def calculate_{n}(db):\n    return db.total",
    "request.json()",
    "from pydantic import BaseModel",
    '@router.post("/orders/{n}", response_model=Order)\nasync def post_order_{n}(token):\n    return {"ok": token}',
    '@router.delete("/orders/{n}", status_code=200)\ndef drop_order_{n}():\n    pass',
    "class Engine{n}(Base):\n    def start(self):\n        pass",
]
TS_LINES = [
    "const a{n}: any = load();",
    "let m: any[] = [];",
    "// note: why we debounce {n}",
    "const run = debounce(() => go(), 50);",
    "// race condition note",
    "const handleStop = () => {",
    "}",
    "pendingMessageRef.current = null;",
    "busyClearTimeoutRef.current = setTimeout(f, 800);",
    "lineCompletePendingRef.current = true;",
    "// timing: interrupt pending flow",
    "for (const x of items) {",
    "  out.push(items.map(y => y + 1));",
    "const c = JSON.parse(JSON.stringify(obj));",
    'document.querySelector("#x{n}");',
    "await save(x);",
    "const p = new Promise((r) => r(1));",
    "fetchData().then((r) => r);",
    "  .catch((e) => log(e));",
    "try { f(); } catch (e) { }",
    'console.warn("error here", e);',
    "catch (err) { // ignore",
    'user!.name = "x";',
    "if (a != b) { }",
    'const s = "what: any";',
    "// @ts-ignore x: any",
    "export function tool{n}(a) {",
    "tool{n}(1);",
    "export const K{n} = 1;",
    "useEffect(() => { run(); });",
    'app.get("/x", handler);',
    "requireAuth(token);",
    "interface I{n} { a: string }",
    "type T{n} = string;",
    "const z = a ? b : c ? d : e;",
    "const zz = a ? b : c ? d : e ? f : g ? h : i;",
    "// TODO {t}",
    'import { x } from "y";',
    "// eslint-disable-next-line",
    "function handleSubmit(e) {",
    "  return x;",
    "",
    "// {t}",
    "throttle(save, {n});",
    "isDuplicate = check(x);",
]
GO_LINES = [
    "cache{n}: map[string]int{}",
    'cache{n}["k"] = {n}',
    "mu.Lock()",
    "mu.Unlock()",
    "func read{n}(p string) (v int, err error) {",
    "if err != nil { return err }",
    'panic("bad {n}")',
    "go func() {",
    "ctx := context.Context(nil)",
    "for {",
    "select {",
    "select { default:",
    'r.GET("/x{n}", h)',
    "auth := token(c)",
    "func Exported{n}() {",
    "type Shape{n} struct {",
    "Exported{n}()",
    "}",
    "// {t}",
    "// TODO {t}",
    "x := 1",
    "",
    "var Total{n} int",
    'app.Get("/y", h)',
    "x = 2",
    "import fmt",
]
TOP_DIRS = ["api", "services", "repositories", "core", "utils", "tests", "views", "routers", ".codex", "auth/manager"]
FILE_NAMES = ["views", "user_router", "router", "helper", "test_item", "engine_bridge", "main"]
EXTENSIONS = ["py", "ts", "go"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its zone-less timestamps are UTC instants, so the session zone is pinned to UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    naive = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition a scan that has fewer splits than the cluster has cores (a small or single-row-group file).

    Scans of large tables have many splits and stay as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), "doc_id")


def _pick(items: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(i) for i in items]), (index + 1).cast("int"))


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files(doc_id, repo, path, ext, content): one derived source file per document."""
    doc = F.col("doc_id")
    sentences = F.split(F.translate("text", "\n", " "), "\\. ")

    def body(lines: list[str]) -> Column:
        templates = F.array(*[F.lit(line) for line in lines])

        def render(sentence: Column, i: Column) -> Column:
            n = F.length(sentence)
            slot = ((n * 7 + i * 13 + doc * 3) % len(lines) + 1).cast("int")
            line = F.replace(F.element_at(templates, slot), F.lit("{n}"), (n % 7).cast("string"))
            return F.replace(line, F.lit("{t}"), sentence)

        return F.array_join(F.transform(sentences, render), "\n")

    ext = _pick(EXTENSIONS, doc % 3)
    path = F.concat(
        _pick(TOP_DIRS, F.floor(doc / 3) % 10), F.lit("/m"), doc.cast("string"), F.lit("/"),
        _pick(FILE_NAMES, doc % 7), F.lit("."), ext,
    )
    content = F.when(doc % 3 == 0, body(PY_LINES)).when(doc % 3 == 1, body(TS_LINES)).otherwise(body(GO_LINES))
    return documents(spark, sf_dir).select(
        "doc_id", F.col("source").alias("repo"), path.alias("path"), ext.alias("ext"), content.alias("content")
    )


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files(repo, path, ext, content) holding the documents as they are."""
    return documents(spark, sf_dir).select(
        F.col("source").alias("repo"),
        F.concat_ws("", "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang").alias("path"),
        F.col("lang").alias("ext"),
        F.col("text").alias("content"),
    )


def _sql_body(lines: list[str]) -> str:
    tpl = sql_list(lines).replace("\n", "' || chr(10) || '")
    return (
        f"array_to_string(list_transform(string_split(replace(text, chr(10), ' '), '. '), lambda p, i: "
        f"replace(replace(({tpl})[1 + ((length(p) * 7 + (i - 1) * 13 + doc_id * 3) % {len(lines)})], "
        "'{n}', CAST(length(p) % 7 AS VARCHAR)), '{t}', p)), chr(10))"
    )


_SQL_EXT = f"({sql_list(EXTENSIONS)})[1 + (doc_id % 3)]"
FILES_CTE = f"""files AS (SELECT doc_id, source AS repo,
  ({sql_list(TOP_DIRS)})[1 + ((doc_id // 3) % 10)] || '/m' || doc_id || '/' || ({sql_list(FILE_NAMES)})[1 + (doc_id % 7)]
    || '.' || {_SQL_EXT} AS path, {_SQL_EXT} AS ext,
  CASE doc_id % 3 WHEN 0 THEN {_sql_body(PY_LINES)} WHEN 1 THEN {_sql_body(TS_LINES)} ELSE {_sql_body(GO_LINES)} END AS content
  FROM documents)"""
DOC_FILES_CTE = """files AS (SELECT source AS repo, source || '/' || doc_id || '.' || lang AS path, lang AS ext, text AS content
  FROM documents)"""
LINES_CTE = """lines AS (SELECT repo, path, ext, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS line_no, len(ls) AS n_lines
  FROM (SELECT repo, path, ext, string_split(content, chr(10)) AS ls FROM files))"""


def over_files(select: str, docs: bool = False) -> str:
    """SQL text running ``select`` over ``files``."""
    return f"WITH {DOC_FILES_CTE if docs else FILES_CTE} {select}"


def over_lines(select: str, docs: bool = False, ctes: str = "") -> str:
    """SQL text running ``select`` over ``lines``; ``ctes`` adds further named tables."""
    extra = f", {ctes}" if ctes else ""
    return f"WITH {DOC_FILES_CTE if docs else FILES_CTE}, {LINES_CTE}{extra} {select}"
