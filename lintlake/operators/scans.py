"""Corpus rule scans: ``files`` in, findings out.

Every scan is a map over files.  Rules that need neighbouring lines read them
from the file's own row (``lines.line_hits``); no scan shuffles.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from lintlake.operators import lines as L
from lintlake.rules import code_rules as R

LINE_COLS = ("repo", "path", "line_no")


def only_ext(files: DataFrame, *exts: str) -> DataFrame:
    return files.filter(F.col("ext").isin(*exts))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def top_dir(path: Column) -> Column:
    """First path part of a nested path, else null."""
    return F.when(F.instr(path, "/") > 0, F.split(path, "/")[0])


def preview(line: Column) -> Column:
    return F.substring(F.trim(line), 1, 80)


# --- R1-R3: SQL -------------------------------------------------------------------------------

def sql_call(line: Column) -> Column:
    return line.rlike(L.any_of(R.SQL_EXEC))


def interpolation(context: Column) -> Column:
    """Name of the first interpolation pattern in the lines, else null."""
    return L.first_label(F.array_join(context, "\n"), R.INTERPOLATION, L.rlike)


def scan_sql_injection(files: DataFrame) -> DataFrame:
    """An SQL call with interpolation in it or in the 5 lines before; the first pattern names it."""
    found = L.line_hits(files, sql_call, {"ctx": (-5, 0)})
    return found.select(*LINE_COLS, interpolation(F.col("ctx")).alias("kind")).filter("kind IS NOT NULL")


def scan_sql_injection_v2(files: DataFrame) -> DataFrame:
    """R2: more SQL calls, any case; comment lines give no context."""
    pattern = "(?i)" + L.any_of(R.SQL_EXEC_WIDE)
    found = L.line_hits(files, lambda line: line.rlike(pattern), {"ctx": (-5, 0)})
    code = F.filter("ctx", lambda line: ~line.rlike(L.CODE_COMMENT))
    return found.select(*LINE_COLS, interpolation(code).alias("kind")).filter("kind IS NOT NULL")


def scan_orm(files: DataFrame) -> DataFrame:
    """Dangerous ORM calls, one row per (line, pattern)."""
    rules = [("(?i)" + p, label) for p, label in R.ORM_DANGER]
    pattern = L.any_of(p for p, _ in rules)
    found = L.line_hits(files, lambda line: line.rlike(pattern) & ~line.rlike(L.CODE_COMMENT))
    return L.labelled_hits(found, rules, F.col("line")).select(*LINE_COLS, "label")


# --- R4-R7: quick rules -----------------------------------------------------------------------

ROUTE_PACKS = [(("py",), R.ROUTES_PY), (("ts", "js", "tsx", "jsx"), R.ROUTES_TS), (("go",), R.ROUTES_GO)]


def route_line(line: Column) -> Column:
    """Whether a line holds a route marker of the file's language, outside test paths."""
    hit = F.lit(False)
    for exts, routes in ROUTE_PACKS:
        hit = hit | (F.col("ext").isin(*exts) & L.contains_any(line, [w for w, _ in routes]))
    return hit & ~F.lower("path").contains("test")


def route_framework(line: Column) -> Column:
    return F.coalesce(*[
        F.when(F.col("ext").isin(*exts), L.first_label(line, routes, L.contains)) for exts, routes in ROUTE_PACKS
    ])


def scan_auth(files: DataFrame) -> DataFrame:
    """A route whose next 10 lines hold no authentication word, outside test paths."""
    found = L.line_hits(files, route_line, {"ctx": (1, 10)})
    return found.filter(~L.contains_any(F.array_join("ctx", "\n"), R.AUTH_WORDS)).select(
        *LINE_COLS, route_framework(F.col("line")).alias("framework")
    )


def scan_view_orm(files: DataFrame) -> DataFrame:
    """R5."""
    return files.filter(
        (F.col("ext") == "py") & F.col("content").contains("django.db") & F.col("path").contains("views.py")
    ).select("repo", "path")


def scan_hook_deps(files: DataFrame) -> DataFrame:
    """R6."""
    text = F.col("content")
    return files.filter(
        text.contains("useEffect(") & ~text.contains("eslint-disable") & ~text.contains("dependencies")
    ).select("repo", "path")


def scan_async_no_try(files: DataFrame) -> DataFrame:
    """``async def`` with no ``try:`` near; the first ``try:`` inside such a span ends the file's scan."""
    lines = F.split("content", "\n")
    numbered = F.transform(F.col("_lines"), lambda line, i: F.struct((i + 1).alias("no"), line.alias("line")))

    def positions(word: str) -> Column:
        return F.transform(F.filter(numbered, lambda s: s["line"].contains(word)), lambda s: s["no"])

    marked = (
        only_ext(files, "py").filter(F.col("content").contains("async def"))
        .withColumn("_lines", lines)
        .withColumn("_defs", positions("async def"))
        .withColumn("_tries", positions("try:"))
        .withColumn("_n", F.size("_lines"))
    )
    defs, stop = F.col("_defs"), F.col("_stop")
    stops = F.filter("_tries", lambda t: F.exists(defs, lambda d: (d <= t) & (t < d + 20)))
    marked = marked.withColumn("_stop", F.array_min(stops))
    reported = F.filter(
        defs,
        lambda d: (F.col("_n") >= d + 20)
        & ~F.exists(defs, lambda e: (e > d) & (e <= d + 20))
        & (stop.isNull() | (stop > d + 20)),
    )
    return marked.select("repo", "path", F.explode(reported).alias("line_no"))


# --- R8-R11: leaks ----------------------------------------------------------------------------

def secret_line(line: Column) -> Column:
    """Cheap word test first, patterns only where it holds."""
    return (
        L.let(F.lower(line), lambda low: L.contains_any(low, R.SECRET_HINTS))
        & line.rlike(L.any_of(p for _, p, _ in R.SECRETS)) & ~line.rlike(L.COMMENT) & ~line.rlike(R.PLACEHOLDER)
    )


def secret_rules(line: Column) -> list[Column]:
    return [
        F.when(line.rlike(p), F.struct(F.lit(name).alias("rule"), F.lit(level).alias("level"))) for name, p, level in R.SECRETS
    ]


def scan_secrets(files: DataFrame) -> DataFrame:
    """Hard-coded secrets; comments, placeholders and environment reads are no secrets."""
    found = L.line_hits(files, secret_line)
    return found.select(*LINE_COLS, F.inline(F.array_compact(F.array(*secret_rules(F.col("line"))))))


def license_line(line: Column) -> Column:
    return L.let(F.lower(line), lambda low: L.contains_any(low, R.LICENSE_WORDS))


def contact_line(line: Column) -> Column:
    return line.contains("@") & line.rlike(R.EMAIL) | license_line(line)


def contact_rules(line: Column) -> list[Column]:
    return [
        F.when(line.contains("@") & line.rlike(R.EMAIL), F.struct(F.lit("email").alias("rule"), F.lit("MEDIUM").alias("level"))),
        F.when(license_line(line), F.struct(F.lit("license").alias("rule"), F.lit("INFO").alias("level"))),
    ]


def scan_contacts(files: DataFrame) -> DataFrame:
    """Pattern pack for e-mail addresses and licence lines, one row per (line, rule)."""
    found = L.line_hits(files, contact_line)
    return found.select(*LINE_COLS, F.inline(F.array_compact(F.array(*contact_rules(F.col("line")))))).drop("level")


def scan_secrets_and_contacts(files: DataFrame) -> DataFrame:
    """R8 and the contact pack in one pass over the files."""
    found = L.line_hits(files, lambda line: secret_line(line) | contact_line(line))
    line = F.col("line")
    secret = secret_line(line)
    rules = [F.when(secret, rule) for rule in secret_rules(line)] + contact_rules(line)
    return found.select(*LINE_COLS, F.inline(F.array_compact(F.array(*rules))))


def scan_api_key(files: DataFrame) -> DataFrame:
    """R9."""
    return L.line_hits(files, lambda line: line.rlike(R.API_KEY)).select(
        *LINE_COLS, F.regexp_extract("line", f"({R.API_KEY})", 1).alias("key")
    )


def scan_paths(files: DataFrame, home: str = R.HOME) -> DataFrame:
    """Hard-coded sensitive paths, first pattern per line."""
    paths = R.sensitive_paths(home)
    pattern = L.any_of(paths)
    found = L.line_hits(files, lambda line: line.rlike(pattern) & ~line.rlike(L.CODE_COMMENT))
    hit = F.coalesce(*[F.when(F.col("line").rlike(p), F.regexp_extract("line", p, 1)) for p in paths])
    return found.select(*LINE_COLS, hit.alias("hit"), preview(F.col("line")).alias("preview"))


def scan_tool_traces(files: DataFrame) -> DataFrame:
    """Tool leftovers among root entries; one row per (repo, entry, pattern)."""
    entry = F.split("path", "/")[0]
    roots = files.select("repo", entry.alias("entry")).filter(L.contains_any(F.col("entry"), R.TOOL_TRACES)).distinct()
    found = F.array_compact(F.array(*[F.when(F.col("entry").contains(p), F.lit(p)) for p in R.TOOL_TRACES]))
    return roots.select("repo", "entry", F.explode(found).alias("pattern"))


# --- R12-R19: TypeScript ----------------------------------------------------------------------

def scan_any_type(files: DataFrame) -> DataFrame:
    """``any`` types outside strings, once per line."""
    skip = r"^\s*(//|\* )"
    return L.line_hits(
        only_ext(files, "ts"),
        lambda line: L.outside_strings(line).rlike(L.any_of(R.ANY_TYPE)) & ~line.rlike(skip) & ~line.contains("@ts-"),
    ).select(*LINE_COLS, preview(F.col("line")).alias("preview"))


def usage_verdict(found: DataFrame, fail_above: int | None, warn_above: int) -> DataFrame:
    """Totals per repo with the thresholds' verdict."""
    total = F.col("total")
    verdict = F.when(total > warn_above, "warn").otherwise("info")
    if fail_above is not None:
        verdict = F.when(total > fail_above, "fail").otherwise(verdict)
    return (
        found.groupBy("repo")
        .agg(F.count("*").alias("total"), F.countDistinct("path").alias("affected_files"))
        .withColumn("verdict", verdict)
    )


def scan_non_null(files: DataFrame) -> DataFrame:
    """Non-null assertions outside strings; ``!=`` is none."""
    return L.line_hits(
        only_ext(files, "ts"),
        lambda line: L.outside_strings(line).rlike(R.NON_NULL) & ~line.rlike(L.SLASH_COMMENT),
    ).select(*LINE_COLS, preview(F.col("line")).alias("preview"))


def catch_line(line: Column) -> Column:
    return (F.col("ext") == "ts") & line.rlike(L.any_of(p for p, _ in R.CATCH_DANGER)) & ~line.rlike(L.SLASH_COMMENT)


def scan_catch(files: DataFrame) -> DataFrame:
    """R14."""
    return L.labelled_hits(L.line_hits(files, catch_line), R.CATCH_DANGER, F.col("line")).select(*LINE_COLS, "label")


def scan_dedup_doc(files: DataFrame) -> DataFrame:
    """debounce/dedup code with no reason given in it or the 10 lines before."""
    found = L.line_hits(only_ext(files, "ts"), lambda line: line.rlike(L.any_of(R.DEDUP_CODE)), {"ctx": (-10, 0)})
    return found.filter(~L.contains_any(F.lower(F.array_join("ctx", "\n")), R.WHY_WORDS)).select(*LINE_COLS)


def scan_critical_identifiers(files: DataFrame) -> DataFrame:
    """Critical identifiers without their words in the 15 lines before; ``uses`` counts them on the line."""
    names = L.any_of(n for n, _ in R.CRITICAL_IDENTIFIERS)
    found = L.line_hits(only_ext(files, "ts"), lambda line: line.rlike(names), {"ctx": (-15, 0)})
    text = F.lower(F.array_join("ctx", "\n"))
    rows = F.array_compact(F.array(*[
        F.when(
            F.col("line").contains(name) & ~L.contains_any(text, words),
            F.struct(F.lit(name).alias("identifier"), F.regexp_count("line", F.lit(name)).cast("long").alias("uses")),
        )
        for name, words in R.CRITICAL_IDENTIFIERS
    ]))
    return found.select(*LINE_COLS, F.inline(rows))


def scan_critical_functions(files: DataFrame) -> DataFrame:
    """Critical function definitions without a timing word in the 20 lines before."""
    names = "|".join(R.CRITICAL_FUNCTIONS)
    pattern = rf"(const|function)\s+({names})\s*[=(]"
    found = L.line_hits(only_ext(files, "ts"), lambda line: line.rlike(pattern), {"ctx": (-20, 0)})
    return found.filter(~L.contains_any(F.lower(F.array_join("ctx", "\n")), R.TIMING_WORDS)).select(
        *LINE_COLS, F.regexp_extract("line", pattern, 2).alias("function")
    )


def _typed(found: DataFrame, *tests: tuple[Column, str]) -> DataFrame:
    kinds = F.array_compact(F.array(*[F.when(cond, F.lit(kind)) for cond, kind in tests]))
    return found.select(*LINE_COLS, F.explode(kinds).alias("kind"))


def scan_perf(files: DataFrame) -> DataFrame:
    """Array operation near a loop, deep copy by JSON, DOM query."""
    candidates = L.any_of([R.ARRAY_OP, R.DEEP_COPY, R.DOM_QUERY])
    found = L.line_hits(
        only_ext(files, "ts"), lambda line: line.rlike(candidates) & ~line.rlike(L.SLASH_COMMENT), {"ctx": (-20, 0)}
    )
    line = F.col("line")
    return _typed(
        found,
        (line.rlike(R.ARRAY_OP) & L.any_line(F.col("ctx"), R.LOOP), "array_op_in_loop"),
        (line.rlike(R.DEEP_COPY), "deep_copy_anti_pattern"),
        (line.rlike(R.DOM_QUERY), "frequent_dom_query"),
    )


def scan_async_race(files: DataFrame) -> DataFrame:
    """Async in a loop, unawaited promise, ``.then`` without ``.catch``."""
    candidates = L.any_of(["await", "async", r"new\s+Promise\s*\(", r"\.then\s*\("])
    found = L.line_hits(
        only_ext(files, "ts"),
        lambda line: line.rlike(candidates) & ~line.rlike(L.SLASH_COMMENT),
        {"before": (-10, -1), "after": (0, 5)},
    )
    line = F.col("line")
    return _typed(
        found,
        (line.rlike("await|async") & L.any_line(F.col("before"), R.LOOP_CALL), "async_loop_race"),
        (line.rlike(r"new\s+Promise\s*\(") & ~line.contains("await"), "unhandled_promise"),
        (line.rlike(r"\.then\s*\(") & ~L.any_line(F.col("after"), r"\.catch\s*\("), "unhandled_then"),
    )


# --- R20-R22: Go ------------------------------------------------------------------------------

def scan_map_write(files: DataFrame) -> DataFrame:
    """Writes to a map declared in the file with no lock word near."""
    go = only_ext(files, "go").filter(F.col("content").rlike(R.MAP_DECL)).withColumn("_all", F.split("content", "\n"))
    code = F.filter("_all", lambda line: ~line.rlike(L.SLASH_COMMENT))
    names = F.array_distinct(
        F.filter(F.transform(code, lambda line: F.regexp_extract(line, R.MAP_DECL, 1)), lambda n: n != "")
    )
    found = L.line_hits(
        go.withColumn("names", names),
        lambda line: line.rlike(r"\[.*\]\s*=") & ~line.rlike(L.SLASH_COMMENT),
        {"ctx": (-19, 5)},
        keys=("repo", "path", "names"),
    )
    written = F.filter("names", lambda n: F.regexp_like(F.col("line"), F.concat(n, F.lit(r"\s*\[.*\]\s*="))))
    return found.filter(~L.any_line(F.col("ctx"), R.LOCK_WORDS)).select(*LINE_COLS, F.explode(written).alias("map_name"))


def scan_go_errors(files: DataFrame) -> DataFrame:
    """An ``err error)`` result not checked before the next func (50 lines), and ``panic``."""
    found = L.line_hits(
        only_ext(files, "go"),
        lambda line: line.rlike(r"err\s+error\s*\)|\bpanic\s*\(") & ~line.rlike(L.SLASH_COMMENT),
        {"ctx": (1, 50)},
    )
    # the first line that is a check or a func decides
    deciding = F.filter("ctx", lambda line: line.contains("if err != nil") | line.rlike(r"^func\s+\w+"))
    checked = F.coalesce(F.get(deciding, F.lit(0)).contains("if err != nil"), F.lit(False))
    return _typed(
        found,
        (F.col("line").rlike(r"err\s+error\s*\)") & ~checked, "unchecked_error"),
        (F.col("line").rlike(r"\bpanic\s*\("), "panic_usage"),
    )


def scan_goroutines(files: DataFrame) -> DataFrame:
    """A goroutine with no context in the next 30 lines; an endless loop close after one."""
    found = L.line_hits(
        only_ext(files, "go"),
        lambda line: line.rlike(r"go\s+func\s*\(|select\s*\{|for\s*\{") & ~line.rlike(L.SLASH_COMMENT),
        {"after": (1, 30), "before": (-9, 0)},
    )
    line = F.col("line")
    return _typed(
        found,
        (line.rlike(r"go\s+func\s*\(") & ~L.any_line(F.col("after"), r"context\.Context|ctx "), "goroutine_without_context"),
        (
            line.rlike(r"select\s*\{|for\s*\{") & L.any_line(F.col("before"), r"go\s+func\s*\(") & ~line.contains("default:"),
            "potential_goroutine_leak",
        ),
    )


# --- R23-R33: file-level rules ----------------------------------------------------------------

def scan_yagni(files: DataFrame) -> DataFrame:
    """Import volume and open TODOs per file."""
    text = F.col("content")
    py = only_ext(files, "py").select(
        "repo", "path", F.regexp_count("content", F.lit("import ")).alias("imports"),
        F.regexp_count("content", F.lit(R.TODO_PY)).alias("todos"), F.lit(5).alias("import_limit"),
    )
    import_lines = F.size(F.filter(F.split(text, "\n"), lambda line: line.contains("import ") & line.contains("from ")))
    ts = only_ext(files, "ts").select(
        "repo", "path", import_lines.alias("imports"),
        F.regexp_count("content", F.lit(R.TODO_TS)).alias("todos"), F.lit(10).alias("import_limit"),
    )
    too_many = (F.col("imports") > F.col("import_limit")).alias("too_many_imports")
    return py.unionByName(ts).select(
        "repo", "path", F.col("imports").cast("long").alias("imports"), F.col("todos").cast("long").alias("todos"),
        too_many, (F.col("todos") > 3).alias("too_many_todos"),
    ).filter("too_many_imports OR too_many_todos")


def scan_over_abstraction(files: DataFrame) -> DataFrame:
    """Many functions and classes (py, > 20) or interfaces and types (ts, > 10)."""
    def count(pattern: str) -> Column:
        return F.regexp_count("content", F.lit(pattern))

    py = count(r"(?m)^[ \t]*(async[ \t]+)?def[ \t]") + count(r"(?m)^[ \t]*class[ \t]")
    ts = count(r"\binterface\s+\w+") + count(r"\btype\s+\w+")
    n = F.when(F.col("ext") == "py", py).when(F.col("ext") == "ts", ts)
    limit = F.when(F.col("ext") == "py", 20).otherwise(10)
    return files.select("repo", "path", n.cast("long").alias("definitions"), limit.alias("_limit")).filter(
        "definitions > _limit"
    ).drop("_limit")


def scan_stdlib(files: DataFrame) -> DataFrame:
    """Third-party imports with a standard-library alternative."""
    text = F.col("content")
    rows = F.array_compact(F.array(*[
        F.when(
            text.contains(f"import {pkg}") | text.contains(f"from {pkg}"),
            F.struct(F.lit(pkg).alias("package"), F.lit(alt).alias("alternative")),
        )
        for pkg, alt in R.STDLIB_ALTERNATIVES
    ]))
    return only_ext(files, "py").select("repo", "path", F.inline(rows))


def scan_ts_readability(files: DataFrame) -> DataFrame:
    """Deepest nested ternary per file, and the number of ``any`` types with the first line using one."""
    lines = F.col("_lines")
    nesting = F.array_max(F.transform(lines, lambda line: F.regexp_count(line, F.lit(R.NESTED_TERNARY))))
    first = F.array_position(F.transform(lines, lambda line: line.rlike(R.ANY_VOLUME)), F.lit(True))
    anys = F.col("any_count")
    return (
        only_ext(files, "ts").withColumn("_lines", F.split("content", "\n"))
        .select(
            "repo", "path",
            F.when(nesting > 0, nesting + 1).otherwise(0).cast("long").alias("ternary_depth"),
            F.regexp_count("content", F.lit(R.ANY_VOLUME)).cast("long").alias("any_count"),
            first.cast("long").alias("first_any_line"),
        )
        .withColumn("ternary_warn", F.col("ternary_depth") > 2)
        .withColumn("any_level", F.when(anys > 3, "warn").when(anys > 0, "info").otherwise("none"))
        .filter("ternary_warn OR any_level <> 'none'")
    )


def scan_dir_responsibility(files: DataFrame) -> DataFrame:
    """Forbidden words by top directory."""
    top, text = top_dir(F.col("path")), F.col("content")
    rows = F.array_compact(F.array(*[
        F.when((top == d) & text.contains(w), F.struct(F.lit(d).alias("top_dir"), F.lit(w).alias("word")))
        for d, words in R.DIR_FORBIDDEN.items() for w in words
    ]))
    return files.filter(top.isin(*R.DIR_FORBIDDEN)).select("repo", "path", F.inline(rows))


def scan_dir_conflicts(files: DataFrame) -> DataFrame:
    """Business logic in routing directories, HTTP handling in service directories."""
    top, text = top_dir(F.col("path")), F.col("content")
    label = None
    for dirs, words, name in (R.ROUTING_DIRS, R.SERVICE_DIRS):
        cond = top.isin(*dirs) & L.contains_any(text, words)
        label = F.when(cond, name) if label is None else label.when(cond, name)
    return only_ext(files, "py").select("repo", "path", label.alias("conflict")).filter("conflict IS NOT NULL")


def scan_router_naming(files: DataFrame) -> DataFrame:
    """R29."""
    name = file_name(F.col("path"))
    return files.filter(name.contains("router.py") & ~name.endswith("_router.py")).select("repo", "path", name.alias("name"))


def scan_manual_json(files: DataFrame, repo_frameworks: DataFrame) -> DataFrame:
    """JSON parsed by hand in repos that use FastAPI; ``repo_frameworks(repo, framework)``."""
    fastapi = repo_frameworks.filter("framework = 'fastapi'").select("repo").distinct()
    found = L.line_hits(
        files,
        lambda line: (line.contains("json.loads") | line.contains("request.json()"))
        & ~line.rlike(r"^\s*(import |from |#)"),
    )
    return found.join(fastapi, "repo", "left_semi").select(*LINE_COLS)


def framework_usage(files: DataFrame) -> DataFrame:
    """Per file and framework feature, whether it is used (true) or bypassed (false)."""
    t = F.col("content")

    def has(*words: str) -> Column:
        return L.contains_any(t, words)

    caught = has("try:") & has("except")
    routes = sum(F.regexp_count("content", F.lit(rf"@app\.{verb}")) for verb in ("get", "post", "put", "delete"))
    orm = has(".objects.")
    forms = has("forms.Form", "forms.ModelForm", "serializers.", "from rest_framework import serializers")
    schema = has("marshmallow", "BaseModel")
    # (framework, feature, bypassed, used); a bypass wins over a use
    features = [
        ("fastapi", "base_model", has("json.loads", "request.json()") & ~has("BaseModel", "from pydantic import"),
         has("BaseModel", "from pydantic import")),
        ("fastapi", "exception_handler", caught & ~has("@app.exception_handler"), has("@app.exception_handler")),
        ("fastapi", "depends", has("token", "auth", "login", "current_user") & ~has("Depends(", "from fastapi import Depends"),
         has("Depends(", "from fastapi import Depends")),
        ("fastapi", "api_router", has("@app.", "@router.") & ~has("APIRouter") & (routes > 5), has("APIRouter")),
        ("fastapi", "background_tasks",
         has("time.sleep", "asyncio.sleep", "send_email", "process_file") & ~has("BackgroundTasks"), has("BackgroundTasks")),
        ("django", "orm", has("cursor()", "raw(") & orm, orm),
        ("django", "forms", has("is_valid()") & ~forms, forms),
        ("django", "get_object_or_404", has("DoesNotExist", "try:") & ~has("get_object_or_404", "get_list_or_404"),
         has("get_object_or_404", "get_list_or_404")),
        ("flask", "schema", has("request.") & has("json", "form") & ~schema, schema),
        ("flask", "errorhandler", caught & ~has("@app.errorhandler"), has("@app.errorhandler")),
    ]
    rows = F.array_compact(F.array(*[
        F.when(
            bypassed | used,
            F.struct(F.lit(fw).alias("framework"), F.lit(name).alias("feature"), (~bypassed).alias("used")),
        )
        for fw, name, bypassed, used in features
    ]))
    return only_ext(files, "py").select("repo", "path", F.inline(rows))


def scan_simplicity(files: DataFrame, max_lines: int = R.MAX_FILE_LINES) -> DataFrame:
    """R32."""
    n = F.size(F.split("content", "\n")).cast("long")
    return files.select("repo", "path", n.alias("n_lines")).filter(F.col("n_lines") > max_lines)


def keyword_complexity(content: Column) -> Column:
    """1 + the number of (line, keyword) pairs present."""
    def per_line(line: Column) -> Column:
        padded = F.concat(F.lit(" "), F.regexp_replace(line, r"^\s+|\s+$", ""), F.lit(" "))
        return L.let(padded, lambda p: sum((p.contains(f" {w} ").cast("int") for w in R.COMPLEXITY_WORDS), F.lit(0)))

    return (F.aggregate(F.transform(F.split(content, "\n"), per_line), F.lit(1), lambda acc, n: acc + n)).cast("long")


def scan_keyword_complexity(files: DataFrame) -> DataFrame:
    return only_ext(files, "py").select("repo", "path", keyword_complexity(F.col("content")).alias("complexity"))


# --- R34-R37: repo-level and log rules --------------------------------------------------------

def runtime_evidence(files: DataFrame) -> DataFrame:
    """Health endpoints and infrastructure files present per repo."""
    name = file_name(F.col("path"))
    flags = {"has_health": (F.col("ext") == "py") & L.contains_any(F.col("content"), R.HEALTH_PATHS)}
    for group, names in R.INFRA_FILES.items():
        flags[f"has_{group}"] = name.isin(*names)
    return files.groupBy("repo").agg(*[F.bool_or(cond).alias(k) for k, cond in flags.items()])


def missing_key_files(files: DataFrame, required: list[str] = R.KEY_FILES) -> DataFrame:
    """Required names no file of the repo has."""
    name = file_name(F.col("path"))
    present = files.groupBy("repo").agg(
        F.array_compact(F.array(*[F.max(F.when(name == r, r)) for r in required])).alias("present")
    )
    wanted = F.array(*[F.lit(r) for r in required])
    return present.select("repo", F.explode(F.array_except(wanted, "present")).alias("missing"))


def parse_compiler_log(log: DataFrame) -> DataFrame:
    """``file:(line,col):message`` error lines of ``log(line)``."""
    parts = F.split("line", ":")
    return (
        log.filter(F.col("line").contains("error") & (F.size(parts) >= 3))
        .select(
            F.trim(parts[0]).alias("path"),
            F.coalesce(F.expr("try_cast(regexp_extract(split(line, ':')[1], '\\\\(([0-9]+),?.*\\\\)', 1) AS BIGINT)"), F.lit(-1))
            .alias("line_no"),
            F.trim(F.array_join(F.slice(parts, 3, F.size(parts)), ":")).alias("message"),
        )
    )


def node_rules(nodes: DataFrame) -> DataFrame:
    """Dedup and race rules over graph nodes (name, file_path, start_line, signature, docstring)."""
    name, doc = F.col("name"), F.lower(F.coalesce("docstring", F.lit("")))
    sig = F.coalesce("signature", F.lit(""))
    no_why = ~L.contains_any(doc, R.NODE_WHY_WORDS)
    rows = []
    for word in R.NODE_DEDUP_WORDS:
        if word == "isDuplicate":
            rows.append((name.contains(word) & ~L.contains_any(sig, R.NODE_DYNAMIC_WORDS), word, "fixed_window"))
        rows.append((name.contains(word) & no_why, word, "no_reason"))
    for word in R.NODE_RACE_WORDS:
        rows.append((name.contains(word) & ~L.contains_any(doc, R.NODE_TIMING_WORDS), word, "no_timing"))
    found = F.array_compact(F.array(*[
        F.when(cond, F.struct(F.lit(word).alias("keyword"), F.lit(kind).alias("kind"))) for cond, word, kind in rows
    ]))
    return nodes.filter(F.col("file_path").endswith(".ts")).select("id", "file_path", "start_line", F.inline(found))


def async_setter_callers(nodes: DataFrame, edges: DataFrame, setter: str = "setState") -> DataFrame:
    """Async TypeScript nodes calling ``setter``."""
    targets = nodes.filter(F.col("name") == setter).select(F.col("id").alias("target"))
    callers = edges.filter("kind = 'calls'").join(targets, "target", "left_semi").select(F.col("source").alias("id"))
    return nodes.filter("is_async AND language = 'typescript'").join(callers, "id", "left_semi").select(
        "id", "file_path", "start_line"
    )


# --- R42: tool commands -----------------------------------------------------------------------

def classify_risk(entry: Column) -> Column:
    """Risk of a granted command; the longest dangerous pattern decides."""
    host = entry.rlike("|".join(re.escape(h) for h in R.TRUSTED_HOSTS))
    risk = None
    for pattern, level in sorted(R.RISK_COMMANDS, key=lambda p: -len(p[0])):
        value = F.when(host, "LOW").otherwise(level) if "curl" in pattern else F.lit(level)
        risk = F.when(entry.contains(pattern), value) if risk is None else risk.when(entry.contains(pattern), value)
    safe = entry.rlike("^(?:" + "|".join(re.escape(p) for p in R.SAFE_PREFIXES) + ")")
    return (
        risk.when(safe, "LOW")
        .when(L.contains_any(entry, R.PLAINTEXT_PASSWORD), "CRITICAL")
        .when(entry.rlike(R.API_KEY), "CRITICAL")
        .otherwise("INFO")
    )
