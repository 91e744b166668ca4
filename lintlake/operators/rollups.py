"""Findings and their rollups, repo profiles, scores, and file metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lintlake.operators import lines as L, scans as S
from lintlake.operators.ranking import rank_within
from lintlake.rules import code_rules as R, gate_rules as G
from lintlake.session import materialise

FINDING = ["repo", "path", "line_no", "rule_id", "type", "level", "message"]


def finding(df: DataFrame, rule_id: Column | str, kind: str, level: Column | str, message: Column | None = None) -> DataFrame:
    """Rows of one scan in the findings schema."""
    def value(v):
        return F.lit(v) if isinstance(v, str) else v

    line = F.col("line_no").cast("long") if "line_no" in df.columns else F.lit(0).cast("long")
    return df.select(
        "repo", "path", line.alias("line_no"), value(rule_id).alias("rule_id"), F.lit(kind).alias("type"),
        value(level).alias("level"), (message if message is not None else F.lit("")).alias("message"),
    )


def union_findings(*parts: DataFrame) -> DataFrame:
    """Scans of different shape as one table; missing columns are null."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def quick_findings(files: DataFrame) -> DataFrame:
    """The quick rules over a corpus: one pass for all line rules, one for the file rules."""
    line = F.col("line")
    found = L.line_hits(
        files, lambda x: S.secret_line(x) | S.sql_call(x) | S.route_line(x) | S.catch_line(x), {"before": (-5, 0), "after": (1, 10)}
    )

    def row(cond: Column | None, rule: Column, kind: str, level: Column, message: Column) -> Column:
        value = F.struct(rule.alias("rule_id"), F.lit(kind).alias("type"), level.alias("level"), message.alias("message"))
        return F.when(cond, value)

    secret, kind = S.secret_line(line), S.interpolation(F.col("before"))
    unguarded = S.route_line(line) & ~L.contains_any(F.array_join("after", "\n"), R.AUTH_WORDS)
    rows = [row(secret & r.isNotNull(), r["rule"], "fail", r["level"], F.lit("")) for r in S.secret_rules(line)]
    rows += [
        row(S.sql_call(line) & kind.isNotNull(), F.lit("SQL-001"), "fail", F.lit("CRITICAL"), kind),
        row(unguarded, F.lit("AUTH-001"), "warn", F.lit("MEDIUM"), S.route_framework(line)),
    ]
    rows += [
        row(S.catch_line(line) & line.rlike(p), F.lit("CATCH-001"), "warn", F.lit("LOW"), F.lit(f"[TS-003] {label}"))
        for p, label in R.CATCH_DANGER
    ]
    in_lines = found.select("repo", "path", F.col("line_no").cast("long").alias("line_no"), F.inline(F.array_compact(F.array(*rows))))
    return union_findings(
        in_lines,
        finding(S.scan_yagni(files), "YAGNI-001", "warn", "LOW", F.lit("[YAGNI-001] imports or todos")),
        finding(S.scan_stdlib(files), "STDLIB-001", "info", "INFO", F.concat(F.lit("[STDLIB-001] "), "package")),
    )


# --- A1-A4, A41 -------------------------------------------------------------------------------

def run_counters(findings: DataFrame) -> DataFrame:
    """A1."""
    def n(kind: str) -> Column:
        return F.count_if(F.col("type") == kind)

    return findings.agg(
        F.count("*").alias("total"), n("pass").alias("passed"), n("fail").alias("failed"), n("warn").alias("warnings"),
        n("skip").alias("skipped"), (n("fail") == 0).alias("success"),
    )


def by_level(findings: DataFrame) -> DataFrame:
    """A2."""
    return findings.groupBy("level").agg(F.count("*").alias("n"))


LEVELS = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]


def file_level_matrix(findings: DataFrame, key: str = "path") -> DataFrame:
    """A3: findings per file and level with the total (fixed levels, so one pass and no pivot scan)."""
    return findings.groupBy(key).agg(
        F.count("*").alias("total"), *[F.count_if(F.col("level") == v).alias(v.lower()) for v in LEVELS]
    )


def worst_files(matrix: DataFrame, n: int = 10) -> DataFrame:
    """A3: the text report's top ``n``."""
    return matrix.orderBy(F.desc("total"), "path").limit(n)


def findings_of_level(findings: DataFrame) -> DataFrame:
    """A4: each level's findings in order, as rows numbered within the level.

    A level can hold most findings, so it is never gathered into one list; the numbering is split by repo and by the
    beginnings of paths. The findings are counted and numbered, so they are found once and written.
    """
    return rank_within(materialise(findings, "findings"), ["level"], [("_repo", F.col("repo")), ("_at", F.substring("path", 1, 12))], [F.col("path"), F.col("line_no"), F.col("rule_id"), F.col("message")])


def debt_category(message: Column) -> Column:
    out = None
    for mark, category in G.DEBT_CATEGORIES:
        out = F.when(message.contains(mark), category) if out is None else out.when(message.contains(mark), category)
    return out.otherwise("other")


def technical_debt(findings: DataFrame) -> DataFrame:
    """Findings of the optimisation rules by debt category."""
    marked = findings.filter(L.contains_any(F.col("message"), [m for m, _ in G.DEBT_CATEGORIES]))
    return marked.groupBy(debt_category(F.col("message")).alias("category")).agg(
        F.count("*").alias("n"), F.countDistinct("rule_id").alias("rules")
    )


# --- A30-A32: scores --------------------------------------------------------------------------

def _cost(penalties: dict[str, int], level: Column, default: int = 0) -> Column:
    table = F.create_map(*[F.lit(x) for kv in penalties.items() for x in kv])
    return F.coalesce(table[level], F.lit(default))


def penalty_score(violations: DataFrame) -> DataFrame:
    """100 minus the penalties of failed operators' violations, per repo; ``violations(repo, operator, passed, severity)``."""
    cost = F.when(~F.col("passed"), _cost(G.SEVERITY_PENALTY, F.col("severity"))).otherwise(0)
    return violations.groupBy("repo").agg(
        F.least(F.greatest(F.lit(100) - F.sum(cost), F.lit(0)), F.lit(100)).cast("long").alias("score")
    )


def acceptance_score(results: DataFrame) -> DataFrame:
    """Failed automatic rules cost penalty · min(violations + 1, 3); ``results(repo, rule_id, step, auto, passed, severity, violations)``."""
    cost = F.when(
        F.col("auto") & ~F.col("passed"),
        _cost(G.ACCEPTANCE_PENALTY, F.col("severity"), 10) * F.least(F.col("violations") + 1, F.lit(3)),
    ).otherwise(0)
    return results.groupBy("repo").agg(F.greatest(F.lit(100) - F.sum(cost), F.lit(0)).cast("long").alias("score"))


def acceptance_rollup(results: DataFrame) -> DataFrame:
    """Per step whether all automatic rules pass, with counts."""
    return results.groupBy("repo", "step").agg(
        F.bool_and(F.col("passed") | ~F.col("auto")).alias("all_ok"),
        F.count_if("auto").alias("auto_rules"), F.count_if(~F.col("auto")).alias("manual_rules"),
        *[F.sum(F.when(F.col("severity") == s, F.col("violations")).otherwise(0)).alias(f"{s.lower()}_violations") for s in G.ACCEPTANCE_PENALTY],
    )


def acceptance_gate(results: DataFrame, threshold: int = 70) -> DataFrame:
    """Repos below the score threshold."""
    return acceptance_score(results).withColumn("blocked", F.col("score") < threshold)


# --- A28/A29/A34/A35: repo profiles -----------------------------------------------------------

def _language(ext: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in G.LANGUAGES.items() for x in kv])[F.lower(ext)]


def repo_profile(files: DataFrame, max_depth: int = 4) -> DataFrame:
    """Known-language files, lines of code languages and bytes per repo, directories at most 4 deep."""
    known = _known(files, max_depth)
    counted = F.col("lang").isin(*G.COUNTED_LANGUAGES)
    return known.groupBy("repo").agg(
        F.count("*").alias("files"),
        F.sum(F.when(counted, F.size(F.split("content", "\n"))).otherwise(0)).cast("long").alias("lines"),
        F.sum(F.octet_length("content")).cast("long").alias("bytes"),
    )


def _known(files: DataFrame, max_depth: int) -> DataFrame:
    hidden = F.col("path").rlike(r"(^|/)\.")
    deep = F.size(F.split("path", "/")) - 1 > max_depth
    return files.filter(~hidden & ~deep).withColumn("lang", _language(F.col("ext"))).filter("lang IS NOT NULL")


def top_languages(files: DataFrame, n: int = 8, max_depth: int = 4) -> DataFrame:
    """The ``n`` most frequent languages of each repo."""
    counts = _known(files, max_depth).groupBy("repo", "lang").agg(F.count("*").alias("files"))
    return rank_within(counts, ["repo"], [("_b", -F.col("files"))], [F.col("lang")]).filter(F.col("rank") <= n)


def project_types(files: DataFrame) -> DataFrame:
    """Languages present per repo, and the framework with the best evidence in path order."""
    ext, text = F.col("ext"), F.lower("content")

    def first_of(words: list[str], exts: list[str]) -> Column:
        word = F.coalesce(*[F.when(text.contains(w), w) for w in words])
        return F.min_by(word, F.when(ext.isin(*exts) & word.isNotNull(), F.col("path")))

    return files.groupBy("repo").agg(
        F.bool_or(ext == "py").alias("python"), F.bool_or(ext.isin("ts", "tsx")).alias("typescript"),
        F.bool_or(ext == "go").alias("go"), F.bool_or(ext == "rs").alias("rust"),
        first_of(G.PY_FRAMEWORKS, ["py"]).alias("python_framework"), first_of(G.TS_FRAMEWORKS, ["ts", "tsx"]).alias("typescript_framework"),
    )


def repo_frameworks(files: DataFrame) -> DataFrame:
    """Python frameworks a repo imports; (repo, framework)."""
    found = L.line_hits(files.filter("ext = 'py'"), lambda line: line.rlike(r"^\s*(import |from ).*(fastapi|django|flask)"))
    rows = F.array_compact(F.array(*[F.when(F.col("line").contains(f), F.lit(f)) for f in G.PY_FRAMEWORKS]))
    return found.select("repo", F.explode(rows).alias("framework")).distinct()


def structure_health(files: DataFrame) -> DataFrame:
    """Five part scores of 0-20 per repo, whether the total passes 70, and its band."""
    top, name, text = S.top_dir(F.col("path")), S.file_name(F.col("path")), F.lower("content")
    visible = F.when(~top.startswith(".") & ~top.isin("node_modules", "__pycache__", "venv"), top)
    project = F.when(F.col("path") == "pyproject.toml", text)

    def has(*dirs: str) -> Column:
        return F.coalesce(F.bool_or(top.isin(*dirs)), F.lit(False))

    facts = files.groupBy("repo").agg(
        F.countDistinct(visible).alias("n_dirs"),
        F.countDistinct(F.when(visible.isin(*G.UNCLEAR_DIRS), visible)).alias("n_unclear"),
        has(*G.KNOWN_DIRS).alias("known"), has("tests", "test").alias("tests"), has("api", "app").alias("api"),
        has("services").alias("services"), has("repositories", "repos").alias("repos"),
        F.coalesce(F.bool_or(F.col("path").isin("cli.py", "__main__.py")), F.lit(False)).alias("cli"),
        F.coalesce(F.bool_or((top == "api") & (F.col("ext") == "py") & F.lower(name).contains("router")), F.lit(False)).alias("routers"),
        F.coalesce(F.bool_or((top == "services") & (F.col("ext") == "py") & F.lower(name).contains("service")), F.lit(False)).alias("service_files"),
        F.coalesce(F.bool_or(project.contains("fastapi")), F.lit(False)).alias("fastapi"),
        F.coalesce(F.bool_or(project.contains("pydantic")), F.lit(False)).alias("pydantic"),
    )

    def points(cond: Column, value: float) -> Column:
        return F.when(cond, value).otherwise(0.0)

    c = F.col
    dirs = (
        points(c("n_dirs") >= 3, 5.0) + points(c("known"), 5.0)
        + F.when(c("n_unclear") == 0, 5.0).when(c("n_unclear") <= 1, 3.0).otherwise(0.0) + points(c("tests"), 5.0)
    )
    layered = (
        points(c("api"), 5.0) + points(c("services"), 5.0) + points(c("repos"), 5.0)
        + points(c("api") & c("routers"), 2.5) + points(c("services") & c("service_files"), 2.5)
    )
    flat = F.when(c("cli"), 12.0).otherwise(10.0)
    layers = F.when(c("api") | c("services") | c("repos"), layered).otherwise(flat)
    framework = 10.0 + points(c("fastapi"), 5.0) + points(c("pydantic"), 5.0)
    total = F.col("total")
    return facts.select(
        "repo", dirs.alias("directories"), layers.alias("layers"), F.lit(15.0).alias("api_consistency"),
        framework.alias("framework"), F.lit(15.0).alias("naming"),
    ).withColumn("total", F.col("directories") + F.col("layers") + F.col("framework") + 30.0).withColumn(
        "passed", total >= 70
    ).withColumn("band", F.when(total >= 80, "excellent").when(total >= 70, "good").when(total >= 60, "fair").otherwise("unhealthy"))


def directory_roles(files: DataFrame) -> DataFrame:
    """Files directly in each visible top directory, and its role; ``unclear`` where none is known."""
    top = S.top_dir(F.col("path"))
    direct = (F.size(F.split("path", "/")) == 2) & ~S.file_name(F.col("path")).startswith(".")
    role = F.create_map(*[F.lit(x) for kv in G.DIR_ROLES.items() for x in kv])[F.col("top_dir")]
    visible = top.isNotNull() & ~top.startswith(".") & ~top.isin("node_modules", "__pycache__", "venv", "dist", "build")
    return files.filter(visible).groupBy("repo", top.alias("top_dir")).agg(F.count_if(direct).alias("files")).withColumn(
        "role", F.coalesce(role, F.lit("unclear"))
    )


def directory_clarity(files: DataFrame) -> DataFrame:
    """Share of directories with a known role; 60 % passes."""
    ratio = F.count_if(F.col("role") != "unclear") / F.count("*")
    return directory_roles(files).groupBy("repo").agg(F.count("*").alias("directories"), ratio.alias("clarity")).withColumn(
        "passed", F.col("clarity") >= G.CLARITY_RATIO
    )


# --- A42, A53, N2-N6: file metrics, all inside the file's row ------------------------------------

def _lines(files: DataFrame, *exts: str) -> DataFrame:
    return files.filter(F.col("ext").isin(*exts)).withColumn("_lines", F.split("content", "\n"))


def comment_ratio(files: DataFrame, limit: float = 0.3) -> DataFrame:
    """Python files whose comment lines exceed 30 % of the code lines."""
    lines = F.col("_lines")
    comments = F.size(F.filter(lines, lambda line: line.rlike(r"^\s*#")))
    code = F.size(F.filter(lines, lambda line: line.rlike(r"^\s*[^#\s]")))
    return _lines(files, "py").select("repo", "path", comments.cast("long").alias("comments"), code.cast("long").alias("code")).filter(
        (F.col("code") > 0) & (F.col("comments") / F.col("code") > limit)
    )


def comment_runs(files: DataFrame, limit: int = 10) -> DataFrame:
    """Longest run of comment lines per Python file, above ``limit``."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(acc: Column, line: Column) -> Column:
        now = F.when(line.rlike(r"^\s*#"), acc["now"] + 1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["best"], now).alias("best"))

    best = F.aggregate("_lines", start, step)["best"]
    return _lines(files, "py").select("repo", "path", best.cast("long").alias("longest_run")).filter(F.col("longest_run") > limit)


def duplicate_blocks(files: DataFrame, size: int = 5) -> DataFrame:
    """The first 5-line block that comes again in its Python file; blank and comment blocks do not count.

    The blocks' hashes are sorted inside the row, where equal ones become neighbours for one fold.
    """
    def block(lines: Column, i: Column) -> Column:
        return L.let(
            F.slice(lines, i, F.lit(size)),
            lambda rows: F.struct(
                F.sha2(F.array_join(rows, "\n"), 256).alias("h"), i.alias("no"),
                F.exists(rows, lambda line: line.rlike(r"^\s*[^#\s]")).alias("code"),
            ),
        )

    def blocks(lines: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(lines) - (size - 1), F.lit(1)))
        return F.filter(F.transform(starts, lambda i: block(lines, i)), lambda b: b["code"])

    start = F.struct(
        F.lit("").alias("h"), F.lit(0).alias("first"), F.lit(0).alias("n"), F.lit(2**31 - 1).alias("best"), F.lit(0).alias("copies")
    )

    def step(acc: Column, b: Column) -> Column:
        same = acc["h"] == b["h"]
        first = F.when(same, acc["first"]).otherwise(b["no"])
        n = F.when(same, acc["n"] + 1).otherwise(1)
        better = (n >= 2) & (first <= acc["best"])
        return F.struct(
            b["h"].alias("h"), first.alias("first"), n.alias("n"), F.when(better, first).otherwise(acc["best"]).alias("best"),
            F.when(better, n).otherwise(acc["copies"]).alias("copies"),
        )

    def result(found: Column) -> Column:
        row = F.struct(found["best"].cast("long").alias("line_no"), found["copies"].cast("long").alias("copies"))
        return F.when(found["copies"] > 0, F.array(row))

    found = L.let(F.split("content", "\n"), lambda lines: F.aggregate(F.array_sort(blocks(lines)), start, step))
    return files.filter("ext = 'py'").select("repo", "path", F.inline(L.let(found, result)))


def _indent(line: Column) -> Column:
    return F.length(F.regexp_extract(line, r"^(\s*)", 1))


_DEF = r"^\s*(async )?def "


def _marked(files: DataFrame, pattern: str, column: str) -> DataFrame:
    numbered = F.transform("_lines", lambda line, i: F.struct((i + 1).alias("no"), line.alias("line")))
    return files.withColumn(column, F.filter(numbered, lambda s: s["line"].rlike(pattern)))


def function_lengths(files: DataFrame) -> DataFrame:
    """Functions measured from their def to the next def or the file's end.

    A function that a line of its own or smaller indent closes before that is not measured.
    """
    lines, defs = F.col("_lines"), F.col("_defs")
    n = F.size(lines)
    with_next = F.transform(
        defs, lambda d, i: F.struct(d["no"].alias("no"), d["line"].alias("line"), F.coalesce(F.get(defs, i + 1)["no"], n + 1).alias("next"))
    )

    def closed(d: Column) -> Column:
        body = F.slice(lines, d["no"] + 1, d["next"] - d["no"] - 1)
        return F.exists(body, lambda line: line.rlike(r"^\s*[^#\s]") & (_indent(line) <= _indent(d["line"])))

    rows = F.transform(
        F.filter(F.col("_next"), lambda d: ~closed(d)),
        lambda d: F.struct(
            d["no"].cast("long").alias("line_no"),
            F.regexp_extract(d["line"], r"def\s+([^(]*)", 1).alias("function"),
            F.when(d["next"] > n, n - d["no"]).otherwise(d["next"] - d["no"] - 1).cast("long").alias("length"),
        ),
    )
    return _marked(_lines(files, "py"), _DEF, "_defs").withColumn("_next", with_next).select("repo", "path", F.inline(rows))


def long_functions(files: DataFrame, limit: int = 50) -> DataFrame:
    """N4."""
    return function_lengths(files).filter(F.col("length") > limit)


def class_methods(files: DataFrame) -> DataFrame:
    """Defs from a class line to the next one.

    Among the def and class lines only, that is the distance between two class positions.
    """
    marks, classes = F.col("_marks"), F.col("_classes")
    at = F.transform(marks, lambda m, i: F.struct(m["no"].alias("no"), m["line"].alias("line"), i.alias("i")))
    heads = F.filter(at, lambda m: m["line"].rlike(r"^\s*class "))
    rows = F.transform(
        classes,
        lambda c, i: F.struct(
            c["no"].cast("long").alias("line_no"), F.regexp_extract(c["line"], r"class ([^(:]*)", 1).alias("class_name"),
            (F.coalesce(F.get(classes, i + 1)["i"], F.col("_n")) - c["i"] - 1).cast("long").alias("methods"),
        ),
    )
    marked = _marked(_lines(files, "py"), rf"{_DEF}|^\s*class ", "_marks")
    return marked.withColumn("_classes", heads).withColumn("_n", F.size(marks)).select("repo", "path", F.inline(rows))


def large_classes(files: DataFrame, limit: int = 15) -> DataFrame:
    """N5."""
    return class_methods(files).filter(F.col("methods") > limit)


_TS_FUNCTION = r"^\s*(async\s+)?function\s+\w+|^\s*\w+\s*\(.*\)\s*\{|=>"


def brace_functions(files: DataFrame, limit: int = 50) -> DataFrame:
    """TypeScript functions by brace depth; the opening line counts twice, as measured before.

    One fold over the file's lines: the open function, its depth and the closed ones.
    """
    empty = F.array().cast("array<struct<line_no:bigint,length:bigint>>")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).alias("depth"), empty.alias("done"))

    def braces(line: Column) -> Column:
        return F.regexp_count(line, F.lit(r"\{")) - F.regexp_count(line, F.lit(r"\}"))

    def step(acc: Column, s: Column) -> Column:
        opens = (acc["at"] == 0) & s["line"].rlike(_TS_FUNCTION)
        delta = braces(s["line"])
        at = F.when(opens, s["no"].cast("long")).otherwise(acc["at"])
        depth = F.when(opens, delta * 2).when(acc["at"] > 0, acc["depth"] + delta).otherwise(0)
        ends = (at > 0) & (depth <= 0)
        one = F.struct(at.alias("line_no"), (s["no"].cast("long") - at + 1).alias("length"))
        return F.struct(
            F.when(ends, F.lit(0).cast("long")).otherwise(at).alias("at"), F.when(ends, 0).otherwise(depth).alias("depth"),
            F.when(ends & (one["length"] > limit), F.array_append(acc["done"], one)).otherwise(acc["done"]).alias("done"),
        )

    numbered = F.transform("_lines", lambda line, i: F.struct((i + 1).alias("no"), line.alias("line")))
    return _lines(files, "ts").select("repo", "path", F.inline(F.aggregate(numbered, start, step)["done"]))


def file_metrics(files: DataFrame) -> DataFrame:
    """Lines, functions, classes, longest function, mean length, most methods and keyword complexity per Python file."""
    base = _lines(files, "py").select(
        "repo", "path", F.size("_lines").cast("long").alias("lines"),
        F.size(F.filter("_lines", lambda line: line.rlike(_DEF))).cast("long").alias("functions"),
        F.size(F.filter("_lines", lambda line: line.rlike(r"^\s*class "))).cast("long").alias("classes"),
        S.keyword_complexity(F.col("content")).alias("complexity"),
    )
    lengths = function_lengths(files).groupBy("repo", "path").agg(
        F.max("length").alias("max_function_length"), F.avg("length").alias("mean_function_length")
    )
    methods = class_methods(files).groupBy("repo", "path").agg(F.max("methods").alias("max_methods"))
    out = base.join(lengths, ["repo", "path"], "left").join(methods, ["repo", "path"], "left")
    return out.fillna(0, ["max_function_length", "max_methods"]).fillna(0.0, ["mean_function_length"])
