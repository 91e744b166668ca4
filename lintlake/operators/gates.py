"""Path filters, suppressions and gates: what is checked, what is dropped and what blocks."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column, DataFrame, functions as F

from lintlake.functions.scalars import version_matches
from lintlake.operators.lines import any_line, contains_any, frame, line_hits
from lintlake.operators.scans import classify_risk, file_name, top_dir
from lintlake.rules import code_rules, gate_rules as R

# --- P2-P6, P9, P10 ---------------------------------------------------------------------------

def ignore_patterns(lines: DataFrame) -> DataFrame:
    """The non-blank lines that are no comment."""
    text = F.regexp_replace("line", r"^\s+|\s+$", "")
    return lines.select(text.alias("pattern")).filter((F.col("pattern") != "") & ~F.col("pattern").startswith("#"))


def should_ignore(path: Column, patterns: list[str], skip_tests: bool = True) -> Column:
    """Configured patterns (regex from the start, or substring), built-in directories, test files."""
    ignored = contains_any(path, patterns)
    for pattern in patterns:
        try:
            re.compile(pattern)
        except re.error:
            continue  # no regex: a substring only
        ignored = ignored | path.rlike(f"^(?:{pattern})")
    ignored = ignored | contains_any(path, code_rules.IGNORED_PARTS)
    if skip_tests:
        ignored = ignored | F.lower(file_name(path)).contains("test") | F.array_contains(F.split(path, "/"), "tests")
    return ignored


def core_file_match(path: Column, rules=code_rules.CORE_FILES) -> Column:
    """P5: struct(name, severity) of the first core-file rule a path matches, else null.

    ``^`` patterns are regexes, ``*`` patterns are searched in any case, others must be equal in any case.
    """
    def hit(pattern: str) -> Column:
        if pattern.startswith("^"):
            return path.rlike(pattern)
        if "*" in pattern:
            return path.rlike("(?i)" + pattern.replace("*", ".*"))
        return F.lower(path) == pattern.lower()

    return F.coalesce(*[
        F.when(hit(pattern), F.struct(F.lit(name).alias("name"), F.lit(severity).alias("severity")))
        for name, patterns, severity in rules for pattern in patterns
    ])


def only_changed(df: DataFrame, changed: DataFrame) -> DataFrame:
    """Rows of changed paths."""
    return df.join(changed.select("repo", "path").distinct(), ["repo", "path"], "left_semi")


def changed_union(*lists: DataFrame) -> DataFrame:
    """The distinct files of several change lists."""
    out = lists[0].select("repo", "path")
    for other in lists[1:]:
        out = out.unionByName(other.select("repo", "path"))
    return out.distinct()


def max_size(files: DataFrame, limit: int = R.MAX_FILE_BYTES, size: str = "size") -> DataFrame:
    """Files the gate checks; larger ones pass unchecked, see ``skipped_files``."""
    return files.filter(F.coalesce(F.col(size) <= limit, F.lit(True)))


def skipped_files(files: DataFrame, limit: int = R.MAX_FILE_BYTES, size: str = "size") -> DataFrame:
    """The files the gate leaves out for their size, as ``skip`` findings."""
    return files.filter(F.col(size) > limit).select("repo", "path", F.lit("file-size").alias("rule"), F.lit("skip").alias("level"))


def gate(findings: DataFrame, block_on: tuple[str, ...] = ("CRITICAL", "ERROR")) -> DataFrame:
    """P10: whether a file is blocked."""
    return findings.groupBy("repo", "path").agg(
        F.bool_or(F.upper("level").isin(*block_on)).alias("blocked"), F.count("*").alias("findings")
    )


def core_file_changes(changed: DataFrame) -> DataFrame:
    """Changed files that are core files."""
    return changed.withColumn("_c", core_file_match(F.col("path"))).filter("_c IS NOT NULL").select(
        "repo", "path", F.col("_c.name").alias("rule"), F.col("_c.severity").alias("severity")
    )


def core_change_verdict(changed: DataFrame) -> DataFrame:
    """Fail when a critical core file changed, warn for others."""
    hit = changed.withColumn("_c", core_file_match(F.col("path")))
    critical = F.coalesce(F.bool_or(F.col("_c.severity") == "critical"), F.lit(False))
    n = F.count("_c")
    return hit.groupBy("repo").agg(
        F.count("*").alias("checked"), n.alias("core_changes"),
        F.when(critical, "fail").when(n > 0, "warn").otherwise("pass").alias("verdict"),
    )


# --- J27: suppressions ------------------------------------------------------------------------

def apply_suppressions(findings: DataFrame, files: DataFrame, marker: str, ignored_paths: dict[str, list[str]]) -> DataFrame:
    """Findings without an ignore marker near them, in the file's first 10 lines, or for their path.

    Markers are read in the file's row: one row per (file, marked rule) with its line numbers.
    """
    pattern = re.escape(marker) + r"\s*([\w-]+)"
    marks = line_hits(files, lambda line: line.contains(marker) & line.rlike(pattern))
    rules = marks.select("repo", "path", "line_no", F.regexp_extract("line", pattern, 1).alias("rule_id"))
    # a marker covers the lines whose window (5 before .. 4 after, 0-based slice) holds it
    near = rules.select(
        "repo", "path", "rule_id",
        F.explode(F.sequence(F.col("line_no") - R.SUPPRESS_AFTER, F.col("line_no") + R.SUPPRESS_BEFORE)).alias("line_no"),
    ).distinct()
    header = rules.filter(F.col("line_no") <= R.SUPPRESS_HEADER).select("repo", "path", "rule_id").distinct()
    by_path = F.lit(False)
    for rule, globs in ignored_paths.items():
        for glob in globs:
            by_path = by_path | ((F.col("rule_id") == rule) & F.col("path").rlike(fnmatch.translate(glob).replace(r"\Z", "$")))
    return (
        findings.filter(~by_path)
        .join(near, ["repo", "path", "rule_id", "line_no"], "left_anti")
        .join(header, ["repo", "path", "rule_id"], "left_anti")
    )


# --- S7/J18: dependencies ---------------------------------------------------------------------

def extract_dependencies(files: DataFrame) -> DataFrame:
    """Packages of requirements.txt (by line), package.json (both dependency maps) and pyproject.toml (the project's list)."""
    name = file_name(F.col("path"))
    found = line_hits(
        files.filter(name == "requirements.txt"), lambda line: line.rlike(R.REQUIREMENT) & ~line.rlike(r"^\s*[#-]"),
        keys=("repo", "path"),
    )
    python = found.select(
        "repo", "path", F.lit("python").alias("ecosystem"), F.regexp_extract("line", R.REQUIREMENT, 1).alias("package"),
        F.regexp_extract("line", R.REQUIREMENT, 3).alias("version"), F.col("line_no").cast("long").alias("line_no"),
    )
    parsed = files.filter(name == "package.json").select(
        "repo", "path", F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>").alias("j")
    )
    # a package in both maps keeps its devDependencies version
    dev = F.coalesce("j.devDependencies", F.expr("map()").cast("map<string,string>"))
    main = F.map_filter(
        F.coalesce("j.dependencies", F.expr("map()").cast("map<string,string>")), lambda k, v: ~F.map_contains_key(dev, k)
    )
    node = parsed.select("repo", "path", F.explode(F.map_concat(main, dev)).alias("package", "_spec")).select(
        "repo", "path", F.lit("node").alias("ecosystem"), "package", F.regexp_extract("_spec", r"([\d.]+)", 1).alias("version"),
        F.lit(0).cast("long").alias("line_no"),
    ).filter("version <> ''")
    # the array of [project], up to the next table; entries without a plain version are no match
    project = F.regexp_extract("content", r"(?s)(?:^|\n)\[project\][^\n]*\n(.*?)(?:\n\[\w|$)", 1)
    entries = F.regexp_extract(project, r"(?s)(?:^|\n)dependencies\s*=\s*\[(.*?)\]\s*(?:\n|$)", 1)
    pattern = r"[\"']([a-zA-Z0-9_-]+)[=<>!~]+([\d.]+)"
    pairs = F.arrays_zip(*[F.regexp_extract_all(entries, F.lit(pattern), F.lit(k)).alias(n) for k, n in ((1, "package"), (2, "version"))])
    toml = files.filter(name == "pyproject.toml").select("repo", "path", F.inline(pairs)).select(
        "repo", "path", F.lit("python").alias("ecosystem"), "package", "version", F.lit(0).cast("long").alias("line_no")
    )
    return python.unionByName(node).unionByName(toml)


def vulnerabilities(dependencies: DataFrame, advisories: DataFrame) -> DataFrame:
    """Dependencies inside an advisory's version range."""
    dim = advisories.select("ecosystem", F.lower("package").alias("_pkg"), "range_op", "range_version", "severity", "summary")
    return (
        dependencies.withColumn("_pkg", F.lower("package"))
        .join(dim, ["ecosystem", "_pkg"])
        .filter(version_matches(F.col("version"), F.col("range_op"), F.col("range_version")))
        .drop("_pkg")
    )


# --- R42/J19/A46: permissions -----------------------------------------------------------------

def classified_grants(grants: DataFrame) -> DataFrame:
    """``grants(tool, entry)`` with their command type and risk."""
    entry = F.col("entry")
    kind = F.when(entry.contains("("), F.split(entry, "\\(")[0]).otherwise("unknown")
    return grants.select("tool", "entry", kind.alias("type"), classify_risk(entry).alias("risk"))


def used_commands(usage: DataFrame) -> DataFrame:
    """Distinct commands in the usage text."""
    inner = F.explode(F.regexp_extract_all("text", F.lit(r"Bash\(([^)]+)\)"), F.lit(1)))
    return usage.select("tool", inner.alias("_c")).select("tool", F.trim(F.split("_c", "\\(")[0]).alias("used")).distinct()


def idle_grants(grants: DataFrame, usage: DataFrame) -> DataFrame:
    """Non-LOW grants whose type is part of no used command.

    Only the distinct types, far fewer than grants, are looked up; a used command offers every substring that
    could be a type of that length, so the look-up is an equi-join.
    """
    risky = classified_grants(grants).filter("risk <> 'LOW'")
    types = risky.select("tool", "type", F.length("type").alias("_n")).distinct()
    sizes = types.select("tool", "_n").distinct()
    parts = (
        used_commands(usage).join(sizes, "tool").filter((F.length("used") >= F.col("_n")) & (F.col("_n") > 0))
        .select("tool", F.explode(F.expr("transform(sequence(1, length(used) - _n + 1), i -> substring(used, i, _n))")).alias("type"))
        .distinct()
    )
    used = types.join(parts, ["tool", "type"], "left_semi").select("tool", "type")
    return risky.filter("type <> ''").join(used, ["tool", "type"], "left_anti").select("tool", "entry", "type", "risk")


def permission_audit(grants: DataFrame, usage: DataFrame) -> DataFrame:
    """Grants by risk and the share that is idle, per tool."""
    graded = classified_grants(grants).groupBy("tool").agg(
        F.count("*").alias("total"), *[F.count_if(F.col("risk") == r).alias(r.lower()) for r in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")]
    )
    idle = idle_grants(grants, usage).groupBy("tool").agg(F.count("*").alias("idle"))
    n = F.coalesce("idle", F.lit(0))
    return graded.join(idle, "tool", "left").withColumn("idle", n).withColumn(
        "idle_pct", F.floor(F.col("idle") * 100.0 / F.col("total") + 0.5).cast("long")
    )


def idle_suggestions(grants: DataFrame, usage: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` idle grants by entry (a bounded top-n)."""
    return idle_grants(grants, usage).orderBy("tool", "entry").limit(n)


# --- J20/J21/A47: leaks -----------------------------------------------------------------------

def exposed_files(files: DataFrame, ignore_lines: DataFrame) -> DataFrame:
    """Sensitive root files of a repo that no line of its ignore file mentions.

    ``ignore_lines(repo, line)``; each line offers the sensitive names it holds, so the check is an equi-join.
    """
    root = files.filter(F.col("path").isin(*R.SENSITIVE_FILES)).select("repo", F.col("path").alias("name")).distinct()
    named = F.array_compact(F.array(*[F.when(F.col("line").contains(s), F.lit(s)) for s in R.SENSITIVE_FILES]))
    covered = ignore_lines.filter(~F.col("line").rlike(r"^\s*(#|$)")).select("repo", F.explode(named).alias("name")).distinct()
    return root.join(covered, ["repo", "name"], "left_anti")


def ignore_gaps(repos: DataFrame, ignore_lines: DataFrame) -> DataFrame:
    """Sensitive entries missing from a repo's ignore file."""
    held = ignore_lines.groupBy("repo").agg(
        F.array_compact(F.array(*[F.max(F.when(F.col("line").contains(s), s)) for s in R.MUST_IGNORE])).alias("held")
    )
    wanted = F.array(*[F.lit(s) for s in R.MUST_IGNORE])
    rows = repos.select("repo").distinct().join(held, "repo", "left")
    return rows.select("repo", F.explode(F.array_except(wanted, F.coalesce("held", F.array().cast("array<string>")))).alias("missing"))


def leaking_links(links: DataFrame) -> DataFrame:
    """Links of ``links(repo, root, path, target)`` leading out of the root into a sensitive directory; the first one named."""
    hit = F.coalesce(*[F.when(F.col("target").contains(s), s) for s in R.SENSITIVE_DIRS])
    return links.filter(~F.col("target").startswith(F.col("root"))).withColumn("sensitive", hit).filter("sensitive IS NOT NULL")


def leak_rollup(findings: DataFrame) -> DataFrame:
    """Findings per check and whether it passes (no CRITICAL)."""
    return findings.groupBy("check_name").agg(
        F.count("*").alias("findings"), F.bool_and(F.col("level") != "CRITICAL").alias("passed")
    )


# --- J22/J23/S8/A48: tests and coverage ---------------------------------------------------------

def missing_tests(files: DataFrame, changed: DataFrame) -> DataFrame:
    """Business files of monitored directories without ``tests/unit/<dir>/test_<name>``."""
    path = F.col("path")
    business = path.endswith(".py") & ~path.rlike(R.NO_BUSINESS_CODE) & top_dir(path).isin(*R.MONITORED_DIRS)
    expected = F.concat(F.lit("tests/unit/"), top_dir(path), F.lit("/test_"), file_name(path))
    wanted = changed.filter(business).select("repo", "path", expected.alias("expected"))
    return wanted.join(files.select("repo", F.col("path").alias("expected")).distinct(), ["repo", "expected"], "left_anti")


def read_coverage(reports: DataFrame) -> DataFrame:
    """(repo, path, statements, covered, pct) of coverage JSON documents."""
    summary = "struct<num_statements:bigint,covered_lines:bigint,percent_covered:double>"
    parsed = reports.select("repo", F.from_json("doc", f"struct<files:map<string,struct<summary:{summary}>>>").alias("d"))
    return parsed.select("repo", F.explode("d.files").alias("path", "f")).select(
        "repo", "path", F.col("f.summary.num_statements").alias("statements"), F.col("f.summary.covered_lines").alias("covered"),
        F.col("f.summary.percent_covered").alias("pct"),
    )


def coverage_gate(coverage: DataFrame, changed: DataFrame) -> DataFrame:
    """Files below the threshold, which is higher for changed files."""
    new = changed.select("repo", "path", F.lit(True).alias("is_new")).distinct()
    limit = F.when(F.col("is_new"), R.NEW_CODE_THRESHOLD).otherwise(R.COVERAGE_THRESHOLD)
    return (
        coverage.join(new, ["repo", "path"], "left").withColumn("is_new", F.coalesce("is_new", F.lit(False)))
        .withColumn("threshold", limit).filter(F.col("pct") < F.col("threshold"))
        .select("repo", "path", "pct", "is_new", "threshold")
    )


def critical_coverage(coverage: DataFrame, groups: DataFrame) -> DataFrame:
    """Covered share per critical group and its grade; ``groups(group_name, path)``."""
    both = coverage.join(groups, "path").groupBy("group_name").agg(
        F.sum("covered").alias("covered"), F.sum("statements").alias("statements")
    )
    pct = F.coalesce(F.try_divide(F.col("covered") * 100.0, F.col("statements")), F.lit(0.0))
    grade = None
    for bound, name in R.GRADES:
        grade = F.when(F.col("pct") >= bound, name) if grade is None else grade.when(F.col("pct") >= bound, name)
    return both.withColumn("pct", pct).withColumn("grade", grade.otherwise("D"))
