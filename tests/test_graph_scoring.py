"""Graphs, contracts, facts, scores and streams on literal tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lintlake.functions import scalars as fn
from lintlake.operators import rule_index, contracts as C, facts as V, gates as GT, graph as G, registry, rollups as R, scoring as S
from lintlake.session import work_path
from lintlake.streaming import live


def edges(spark, pairs):
    return spark.createDataFrame([("r", a, b) for a, b in pairs], "repo string, src string, dst string")


def test_cycles(spark):
    assert G.cycles(edges(spark, [("core", "utils")])).count() == 0
    got = G.cycles(edges(spark, [("a", "b"), ("b", "a"), ("a", "c"), ("c", "b"), ("d", "d"), ("x", "a")]))
    assert {r.cycle for r in got.collect()} == {"a>b", "a>c>b", "d"}


def test_cycles_against_brute_force(spark):
    rng = random.Random(5)
    pairs = {(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for _ in range(30)}
    out = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    want = set()

    def walk(path):
        for nxt in out.get(path[-1], []):
            if nxt == path[0]:
                want.add(">".join(path))
            elif nxt > path[0] and nxt not in path and len(path) < 6:
                walk([*path, nxt])

    for node in out:
        walk([node])
    assert {r.cycle for r in G.cycles(edges(spark, pairs), 6).collect()} == want


def test_cycle_groups_of_any_length(spark):
    ring = lambda tag, n: [(f"{tag}{k:02d}", f"{tag}{(k + 1) % n:02d}") for k in range(n)]
    dense = [(f"d{a}", f"d{b}") for a in range(12) for b in range(12) if a != b]
    pairs = ring("a", 8) + ring("b", 50) + dense + [("x", "a00"), ("b03", "y"), ("s", "s"), ("d0", "t"), ("t", "u"), ("a00", "b00")]
    got = {r.module: (r.cycle, r.modules) for r in G.cycle_groups(edges(spark, pairs)).collect()}
    want = {f"a{k:02d}": ("a00", 8) for k in range(8)} | {f"b{k:02d}": ("b00", 50) for k in range(50)}
    want |= {f"d{k}": ("d0", 12) for k in range(12)} | {"s": ("s", 1)}
    assert got == want


@pytest.mark.parametrize("step", [1, -1])
def test_long_cycles_take_few_rounds(spark, monkeypatch, step):
    n, rounds = 10_000, []
    write = G.materialise
    monkeypatch.setattr(G, "materialise", lambda df, name: (rounds.append(name), write(df, name))[1])
    nodes = spark.range(n).select(F.lit("r").alias("repo"), F.format_string("m%05d", "id").alias("src"), F.format_string("m%05d", F.pmod(F.col("id") + step, F.lit(n))).alias("dst"))
    got = G.cycle_groups(nodes.unionByName(edges(spark, [("m00007", "x"), ("y", "m00000"), ("x", "x")])))
    assert {tuple(r) for r in got.groupBy("cycle", "modules").count().collect()} == {("m00000", n, n), ("x", 1, 1)}
    assert rounds.count("labels") <= 20


def test_cycle_groups_against_brute_force(spark):
    rng = random.Random(11)
    rows = {(f"r{g}", f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}") for g in range(6) for _ in range(30 + 15 * g)}
    # a chain of rings in each of two repos: parts that lead to one another
    rows |= {(f"c{g}", f"k{k:02d}{i}", f"k{k:02d}{(i + 1) % 3}") for g in range(2) for k in range(20) for i in range(3)}
    rows |= {("c0", f"k{k:02d}0", f"k{k + 1:02d}1") for k in range(19)} | {("c1", f"k{k + 1:02d}0", f"k{k:02d}1") for k in range(19)}
    out = {}
    for repo, a, b in rows:
        out.setdefault((repo, a), set()).add((repo, b))
    reach = {}
    for start in out:
        seen, todo = set(), list(out[start])
        while todo:
            at = todo.pop()
            if at not in seen:
                seen.add(at)
                todo += out.get(at, ())
        reach[start] = seen
    want = set()
    for at, seen in reach.items():
        if at in seen:
            part = [x[1] for x in seen if at in reach.get(x, ())]
            want.add((*at, min(part), len(part)))
    got = G.cycle_groups(spark.createDataFrame(sorted(rows), "repo string, src string, dst string"))
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_cycles_have_no_length_bound(spark):
    pairs = [(f"m{k}", f"m{(k + 1) % 8}") for k in range(8)] + [("m3", "m1")]
    got = {(r.cycle, r.length) for r in G.cycles(edges(spark, pairs)).collect()}
    assert got == {("m0>m1>m2>m3>m4>m5>m6>m7", 8), ("m1>m2>m3", 3)}
    assert {r.length for r in G.cycles(edges(spark, pairs), 4).collect()} == {3}
    assert G.cycle_groups(edges(spark, [("a", "b"), ("b", "c")])).count() == 0 and G.cycles(edges(spark, [("a", "b")])).count() == 0


def test_line_facts(spark):
    code = ["import os.path", "from a import b as c, d", "    async def f(x):", "class K:", "x = import_it", "define = 1"]
    lines = spark.createDataFrame([("r", "a.py", "py", k, t) for k, t in enumerate(code, 1)], "repo string, path string, ext string, line_no int, line string")
    files = spark.createDataFrame([("r", "a.py", "py", "\n".join(code)), ("r", "b.ts", "ts", "import x")], "repo string, path string, ext string, content string")
    assert sorted((r.module, r.imported, r.alias or "") for r in V.import_facts(files).collect()) == [("a", "b", "c"), ("a", "d", ""), ("os.path", "os.path", "")]
    assert sorted((r.kind, r.name, r.is_async) for r in V.definition_facts(lines).collect()) == [("class", "K", False), ("def", "f", True)]


@pytest.mark.parametrize(("code", "want"), [
    ("import ok", [(1, "ok", "ok", None)]),
    ("import a as b", [(1, "a", "a", "b")]),
    ("import a, c.d as e", [(1, "a", "a", None), (1, "c.d", "c.d", "e")]),
    ("try:\n\timport a\nexcept ImportError: import b", [(2, "a", "a", None), (3, "b", "b", None)]),
    ("import os  # import not", [(1, "os", "os", None)]),
    ("x = 1\nfrom x import (\n    a,  # (\n    b as c,\n)\nimport z", [(2, "x", "a", None), (2, "x", "b", "c"), (6, "z", "z", None)]),
    ("from a import b as c, d", [(1, "a", "b", "c"), (1, "a", "d", None)]),
    ("from a \\\n    import b, \\\n    c", [(1, "a", "b", None), (1, "a", "c", None)]),
    ("from . import x\nfrom ..y.z import *\nfrom .w import(q)", [(1, ".", "x", None), (2, "..y.z", "*", None), (3, ".w", "q", None)]),
    ("import a; import b;x = 'import c'", [(1, "a", "a", None), (1, "b", "b", None)]),
    ('''"""\nimport no\n# it's\n"""\nimport yes\ns = "# import" + f\'\'\'\nfrom no import no\n\'\'\'\nimport too''', [(5, "yes", "yes", None), (9, "too", "too", None)]),
    ("f(1, [2,\nimport a\nx = ')'\nimport b", [(2, "a", "a", None), (4, "b", "b", None)]),
    ("important = 1\nx.import_it()\nimport\nfrom x\nyield_from = 1", []),
    ("", []),
    ("import a\r\nimport b\r\n", [(1, "a", "a", None), (2, "b", "b", None)]),
])
def test_import_forms(code, want):
    assert list(V.imports_of(code)) == want


def test_names_that_need_no_import(spark):
    free = ["print", "breakpoint", "exit", "quit", "help", "reduce", "__import__", "pytest", "mock", "patch", "xfail", "ValueError", "Ellipsis"]
    calls = [("r", "a.py", "call", n, "name", "", k) for k, n in enumerate([*free, "frobnicate"])]
    facts = spark.createDataFrame(calls, "repo string, path string, kind string, name string, qualifier string, signature string, line_no int")
    assert [r.name for r in G.missing_imports(facts).collect()] == ["frobnicate"]


@pytest.mark.parametrize(("pattern", "want"), [
    ("password", "password"), (r"\bprint\(", "print("), ("ab+cdef", "cdef"), ("abcd?ef", "abc"), ("abc|def", ""), ("(abc|def)ghij", "ghij"), ("a{2,3}bcd", "bcd"),
    (r"[a-z\]]+_key", "_key"), ("(?i)secret", ""), (r"x\.y\/z", "x.y/z"), ("", ""), ("(a(b)c)*", ""), (r"\x41bcd", ""), ("abc*?def", "def"), ("a.bcd.e", "bcd"),
    ("(?:key|token)[(]=value", "=value"), (r"\Qa.b\E", ""),
])
def test_required_literals(pattern, want):
    assert rule_index.required_literal(pattern) == want


def test_a_pack_of_thousands_of_rules(spark):
    """The rows of searching every rule in every line; a plan that does not grow with the pack."""
    import random
    import re

    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(4, 8))) for _ in range(4000)]
    patterns = [rng.choice([w, rf"\b{w}", f"{w}+", f"{w[:4]}.*{w[2:]}", f"({w[:3]}|x){w[1:]}", f"{w[0]}{{1,2}}{w[1:]}\\("]) for w in words]
    rules = [(f"R{k}", p, "LOW", True) for k, p in enumerate(patterns)] + [("S1", "ab", "HIGH", True), ("S2", "(?i)ABCDE", "HIGH", True), ("S3", "x|é", None, True)]
    rules += [("off", "abcd", "LOW", False), ("null", None, "LOW", True), ("R0", patterns[0], "LOW", True)]
    texts = [" ".join(rng.choice([*words, "x", "é日本", words[0] + "(", words[5] * 2]) for _ in range(rng.randrange(12))) for _ in range(400)]
    files = spark.createDataFrame([("r", f"p{k}", "py", "\n".join(texts[k::4])) for k in range(4)], "repo string, path string, ext string, content string")
    pack = spark.createDataFrame(rules, "rule_id string, pattern string, severity string, enabled boolean")
    compiled = [(i, re.compile(p)) for i, p, _, on in rules if on and p is not None]
    want = sorted((f"p{k}", n, i) for k in range(4) for n, line in enumerate(texts[k::4], 1) for i, p in compiled if p.search(line))
    got = rule_index.run_large_rule_pack(files, pack)
    assert sorted((r.path, r.line_no, r.rule_id) for r in got.collect()) == want and len(want) > 400

    literal = [r for r in rules if r[1] and len(rule_index.required_literal(r[1])) >= rule_index.Q]

    def plan_size(n):
        found = rule_index.run_large_rule_pack(files, spark.createDataFrame(literal[:n], pack.schema))
        return len(re.sub(r"\d+", "", found._jdf.queryExecution().optimizedPlan().toString()))

    assert abs(plan_size(3000) - plan_size(10)) < 500


def test_rule_packs_of_any_size(spark):
    rules = [{"rule_id": f"R{k}", "pattern": f"word{k}\\b", "severity": "LOW"} for k in range(450)]
    files = spark.createDataFrame([("r", "a.py", "py", "x word7\nword449 word200\nnone")], "repo string, path string, ext string, content string")
    got = sorted((r.line_no, r.rule_id) for r in registry.run_rule_pack(files, rules).collect())
    assert got == [(1, "R7"), (2, "R200"), (2, "R449")]
    assert registry.run_rule_pack(files, []).count() == 0


def test_large_files_are_reported(spark):
    files = spark.createDataFrame([("r", "a", 10), ("r", "b", 3_000_000), ("r", "c", None)], "repo string, path string, size long")
    assert [r.path for r in GT.skipped_files(files).collect()] == ["b"]
    assert sorted(r.path for r in GT.max_size(files).collect()) == ["a", "c"]


def test_contract_breaks(spark):
    schema = "service string, method string, endpoint string, side string, field string, type string, format string, required boolean, status_code int"
    old = [("s", "GET", "/u", "request", "a", "string", "email", True, 200), ("s", "GET", "/u", "request", "b", "string", None, False, 200),
           ("s", "GET", "/u", "response", "c", "int", None, False, 200), ("s", "GET", "/gone", "request", "z", "string", None, True, 200)]
    new = [("s", "GET", "/u", "request", "a", "string", None, False, 201), ("s", "GET", "/u", "response", "c", "string", None, False, 201)]
    got = C.contract_breaks(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)).collect()
    assert {(r.field, r.reason) for r in got} == {
        ("a", "required_removed"), ("a", "format_changed"), ("b", "request_field_removed"), ("c", "response_type_changed"), ("", "status_changed"),
    }


def test_versions(spark):
    cases = [("2.25.0", "<=", "2.25.0", True), ("2.25.1", "<=", "2.25.0", False), ("2.9.0", "<", "2.25.0", True), ("3", "==", "3.0.0", True), ("1.10", ">", "1.9", True)]
    df = spark.createDataFrame(cases, "v string, op string, b string, want boolean")
    assert df.filter(fn.version_matches(F.col("v"), F.col("op"), F.col("b")) != F.col("want")).count() == 0


def test_calibration_limits_are_strict(spark):
    def votes(kind, *ratings):
        return [(kind, "*", r) for r in ratings]

    fp, ok, low = "false_positive", "confirmed", "low_priority"
    data = votes("two", fp, fp) + votes("half", fp, fp, ok, low) + votes("three", fp, fp, ok) + votes("sure", ok, ok, ok) + votes("four_of_five", ok, ok, ok, ok, low)
    df = spark.createDataFrame(data, "error_type string, file_pattern string, user_rating string")
    base = spark.createDataFrame([("sure", 10)], "error_type string, weight int")
    assert {r.error_type: r.weight for r in S.calibrate(df, base).collect()} == {"three": 14, "sure": 13}


@pytest.mark.parametrize("weight,score,status", [(-0.15, 1.0, "normal"), (-0.15, 0.4, "encourage"), (-1.0, 1.0, "warning"), (-3.0, 1.0, "critical")])
def test_fatigue_reaches_every_status(spark, weight, score, status):
    weights = {"refactor_success": 0.25, "performance_improvement": 0.2, "bug_fix_time": 0.2, "false_positive_rate": weight, "dev_velocity": 0.2}
    if status == "critical":
        weights = {"false_positive_rate": -1.0}
    row = spark.createDataFrame([{d: score for d in weights}])
    assert S.fatigue(row, weights).first().status == status


def test_penalty_score(spark):
    data = [("r", "a", False, "CRITICAL"), ("r", "a", False, "ERROR"), ("r", "b", False, "WARNING"), ("r", "b", False, "INFO"), ("r", "c", True, "CRITICAL")]
    df = spark.createDataFrame(data, "repo string, operator string, passed boolean, severity string")
    assert R.penalty_score(df).first().score == 64
    many = df.crossJoin(spark.range(9)).drop("id")
    assert R.penalty_score(many).first().score == 0


def test_idle_grants_match_parts_of_commands(spark):
    grants = spark.createDataFrame([("t", "Zip(a)"), ("t", "Deploy(b)"), ("t", "Read(c)")], "tool string, entry string")
    usage = spark.createDataFrame([("t", "Bash(UnZip x) then Bash(ls)")], "tool string, text string")
    assert [r.entry for r in GT.idle_grants(grants, usage).collect()] == ["Deploy(b)"]


def test_duplicate_checks_are_refused():
    checks = registry.Checks()
    checks.add("a", lambda t: None)
    with pytest.raises(ValueError):
        checks.add("a", lambda t: None)
    assert [r["rule_id"] for r in registry.rules_from_json('[{"rule_id":"x"},{"rule_id":"y","enabled":false}]')] == ["x"]


def test_stream_suppression_over_several_batches(spark):
    base, rng = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc), random.Random(2)
    data = [(f"k{rng.randrange(3)}", base + dt.timedelta(seconds=i * 3), i) for i in range(120)]
    path = work_path(spark, "in")
    for part in range(4):
        spark.createDataFrame(data[part * 30:(part + 1) * 30], "component_id string, ts timestamp, event_id long").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("component_id string, ts timestamp, event_id long").option("maxFilesPerTrigger", 1).parquet(path)
    got = {r.event_id for r in live.drain(live.stream_suppress(stream, 10), "out").collect()}
    last, want = {}, set()
    for key, ts, i in data:
        if key not in last or (ts - last[key]).total_seconds() >= 10:
            last[key] = ts
            want.add(i)
    assert got == want


def test_stream_health_over_several_batches(spark):
    base = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    statuses = ["PANIC", "PANIC", "OK", "PANIC", "DEGRADED", "PANIC"]
    path = work_path(spark, "in")
    for i, s in enumerate(statuses):
        spark.createDataFrame([("a", base + dt.timedelta(seconds=i), i, s)], "component_id string, ts timestamp, event_id long, status string").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("component_id string, ts timestamp, event_id long, status string").option("maxFilesPerTrigger", 1).parquet(path)
    got = live.drain(live.stream_health(stream), "health", "update").orderBy("last_failure", "last_success").collect()
    assert [r.consecutive_failures for r in got][-1] == 3 and not got[-1].healthy
