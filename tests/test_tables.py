"""Rows written out by hand for each rule table, apart from the SQL, which reads the same tables."""

import pytest
from pyspark.sql import functions as F

from lintlake.operators import contracts, drift, gates as G, graph as GR, rollups, scans as S
from lintlake.rules import code_rules, gate_rules


def files(spark, text, ext="py", path="svc/a"):
    return spark.createDataFrame([("r", f"{path}.{ext}", ext, text)], "repo string, path string, ext string, content string")


ROUTES = [
    ("py", '@app.route("/x")', "Flask"), ("py", '@router.get("/x")', "FastAPI"), ("py", "@api_view(['GET'])", "Django REST"),
    ("py", "app.post('/x')", "FastAPI"), ("ts", "app.delete('/x')", "Express.js"), ("ts", "router.post('/x')", "Express.js"),
    ("go", 'r.PUT("/x")', "Gin"), ("go", 'app.Get("/x")', "Fiber"), ("py", "r.GET('/x')", None), ("go", "@router.get('/x')", None),
]


@pytest.mark.parametrize("ext, line, framework", ROUTES)
def test_routes(spark, ext, line, framework):
    got = [r.framework for r in S.scan_auth(files(spark, line + "\nx = 1", ext)).collect()]
    assert got == ([framework] if framework else [])


@pytest.mark.parametrize("word", [
    "login_required", "authenticate", "authorize", "permission", "token", "jwt", "oauth", "@current_user", "@require_auth", "Depends(",
    "get_current_user", "AuthenticationError", "auth_required", "requires_auth",
])
def test_every_authentication_word_guards_a_route(word):
    assert word in code_rules.AUTH_WORDS


def test_authentication_words_are_these_only(spark):
    assert len(code_rules.AUTH_WORDS) == 14
    assert S.scan_auth(files(spark, '@app.route("/x")\n@login_required\ndef f(): pass')).count() == 0
    assert S.scan_auth(files(spark, '@app.route("/x")\n@cached\ndef f(): pass')).count() == 1


def test_command_risks(spark):
    want = {
        "Bash(rm -rf /tmp/x)": "CRITICAL", "Bash(nc -l 1)": "CRITICAL", "sshpass -p x": "CRITICAL", "Bash(curl http://a.b)": "HIGH",
        "Bash(curl https://github.com/x)": "LOW", "Bash(scp a b)": "HIGH", "Bash(gzip x)": "MEDIUM", "Bash(python3 -c 'x')": "MEDIUM",
        "Bash(git status)": "LOW", "Read(x)": "LOW", "Tool --password x": "CRITICAL", "Something(else)": "INFO",
    }
    df = spark.createDataFrame([(e,) for e in want], "entry string").select("entry", S.classify_risk(F.col("entry")).alias("risk"))
    assert {r.entry: r.risk for r in df.collect()} == want


def test_advisories(spark):
    table = spark.createDataFrame(gate_rules.ADVISORIES, "ecosystem string, package string, range_op string, range_version string, severity string, summary string")
    found = [
        ("python", "Requests", "2.18.4"), ("python", "requests", "2.25.0"), ("python", "requests", "2.25.1"), ("python", "django", "3.1"),
        ("python", "pyyaml", "5.4"), ("python", "pyyaml", "5.3.1"), ("node", "lodash", "4.17.20"), ("node", "lodash", "4.17.21"), ("node", "requests", "1.0"),
    ]
    deps = spark.createDataFrame(found, "ecosystem string, package string, version string")
    got = {(r.package, r.version, r.summary) for r in G.vulnerabilities(deps, table).collect()}
    assert got == {
        ("Requests", "2.18.4", "CVE-2021-33503"), ("Requests", "2.18.4", "CVE-2018-18074"), ("requests", "2.25.0", "CVE-2021-33503"),
        ("django", "3.1", "CVE-2021-33503"), ("pyyaml", "5.3.1", "CVE-2020-14343"), ("lodash", "4.17.20", "CVE-2021-23337"),
    }


def test_layers(spark):
    rows = [
        ("r", "routes/a.py", "db.users"), ("r", "routes/a.py", "services.x"), ("r", "src/db/b.py", "handlers"), ("r", "src/db/b.py", "models"),
        ("r", "models/m.py", "service.y"), ("r", "utils/u.py", "apis"), ("r", "services/s.py", "db"), ("r", "tests/routes/t.py", "db"),
    ]
    got = {(r.path, r.layer, r.forbidden) for r in GR.layer_violations(spark.createDataFrame(rows, "repo string, path string, qualifier string")).collect()}
    assert got == {("routes/a.py", "entry", "db"), ("src/db/b.py", "data", "handlers"), ("models/m.py", "model", "services"), ("utils/u.py", "util", "api")}


def test_home_folder_is_a_parameter(spark):
    text = "a = '/home/dev/.kube'\nb = '/home/ann/.kube/'\nc = '~/.aws'\nd = '/srv/x/.ssh'"
    assert sorted(r.line_no for r in S.scan_paths(files(spark, text)).collect()) == [1, 3, 4]
    assert sorted(r.line_no for r in S.scan_paths(files(spark, text), "/home/ann").collect()) == [2, 3, 4]


def test_contract_hash_is_of_the_multiset(spark):
    rows = [("s", "GET", f"/p{k}", 200, f"h{k}") for k in range(50)]
    other = [*rows[:-1], ("s", "GET", "/p49", 201, "h49")]

    def hashed(values, parts):
        df = spark.createDataFrame(values, "service string, method string, endpoint string, status_code int, schema_hash string")
        return [r.baseline_hash for r in contracts.baseline_hash(df.repartition(parts)).collect()]

    first = hashed(rows, 1)
    assert first == hashed(rows[::-1], 4) and len(first[0]) == 16
    assert len({first[0], hashed(rows + rows[:1], 2)[0], hashed(rows[1:], 2)[0], hashed(other, 2)[0]}) == 4
    assert hashed(rows[:0], 1) == []


def test_contract_hash_covers_every_digit_of_a_leaf(spark):
    leaf = "0123456789abcdef" * 4
    rows = spark.createDataFrame([("a", leaf), ("b", leaf[:-1] + "0")], "service string, h string")
    assert len({r.out for r in contracts.tree_hash(rows, ["service"], "h", "out").collect()}) == 2


def test_findings_are_found_once(spark, tmp_path):
    """Numbering a level's findings and reporting them read each finding twice; the scan behind them runs once."""
    from lintlake.sources import sinks

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [("r", f"p{k}", k, "X", "fail", "LOW", "m") for k in range(30)]
    schema = "repo string, path string, line_no long, rule_id string, type string, level string, message string"
    found = spark.createDataFrame(rows, schema).mapInArrow(count, schema)
    assert sorted(r.rank for r in rollups.findings_of_level(found).collect()) == list(range(1, 31)) and seen.value == 30
    sinks.write_report(found, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 31 and seen.value == 60


def test_import_diff_reads_each_version_once(spark):
    schema = "repo string, path string, module string, name string, alias string"
    old = spark.createDataFrame([("r", "a", "m", "x", None), ("r", "a", "m", "y", "z"), ("r", "a", "gone", "q", None), ("r", None, "n", "x", None)], schema)
    new = spark.createDataFrame([("r", "a", "m", "x", None), ("r", "a", "m", "y", None), ("r", "a", "m", "w", None), ("r", "a", "come", "q", None), ("r", "a", "come", "p", None)], schema)
    out = drift.diff_imports(old, new)
    assert sorted((str(r.path), r.name, r.change_type) for r in out.collect()) == [
        ("None", "n", "deleted"), ("a", "come", "added"), ("a", "gone", "deleted"), ("a", "m.w", "added"), ("a", "m.y", "added")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + out._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") <= 2
