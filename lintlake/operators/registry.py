"""Pluggable checks: named DataFrame checks (V1, V3), per-file rules (V2) and rule packs as data (V5)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lintlake.operators import lines as L
from lintlake.operators.rollups import FINDING, union_findings

Check = Callable[[dict[str, DataFrame]], DataFrame]
FileRule = Callable[[str, str], list[tuple[int, str]]]
RULE_SCHEMA = "repo string, path string, line_no long, rule_id string, message string, error string"


class Checks:
    """V1/V3: checks by name; each takes the tables and gives findings."""

    def __init__(self) -> None:
        self._checks: dict[str, Check] = {}

    def add(self, name: str, check: Check) -> None:
        if name in self._checks:
            raise ValueError(f"duplicate check {name}")
        self._checks[name] = check

    def names(self) -> list[str]:
        return sorted(self._checks)

    def run(self, name: str, tables: dict[str, DataFrame]) -> DataFrame:
        found = self._checks[name](tables)
        missing = set(FINDING) - set(found.columns)
        if missing:
            raise ValueError(f"check {name} lacks {sorted(missing)}")
        return found.select(*FINDING).withColumn("check_name", F.lit(name))

    def run_all(self, tables: dict[str, DataFrame]) -> DataFrame:
        return union_findings(*[self.run(name, tables) for name in self.names()])


def run_file_rules(files: DataFrame, rules: dict[str, FileRule]) -> DataFrame:
    """V2: user rules ``rule(path, content) -> [(line_no, message)]`` over files; a failing rule gives an error row."""

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for repo, path, content in zip(pdf["repo"], pdf["path"], pdf["content"]):
                for rule_id, rule in rules.items():
                    try:
                        rows += [(repo, path, line, rule_id, message, None) for line, message in rule(path, content)]
                    except Exception as exc:
                        rows.append((repo, path, 0, rule_id, "", f"{type(exc).__name__}: {exc}"))
            yield pd.DataFrame(rows, columns=["repo", "path", "line_no", "rule_id", "message", "error"])

    return files.select("repo", "path", "content").mapInPandas(apply, RULE_SCHEMA)


def rules_from_json(text: str) -> list[dict]:
    """V5: enabled rules of a JSON list of {rule_id, pattern, severity, enabled, message}."""
    return [r for r in json.loads(text) if r.get("enabled", True)]


def rule_rows(pack: DataFrame) -> list[dict]:
    """V5: an enabled rule table as rows on the driver: rules are configuration, of any number."""
    return [r.asDict() for r in pack.filter("enabled").orderBy("rule_id").toLocalIterator()]


def run_rule_pack(files: DataFrame, rules: list[dict], group: int = 200) -> DataFrame:
    """V5: all pattern rules in one pass over the files; one finding per (line, rule). Patterns are searched together in groups of
    ``group``, so packs of any size stay within the regex engine's and the code generator's limits."""
    groups = [rules[k : k + group] for k in range(0, len(rules), group)]
    if not groups:
        return files.select("repo", "path", F.lit(0).cast("long").alias("line_no"), F.lit("").alias("rule_id"), F.lit("").alias("level")).limit(0)

    def any_rule(line: Column) -> Column:
        hit = F.lit(False)
        for part in groups:
            hit = hit | line.rlike(L.any_of(r["pattern"] for r in part))
        return hit

    found = L.line_hits(files, any_rule)
    rows = F.flatten(F.array(*[
        F.array_compact(F.array(*[
            F.when(F.col("line").rlike(r["pattern"]), F.struct(F.lit(r["rule_id"]).alias("rule_id"), F.lit(r["severity"]).alias("level"))) for r in part
        ])) for part in groups
    ]))
    return found.select("repo", "path", F.col("line_no").cast("long").alias("line_no"), F.inline(rows))
