"""V5 for packs of thousands of rules: an inverted index of the literals that the rules' patterns require.

A match of most patterns must hold some literal text. Of every rule's longest such literal one q-gram, the one that the fewest rules have,
goes into an index; lines are cut into q-grams, looked up by an equi-join and verified against the patterns found. The plan is the same for
any number of rules, and a line meets only the patterns whose q-gram it holds. Rules without a literal of ``Q`` characters are searched
as before (``registry.run_rule_pack``).

A null pattern matches nothing; rules with the same id count each; a disabled or null ``enabled`` is no rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from lintlake.operators import lines as L
from lintlake.operators.registry import run_rule_pack

Q, MAX_BROADCAST = 4, 200_000
FOUND = ["repo", "path", "line_no", "rule_id", "level"]
_NOT_LITERAL = set(".^$*+?{}[]()|\\")


def _group_end(pattern: str, at: int) -> int:
    """Index behind the group or class that opens at ``at``."""
    closing, depth = {"(": ")", "[": "]"}[pattern[at]], 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at += 1
        elif closing == "]":
            if c == "[":
                depth += 1
            elif c == "]":
                depth -= 1
        elif c == "[":
            at = _group_end(pattern, at) - 1
        elif c in "()":
            depth += 1 if c == "(" else -1
        at += 1
        if not depth:
            return at
    return at


def required_literal(pattern: str) -> str:
    """The longest text that every match of ``pattern`` holds, as far as its top level tells; '' if that is none."""
    runs, run, at = [], "", 0
    if "(?" in pattern.replace("(?:", "") or "\\Q" in pattern:
        return ""  # flags may change what a letter stands for
    while at < len(pattern):
        c, single = pattern[at], ""
        if c == "|":
            return ""
        if c in "([":
            at = _group_end(pattern, at)
        elif c == "\\":
            if pattern[at + 1 : at + 2] and not pattern[at + 1].isalnum():
                single = pattern[at + 1]
            elif pattern[at + 1 : at + 2] not in (*"wWdDsSbB",):
                return ""  # an escape of some other kind
            at += 2
        else:
            single = "" if c in _NOT_LITERAL else c
            at += 1
        optional = pattern[at : at + 1] in ("*", "?", "{")
        if single and not optional:
            run += single
        if not single or optional or pattern[at : at + 1] == "+":
            runs.append(run)
            run = ""
        if pattern[at : at + 1] == "{":
            at = pattern.find("}", at) + 1 or len(pattern)
        while pattern[at : at + 1] in ("*", "?", "+") and at < len(pattern):
            at += 1
    return max([*runs, run], key=len)


def _literals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [required_literal(p) for p in batch.column("pattern").to_pylist()]
        yield batch.append_column("literal", pa.array(found, pa.string()))


def indexed(pack: DataFrame, q: int = Q) -> tuple[DataFrame, DataFrame]:
    """(gram, rule_id, level, pattern) of the rules that have a literal, and the other rules."""
    rules = pack.filter("enabled and pattern is not null").select("rule_id", "pattern", "severity")
    read = rules.mapInArrow(_literals, "rule_id string, pattern string, severity string, literal string")
    long_enough = F.length("literal") >= q
    numbered = read.filter(long_enough).withColumn("rule", F.monotonically_increasing_id())
    cut = numbered.select("rule", F.explode(F.sequence(F.lit(1), F.length("literal") - q + 1)).alias("at"), "literal", "rule_id", "pattern", "severity")
    grams = cut.withColumn("gram", F.substring("literal", F.col("at"), F.lit(q)))
    shared = grams.withColumn("n", F.count("*").over(W.partitionBy("gram")))
    place = F.row_number().over(W.partitionBy("rule").orderBy("n", "at"))
    chosen = shared.withColumn("place", place).filter("place = 1")
    return chosen.select("gram", "rule_id", F.col("severity").alias("level"), "pattern"), read.filter(~long_enough).drop("literal")


def run_large_rule_pack(files: DataFrame, pack: DataFrame, q: int = Q) -> DataFrame:
    """V5: one finding per (line, rule) of ``pack(rule_id, pattern, severity, enabled)``, whatever its size."""
    index, others = indexed(pack, q)
    if index.count() <= MAX_BROADCAST:
        index = F.broadcast(index)
    lines = L.to_lines(files).select("repo", "path", F.col("line_no").cast("long").alias("line_no"), "line")
    last = F.length("line") - q + 1
    grams = lines.withColumn("at", F.explode(F.when(last > 0, F.sequence(F.lit(1), last)))).withColumn("found", F.substring("line", F.col("at"), F.lit(q)))
    # a gram that a line holds more than once counts at its first place
    hits = grams.join(index, (F.col("found") == F.col("gram")) & F.expr("locate(gram, line) = at") & F.rlike("line", F.col("pattern")))
    rest = [r.asDict() for r in others.toLocalIterator()]  # each is a part of the plan
    return hits.select(*FOUND).unionByName(run_rule_pack(files, rest).select(*FOUND))
