"""Scalar column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def content_hash(content: Column, length: int = 16) -> Column:
    """the first hex digits of SHA-256."""
    return F.substring(F.sha2(content, 256), 1, length)


def short_md5(text: Column) -> Column:
    """F1."""
    return F.substring(F.md5(text), 1, 8)


def line_count(content: Column) -> Column:
    """F2."""
    return F.size(F.split(content, "\n")).cast("long")


def error_key(error_type: Column, path: Column) -> Column:
    """type and the last two path parts."""
    parts = F.split(path, "/")
    tail = F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2))
    return F.concat(error_type, F.lit(":"), F.array_join(tail, "/"))


def module_of(path: Column) -> Column:
    """the parent directory, or the path itself when it has none."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) >= 2, F.element_at(parts, -2)).otherwise(path)


def glob_regex(pattern: Column) -> Column:
    """An anchored regex for a shell pattern of ``*``, ``?``, ``[…]`` and ``[!…]``."""
    escaped = F.regexp_replace(pattern, r"([.+^$(){}|\\])", r"\\$1")
    negated = F.replace(escaped, F.lit("[!"), F.lit("[^"))
    stars = F.replace(F.replace(negated, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit("."))
    return F.concat(F.lit("(?s)^"), stars, F.lit("$"))


def glob_match(text: Column, pattern: Column) -> Column:
    """P4."""
    return F.regexp_like(text, glob_regex(pattern))


def version_parts(version: Column) -> Column:
    """numeric parts with trailing zeros cut, so 2.0 = 2.0.0; arrays compare part by part."""
    cut = F.regexp_replace(version, r"(\.0+)+$", "")
    return F.transform(F.split(cut, "\\."), lambda part: F.coalesce(part.try_cast("int"), F.lit(0)))


def version_matches(version: Column, op: Column, bound: Column) -> Column:
    """Compare a version with a range bound."""
    a, b = version_parts(version), version_parts(bound)
    return (
        F.when(op == "<=", a <= b).when(op == "<", a < b).when(op == ">=", a >= b).when(op == ">", a > b)
        .when(op == "==", a == b).otherwise(False)
    )


def relative_age(ts: Column, now: Column) -> Column:
    """F8: how long ago, in whole seconds, minutes, hours or days."""
    diff = F.floor((F.unix_micros(now) - F.unix_micros(ts)) / 1_000_000)

    def text(unit: str, per: int) -> Column:
        return F.concat(F.floor(diff / per).cast("string"), F.lit(f" {unit} ago"))

    return (
        F.when(diff < 60, text("s", 1)).when(diff < 3600, text("min", 60)).when(diff < 86_400, text("h", 3600))
        .otherwise(text("d", 86_400))
    )


def log_level(line: Column) -> Column:
    """F9."""
    return (
        F.when(line.contains("ERROR") | line.contains("Traceback"), "ERROR")
        .when(line.contains("WARN"), "WARNING")
        .otherwise("INFO")
    )


def json_list(text: Column) -> Column:
    """a JSON string list; text that is none becomes its only element."""
    return F.coalesce(F.from_json(text, "array<string>", {"mode": "PERMISSIVE"}), F.array(text))


def call_confidence(form: Column) -> Column:
    """confidence by the call's own form."""
    return F.when(form == "name", 1.0).when(form == "attribute", 0.9).when(form == "subscript", 0.3).otherwise(0.7)


def growth_advice(change_pct: Column) -> Column:
    """F12."""
    return (
        F.when(change_pct > 200, "split into modules now")
        .when(change_pct > 100, "review the file's responsibilities")
        .otherwise("refactor regularly")
    )
